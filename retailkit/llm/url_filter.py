"""Operator 1: URL filter by rules and gradient-boosted trees on lexical features.  DataFrame operations only.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; the
longest fitting rule wins.  Other urls are judged by boosted trees (Spark's GBTClassifier) over length, depth, digit
ratio, entropy, parameter counts, hyphens and suffix statistics.  A suffix statistic is the smoothed share of
blocked urls among the labelled ones with the same last 1, 2 or 3 labels of the host.

The trees are fitted on a bounded sample of the labelled urls: of each class the SAMPLE first by hash of the url.  Suffix statistics
are counted over all labelled rows, combined before one shuffle; the shorter suffixes are summed from the longest.  For fitting, a
url's statistic leaves out its own fold (one of FOLDS by hash of the url), so its own label isn't in it.  Tables of few suffixes are broadcast, after
they are counted; others are joined by shuffle.  Every page is judged.

Labelled urls of the query: a page's url is labelled "block" if a label of its host consists of or joins by
hyphens one of the listed SEED terms, else "allow".

Inputs: a null url or one without "://" has an empty host and path; its features are those of the empty string.
Repeated rows give repeated rows.  An empty table gives an empty one; without labelled urls of both classes the trees
are left out and urls that no rule fits are allowed.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import cut, if_small, read_table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Fixed value: terms whose hosts are labelled "block"
SEED = ("casino", "bets", "pills", "spam", "adult", "porn", "ads")
SAMPLE, TREES, DEPTH, SEED_NUMBER = 4000, 20, 4, 7
SMOOTHING, FOLDS = 5.0, 5
SUFFIXES = (1, 2, 3)
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_query_length",
            *(f"f_suffix{k}" for k in SUFFIXES))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    first = F.locate("://", url)
    rest = F.when(first > 0, url.substr(first + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule's text and action (null without one); rules are a configuration list, not a table."""
    text = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):        # the longest is tried first, so it is put outermost
        of, slash, prefix = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        text, action = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _entropy(s: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda ch: ch != ""))
    total = F.aggregate(F.transform(chars, lambda ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))), F.lit(0.0),
                        lambda acc, c: acc + c * F.log2(c.cast("double")))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds lexical features and the host's suffixes to rows (url, host, path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return urls.withColumns({
        "f_length": F.length(url).cast("double"), "f_host_length": F.length("host").cast("double"), "f_path_length": F.length("path").cast("double"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"), "f_depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / n, "f_hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
        "f_entropy": _entropy(F.col("host")), "f_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "f_query_length": F.length(query).cast("double"),
        **{f"suffix{k}": F.substring_index("host", ".", -k) for k in SUFFIXES}})


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit(SEED_NUMBER)), F.lit(FOLDS))


class Trees:
    """Fitted suffix statistics and trees."""

    def __init__(self, labelled: DataFrame):
        """``labelled``: rows (url, label) with label 1.0 for block, 0.0 for allow."""
        host, path = host_and_path(F.col("url"))
        # urls under a hash bound hold about 2 * SAMPLE of a class, so only these are sorted for the SAMPLE first ones
        distinct = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
        picked = []
        for v in (0.0, 1.0):
            share = min(1.0, 2 * SAMPLE / max(1, distinct.get(v, 0)))
            few = labelled.filter((F.col("label") == v) & (F.xxhash64("url") <= int(-2**63 + share * (2**64 - 2**12))))
            picked.append(few.select("url", "label").distinct().orderBy(F.xxhash64("url"), "url").limit(SAMPLE))
        rows = lexical(picked[0].unionByName(picked[1]).withColumn("host", host).withColumn("path", path)).withColumn("_fold", _fold())
        counts = cut(labelled.select(F.substring_index(host, ".", -max(SUFFIXES)).alias("_s"), _fold().alias("_fold"), "label")
                     .groupBy("_s", "_fold").agg(F.sum("label").alias("_bad"), F.count("*").alias("_n")))
        whole = counts.agg(F.sum("_bad").alias("bad"), F.sum("_n").alias("n")).first()
        self.model, self.base, self.tables = None, (whole["bad"] or 0.0) / max(1, whole["n"] or 0), {}
        if 0 < (whole["bad"] or 0.0) < (whole["n"] or 0):
            for k in SUFFIXES:
                folds = counts.groupBy(F.substring_index("_s", ".", -k).alias(f"suffix{k}"), "_fold").agg(F.sum("_bad").alias("_bad"), F.sum("_n").alias("_n"))
                sums = folds.groupBy(f"suffix{k}").agg(F.sum("_bad").alias("_all_bad"), F.sum("_n").alias("_all_n"))
                self.tables[k] = if_small(sums.select(f"suffix{k}", self.share(F.col("_all_bad"), F.col("_all_n")).alias(f"f_suffix{k}")))
                others = folds.join(sums, f"suffix{k}").select(f"suffix{k}", "_fold", self.share(F.col("_all_bad") - F.col("_bad"), F.col("_all_n") - F.col("_n")).alias(f"f_suffix{k}"))
                rows = others.join(F.broadcast(rows), [f"suffix{k}", "_fold"])          # at most 2 * SAMPLE rows, each in its suffix's fold
            rows = rows.coalesce(1).sortWithinPartitions("url", "label").cache()
            self.model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED_NUMBER, maxBins=32).fit(
                self.vectors(rows).select("features", "label"))
        self.rows = rows

    def share(self, bad: Column, n: Column) -> Column:
        return (bad + SMOOTHING * self.base) / (n + SMOOTHING)

    def vectors(self, urls: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(urls)

    def featured(self, urls: DataFrame) -> DataFrame:
        for k in SUFFIXES:
            urls = urls.join(self.tables[k], f"suffix{k}", "left")
        return self.vectors(urls.fillna(self.base, [f"f_suffix{k}" for k in SUFFIXES]))

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of block."""
        if self.model is None:
            return urls.withColumn("score", F.lit(0.0))
        scored = self.model.transform(self.featured(lexical(urls)))
        return scored.withColumn("score", vector_to_array("probability")[1])


def seed_labels(pages: DataFrame) -> DataFrame:
    host, _ = host_and_path(F.col("url"))
    listed = F.rlike(host, F.lit(r"(^|[.-])(" + "|".join(SEED) + r")([.-]|$)"))
    return pages.filter(F.col("url").isNotNull()).select("url", F.when(listed, 1.0).otherwise(0.0).alias("label"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    host, path = host_and_path(F.col("url"))
    urls = pages.withColumn("host", host).withColumn("path", path)
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    scored = Trees(labelled).score(urls.withColumn("rule", rule).withColumn("action", action))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, seed_labels(pages))
