"""Operator 4: document fingerprints (SimHash).  DataFrame operations only.

A text's terms are its pairs of neighbouring words (the last word pairs with nothing); a term weighs as often as it
stands.  Each term's 64-bit hash votes +1 or -1 on every bit with its weight; a fingerprint's bit is set where the
votes are positive.  Votes are counted by exploding the terms and summing, per document, 32 longs that hold
two 32-bit counters each; all sums of a document stay in the partition where the document is.

``near_fingerprints`` finds all pairs within a Hamming radius by permuted block tables: the 64 bits are cut into
radius + 3 blocks, a table for each choice of 3 blocks is keyed by their bits, and fingerprints within the
radius agree on at least one such key.

The next document by doc_id comes from buckets of about BUCKET documents in id order: a window inside each bucket,
and the first document of the next bucket for its last one.  No window spans all documents but one over
buckets / 1024, which hold about a million documents each.

Inputs: null text is the empty text, whose only term is the empty word.  Null ids come first, in the order of the
texts' hash; repeated ids are ordered by the texts' hash, so equal rows are neighbours.  One document is its own
next.  An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailkit.llm.common import cut, read_table

BITS, BUCKET, GROUP = 64, 500, 1024
LANES = (1 << 32) | 1


def term_votes(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, fp): the fingerprint of each row's text; rows of equal keys count as one text."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\n\r\x0b\x0c]+")
    terms = texts.select(*keys, words.alias("words")).select(*keys, F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"))).alias("a", "b"))
    h = F.col("h")
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(LANES)).alias(f"s{i}") for i in range(32)]
    counted = terms.select(*keys, F.xxhash64("a", "b").alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = [F.when(F.col(f"s{i}").bitwiseAND(0xFFFFFFFF) * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"s{i}", 32) * 2 > F.col("n"), F.lit(_signed(1 << (i + 32)))).otherwise(F.lit(0)) for i in range(32)]
    return counted.select(*keys, reduce(Column.bitwiseOR, [b.cast("long") for b in bits]).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, tie, doc_id, text): ids in ascending order over ascending buckets, null ids before all others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("doc_id").alias("n")).first()
    a, b, n = span["a"] or 0, span["b"] or 0, max(1, span["n"])
    width = max(1, -(-(b - a + 1) * BUCKET // n))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.shiftright("tie", 54) - 512).otherwise(F.expr(f"(doc_id - {a}L) div {width}L")).cast("long"))


def next_buckets(ordered: DataFrame) -> DataFrame:
    """(bucket, next_bucket) for the buckets that have rows; the last one's next is the first."""
    b = cut(ordered.select("bucket").distinct().withColumn("grp", F.expr(f"bucket div {GROUP}")))
    groups = b.groupBy("grp").agg(F.min("bucket").alias("first"))
    everything = Window.orderBy("grp")
    follow = groups.withColumn("after", F.coalesce(F.lead("first").over(everything), F.first("first").over(everything))).select("grp", "after")
    inside = F.lead("bucket").over(Window.partitionBy("grp").orderBy("bucket"))
    return b.withColumn("inside", inside).join(follow, "grp").select("bucket", F.coalesce("inside", "after").alias("next_bucket"))


def with_next(ordered: DataFrame, follow: DataFrame, value: str, alias: str) -> DataFrame:
    """Adds the next row's ``value``; ``ordered`` has bucket and rn (1, 2, ... in the bucket)."""
    w = Window.partitionBy("bucket").orderBy("rn")
    heads = follow.join(ordered.filter("rn = 1").select(F.col("bucket").alias("next_bucket"), F.col(value).alias("_head")), "next_bucket").select("bucket", "_head")
    return (ordered.withColumn("_lead", F.lead(value).over(w)).withColumn("_last", F.lead("rn").over(w).isNull())
            .join(heads, "bucket").withColumn(alias, F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_lead"))).drop("_lead", "_last", "_head"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    ordered = in_order(docs)
    follow = cut(next_buckets(ordered))
    ordered = ordered.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "tie")))
    texts = with_next(ordered, follow, "text", "next_text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half))
    texts = texts.withColumn("edited", edited)
    # one pass over both texts; facts about the document ride along as grouping keys
    both = texts.select("bucket", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    both = both.select("bucket", "rn", "doc_id", "n_chars", "edited_sha256", "x.which", "x.t")
    fps = term_votes(both, "t", "bucket", "rn", "which", "doc_id", "n_chars", "edited_sha256")
    one = fps.groupBy("bucket", "rn", "doc_id", "n_chars", "edited_sha256").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    done = with_next(cut(one), follow, "fp", "nfp")

    def text(c):
        return F.lpad(F.lower(F.hex(c)), 16, "0")
    return done.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"))


def near_fingerprints(fps: DataFrame, radius: int = 3, keyed: int = 3) -> DataFrame:
    """All pairs (a, b, distance), a < b, of different fingerprints (column fp, a long) within ``radius``.

    Null fingerprints are ignored; documents join by their fingerprint, so copies are not expanded into pairs.
    """
    fps = fps.select("fp").filter(F.col("fp").isNotNull()).distinct()
    n = radius + keyed
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(n), keyed)]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("k")
    keyed_rows = fps.select("fp", tables).select("fp", "k.t", "k.key")
    left, right = keyed_rows.withColumnRenamed("fp", "a"), keyed_rows.withColumnRenamed("fp", "b")
    d = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (d <= radius)).select("a", "b", d.cast("int").alias("distance")).distinct()


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
