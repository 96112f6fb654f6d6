"""Operator 12: which filter removes what, under every order of the filters.

A document fails a set of filters, a mask.  What an order of filters does to a document depends on its mask
alone, so documents are summed to mask cells first: (part, mask) -> documents, good ones, toxic ones.  Each cell
then folds across the array of all orders, a constant of the expression that every task holds: ``transform`` over
orders and ``aggregate`` along an order give one struct of weights per order and step (5! x 5 = 600).  The arrays
of a part's cells (32 at most) are merged by elementwise sums, and a last fold sums what a filter removed over all
orders.  All of it is DataFrame and SQL functions.

The duplicate filter is global: a document fails it if a smaller doc_id has the same text, by SHA-256.  Rows are
summed by (doc_id, text) before they meet their labels, and by (text, part, label) before the smallest doc_id of
a text is sought, so a text or a key with a third of all rows is a few rows by then.

Inputs: null text is the empty text, a null part the empty string.  Rows that repeat a doc_id and a text count as often as they
stand and don't fail the duplicate filter because of each other (no id is smaller).  A row with a null doc_id has no label, never
fails the duplicate filter and makes no other row fail it.  Several labels of one doc_id: one that says so is enough.  An
empty table gives an empty result.  Texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailkit.llm.common import read_table

FILTERS = "ABCDE"
WORDS = r"[ \t\n\x0B\f\r]+"             # what separates words
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text) -> list:
    """The documents' own failure conditions A to D, as Columns of the text."""
    words = F.array_remove(F.split(text, WORDS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the bits of the filters that they fail, A lowest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(text))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.sha2(text, 256).alias("body"), bits.alias("mask"))
    rows = rows.groupBy("doc_id", "body", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    rows = rows.withColumn("known", F.col("doc_id").isNotNull())
    # of each text, part and label: its documents, its smallest id and how many rows have that id
    alike = rows.groupBy("body", "part", "mask", "good", "toxic", "known").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    first = F.col("low") == F.min("low").over(Window.partitionBy("body"))
    fresh = F.when(~F.col("known"), F.col("n")).when(first, F.col("n_low")).otherwise(0)
    cells = alike.withColumn("fresh", fresh).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("c"))
    return cells.groupBy("part", "c.mask").agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"))


# ---- folds

ORDERS_SQL = f"transform(split('{','.join(''.join(p) for p in permutations(FILTERS))}', ','), o -> split(o, ''))"
BIT = f"shiftleft(1, instr('{FILTERS}', f) - 1)"


# the order array: a struct for every order and step, with the fold of the filters that come before in that order
STEPS = f"""flatten(transform({ORDERS_SQL}, o -> transform(o, (f, i) -> named_struct('filter_order', array_join(o, ''), 'step', i + 1, 'letter', f,
    'bit', {BIT}, 'before', aggregate(slice(o, 1, i), 0, (b, f) -> b | {BIT})))))"""


def weights(cell: str) -> str:
    """The 600 structs of one cell: its weights at every order and step."""
    fails, gone = f"{cell}.mask & s.bit != 0", f"{cell}.mask & s.before != 0"
    def weight(of: str, test: str) -> str:
        return f"if({test}, {cell}.{of}, 0L)"
    return f"""transform(steps, s -> named_struct(
        'kept', {weight('n', f'{cell}.mask & (s.bit | s.before) = 0')}, 'removed', {weight('n', f'{fails} AND NOT ({gone})')},
        'redundant', {weight('n', f'{fails} AND {gone}')}, 'unique_fails', {weight('n', f'{cell}.mask = s.bit')},
        'good_lost', {weight('good', f'{fails} AND NOT ({gone})')}, 'toxic_lost', {weight('toxic', f'{fails} AND NOT ({gone})')}))"""


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step, with COUNTS and shapley."""
    cells = mask_cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    cells = cells.select("part", "cells", F.expr(STEPS).alias("steps"))
    zero = weights("named_struct('mask', 0, 'n', 0L, 'good', 0L, 'toxic', 0L)")
    added = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    merged = f"""zip_with(steps, aggregate(transform(cells, c -> {weights('c')}), {zero},
        (sums, more) -> zip_with(sums, more, (x, y) -> named_struct({added}))),
        (s, w) -> named_struct('filter_order', s.filter_order, 'step', s.step, 'letter', s.letter, {', '.join(f"'{c}', w.{c}" for c in COUNTS)}))"""
    rows = cells.select("part", F.expr(merged).alias("rows"))
    of_filter = f"transform(split('{FILTERS}', ''), f -> aggregate(filter(rows, r -> r.letter = f), 0L, (s, r) -> s + r.removed))"
    rows = rows.select("part", "rows", F.expr(of_filter).alias("totals"))
    rows = rows.select("part", "totals", F.explode_outer("rows").alias("r"))           # never empty; a plain explode would fold twice, to test that
    return rows.select("part", "r.filter_order", F.col("r.step").cast("int").alias("step"), *(F.col(f"r.{c}").alias(c) for c in COUNTS),
                       F.expr(f"element_at(totals, instr('{FILTERS}', r.letter))").alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


# DuckDB twin: every document meets every order, without masks, cells or folds.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS part FROM documents),
     w AS (SELECT *, list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda v: v <> '') AS words, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
     d AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
                  {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                   'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), 'D': regexp_matches(x, '[#$%&*|]'),
                   'E': doc_id > low} AS f FROM w LEFT JOIN labels USING (doc_id)),
     c AS (SELECT part, good, toxic, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n FROM d GROUP BY ALL),
     l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
     o AS (SELECT p.v || q.v || r.v || s.v || u.v AS filter_order FROM l p, l q, l r, l s, l u
           WHERE len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5),
     k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS letter, substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS before
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     h AS (SELECT k.*, c.part, c.good, c.toxic, c.n,
                  (a AND letter = 'A') OR (b AND letter = 'B') OR (c AND letter = 'C') OR (d AND letter = 'D') OR (e AND letter = 'E') AS fails,
                  (a AND contains(before, 'A')) OR (b AND contains(before, 'B')) OR (c AND contains(before, 'C')) OR (d AND contains(before, 'D'))
                  OR (e AND contains(before, 'E')) AS gone, a::INT + b::INT + c::INT + d::INT + e::INT AS failed FROM k, c),
     s AS (SELECT part, filter_order, step, letter,
                  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
                  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS BIGINT) AS unique_fails,
                  CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
                  CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
