"""Skew-safe running sums (WIN-1, WIN-2, WIN-9).

A plain ``sum(...).over(partitionBy(key).orderBy(...))`` sends every row of
a key to one task; when one customer or product holds a third of the rows,
that task does a third of the work.  ``running_sum`` splits the scan in two
levels along a *bucket* column that is monotone in the ordering (e.g. the
day of the timestamp):

1. rows are shuffled once on (key, bucket); a window over each (key, bucket)
   gives the running value inside the bucket and the bucket total -- its
   partitions are bounded by one bucket, not by the key;
2. one row per (key, bucket) with its total (no new shuffle: the data is
   already partitioned that way), then an exclusive prefix over those totals
   per key -- a window over a small table;
3. offset from (2) + running value from (1), joined on (key, bucket), again
   without moving the large side.

The result equals the single-window form exactly (tested), for any data.

Cutting every key costs two more shuffles of about as many rows, since a key with few rows has a bucket for nearly each of them.  With
``heavy`` (see ``heavy_keys``) only these keys are cut, and the others are one group each after the one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY = 100_000         # a key with more rows is cut into buckets

_AGG = {"sum": (F.sum, lambda a, b: a + b, 0), "min": (F.min, F.least, None), "max": (F.max, F.greatest, None)}


def heavy_keys(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame | None:
    """The keys with more than ``most`` rows in ``rows``, None if there are none; at most one per ``most`` rows, so they are few.

    ``rows`` may be any frame with at least as many rows of each key as what is cut later, such as the table it is made from.
    """
    few = rows.groupBy(*keys).count().filter(F.col("count") > (HEAVY if most is None else most)).select(*keys)
    found = few.collect()
    return rows.sparkSession.createDataFrame(found, few.schema) if found else None


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` and the columns of these names after ``prefix``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def mark_heavy(df: DataFrame, keys: list[str], heavy: DataFrame, mark: str) -> DataFrame:
    """``df`` with the boolean ``mark``: the row's key is one of ``heavy``."""
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"_hv_{k}") for k in keys], F.lit(True).alias("_hv")))
    return df.join(h, same_keys(keys, "_hv_"), "left").withColumn(mark, F.coalesce("_hv", F.lit(False))).drop("_hv", *[f"_hv_{k}" for k in keys])


def _cut(df: DataFrame, keys: list[str], values: dict[str, Column], bucket: Column, heavy: DataFrame, fn):
    """``df`` dealt by key and, for ``heavy`` keys only, bucket ``_rs_bucket`` (NULL for others), and the heavy keys' totals of ``values`` per bucket."""
    d = mark_heavy(df.withColumns(values), keys, heavy, "_rs_heavy").withColumn("_rs_bucket", F.when(F.col("_rs_heavy"), bucket))
    totals = d.filter("_rs_heavy").groupBy(*keys, "_rs_bucket").agg(*[fn(c).alias(c) for c in values])
    return d.drop("_rs_heavy").repartition(*keys, "_rs_bucket"), totals


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column | str, out: str,
                bucket: Column | None = None, inclusive: bool = True, heavy: DataFrame | None | str = "all") -> DataFrame:
    return running_agg(df, keys, order, value, out, bucket, inclusive, "sum", heavy)


def running_agg(df: DataFrame, keys: list[str], order: list[Column], value: Column | str, out: str,
                bucket: Column | None = None, inclusive: bool = True, agg: str = "sum", heavy: DataFrame | None | str = "all") -> DataFrame:
    """Add ``out`` = Σ value over rows of the same key up to this row (in ``order``).

    ``bucket`` must be non-decreasing along ``order`` within a key.  Without a
    bucket the single-window form is used.  ``inclusive=False`` excludes the
    current row.

    Running ``agg`` (sum, min or max) of ``value`` per key in ``order``; see the module notes.
    For sums an empty prefix gives 0; for min/max it gives NULL (NULL values are ignored).  ``heavy``: the keys that are cut into buckets
    (``heavy_keys``; None: no key is), "all" cuts every key.
    """
    fn, combine, zero = _AGG[agg]

    def z(c):
        return F.coalesce(c, F.lit(zero)) if zero is not None else c

    v = F.col(value) if isinstance(value, str) else value
    frame_end = Window.currentRow if inclusive else -1
    if bucket is None or heavy is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.withColumn(out, z(fn(v).over(w)))

    b = "_rs_bucket"
    if not isinstance(heavy, str):
        d, totals = _cut(df, keys, {"_rs_v": v}, bucket, heavy, fn)
        inner = d.withColumn("_rs_in", z(fn("_rs_v").over(Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end))))
        before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*[F.col(k).alias(f"_rs_{k}") for k in [*keys, b]], fn("_rs_v").over(before).alias("_rs_off"))
        j = inner.join(offsets, same_keys([*keys, b], "_rs_"), "left").drop(*[f"_rs_{k}" for k in [*keys, b]])
        res = z(F.col("_rs_off")) + F.col("_rs_in") if zero is not None else F.coalesce(combine(F.col("_rs_off"), F.col("_rs_in")), "_rs_off", "_rs_in")
        return j.withColumn(out, res).drop(b, "_rs_v", "_rs_in", "_rs_off")
    d = df.withColumn(b, bucket).withColumn("_rs_v", v)
    # one shuffle of the rows on (key, bucket): the running value inside the bucket and the
    # bucket total come from the same partitioning, so the input is read and moved once
    wr = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    wt = Window.partitionBy(*keys, b)
    inner = (d.withColumn("_rs_in", z(fn("_rs_v").over(wr)))
             .withColumn("_rs_tot", fn("_rs_v").over(wt)))
    totals = inner.groupBy(*keys, b).agg(F.max("_rs_tot").alias("_rs_tot"))     # one row per (key, bucket)
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, z(fn("_rs_tot").over(wb)).alias("_rs_off"))
    j = inner.join(offsets, [*keys, b], "left")
    if zero is not None:
        res = z(F.col("_rs_off")) + F.col("_rs_in")
    else:                                   # min/max: NULL-aware combine of prefix and in-bucket value
        res = F.coalesce(combine(F.col("_rs_off"), F.col("_rs_in")), F.col("_rs_off"), F.col("_rs_in"))
    return j.withColumn(out, res).drop(b, "_rs_v", "_rs_in", "_rs_tot", "_rs_off")


def day_bucket(ts: str | Column) -> Column:
    """Days since epoch: a monotone bucket for timestamp orderings."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(F.to_date(c))


def month_bucket(d: str | Column, nulls_last: bool = True) -> Column:
    """Months since year 0 of a date; NULL dates go to a final bucket (NULLS LAST orderings)."""
    c = F.col(d) if isinstance(d, str) else d
    m = F.year(c) * 12 + F.month(c)
    return F.coalesce(m, F.lit(1 << 30)) if nulls_last else F.coalesce(m, F.lit(-(1 << 30)))


def running_sums(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], bucket: Column, inclusive: bool = True,
                 heavy: DataFrame | None | str = "all") -> DataFrame:
    """Several running sums of one order in one pass (``values``: name of the new column -> summed value, NULL counts as 0); else as ``running_sum``."""
    b, frame_end = "_rs_bucket", Window.currentRow if inclusive else -1
    if not isinstance(heavy, str):
        by = keys if heavy is None else [*keys, b]
        d, totals = (df, None) if heavy is None else _cut(df, keys, {f"_rs_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}, bucket, heavy, F.sum)
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        if heavy is None:
            return d.withColumns({n: F.coalesce(F.sum(F.coalesce(v, F.lit(0))).over(w), F.lit(0)) for n, v in values.items()})
        inner = d.withColumns({f"_rs_in_{n}": F.coalesce(F.sum(f"_rs_v_{n}").over(w), F.lit(0)) for n in values})
        before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*[F.col(k).alias(f"_rs_{k}") for k in by], *[F.sum(f"_rs_v_{n}").over(before).alias(f"_rs_off_{n}") for n in values])
        j = inner.join(offsets, same_keys(by, "_rs_"), "left")
        return j.withColumns({n: F.coalesce(f"_rs_off_{n}", F.lit(0)) + F.col(f"_rs_in_{n}") for n in values}).select(*df.columns, *values)
    wr = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    wt, wb = Window.partitionBy(*keys, b), Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumns({b: bucket} | {f"_rs_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    inner = d.withColumns({f"_rs_in_{n}": F.coalesce(F.sum(f"_rs_v_{n}").over(wr), F.lit(0)) for n in values}
                          | {f"_rs_tot_{n}": F.sum(f"_rs_v_{n}").over(wt) for n in values})
    totals = inner.groupBy(*keys, b).agg(*[F.max(f"_rs_tot_{n}").alias(f"_rs_tot_{n}") for n in values])
    offsets = totals.select(*keys, b, *[F.coalesce(F.sum(f"_rs_tot_{n}").over(wb), F.lit(0)).alias(f"_rs_off_{n}") for n in values])
    j = inner.join(offsets, [*keys, b], "left")
    return j.withColumns({n: F.coalesce(f"_rs_off_{n}", F.lit(0)) + F.col(f"_rs_in_{n}") for n in values}).select(*df.columns, *values)
