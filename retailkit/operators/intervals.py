"""Interval joins without quadratic candidate sets (JN-5, WIN-3).

Joining points to intervals on an equality key plus a range predicate makes
Spark compare every point of a key with every interval of that key.  For a
hot key (a cashier with a third of the sales, a product with thousands of
batches) that is quadratic.  Both joins here add a *bucket* to the equality
key so a point meets only the intervals that cover its bucket:

* ``points_in_intervals``: each closed interval is exploded into the day
  buckets it spans; open-ended intervals (end NULL) are joined on the key
  alone -- the data model allows few open intervals per key (one open shift
  per user), so that side stays small.
* ``overlap_amounts``: numeric intervals [lo, hi) on two sides are
  exploded into fixed-width buckets; each overlapping pair is emitted once,
  in the bucket holding the start of the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_DAYS = 31      # longer intervals are not cut into days


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, ts: str,
                        start: str, end: str) -> DataFrame:
    """Inner pairs with ``p.key = i.key AND ts >= start AND (end IS NULL OR ts <= end)``.

    ``points`` and ``intervals`` must not share column names other than ``key``.
    """
    p = points.withColumn("_day", F.to_date(ts))
    short = F.coalesce(F.datediff(F.to_date(end), F.to_date(start)) <= MAX_DAYS, F.lit(False))
    closed = intervals.filter(short)
    closed = closed.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    a = p.join(closed, [key, "_day"], "inner").filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end)))
    # open and very long intervals are few: they meet the key's points without a day, so none is exploded without bound
    opened = intervals.filter(~short)
    b = p.join(opened, [key], "inner").filter((F.col(ts) >= F.col(start)) & F.coalesce(F.col(ts) <= F.col(end), F.col(end).isNull()))
    return a.drop("_day").unionByName(b.drop("_day"))


def overlap_amounts(left: DataFrame, right: DataFrame, key: str, l_lo: str, l_hi: str, r_lo: str, r_hi: str,
                    width: int | str = "auto") -> DataFrame:
    """Pairs of overlapping [lo, hi) intervals with ``overlap`` = their shared length.

    ``width="auto"`` sizes the buckets per key as the mean interval length over both sides (a partial
    aggregate per key), so each bucket holds O(1) intervals of each side whatever the unit scale: the
    exploded rows stay linear in (total length / width + intervals) and the candidate pairs per bucket
    stay small.  A fixed integer width applies to every key.
    """
    if width == "auto":
        lens = (left.select(key, (F.col(l_hi) - F.col(l_lo)).alias("_len"))
                .unionByName(right.select(key, (F.col(r_hi) - F.col(r_lo)).alias("_len"))))
        widths = lens.filter(F.col("_len") > 0).groupBy(key).agg(
            F.greatest(F.lit(1), F.ceil(F.avg("_len"))).cast("long").alias("_w"))
        left = left.join(widths, key, "inner")
        right = right.join(widths.withColumnRenamed("_w", "_wr"), key, "inner")
        lw, rw = F.col("_w"), F.col("_wr")
    else:
        lw = rw = F.lit(int(width))

    def bucketed(df, lo, hi, w):
        first = F.floor(F.col(lo) / w)
        last = F.floor((F.col(hi) - 1) / w)
        return df.filter(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(first, last)))

    l = bucketed(left, l_lo, l_hi, lw)
    r = bucketed(right, r_lo, r_hi, rw)
    j = l.join(r, [key, "_b"], "inner")
    lo = F.greatest(F.col(l_lo), F.col(r_lo))
    hi = F.least(F.col(l_hi), F.col(r_hi))
    j = j.filter((hi > lo) & (F.floor(lo / lw) == F.col("_b")))
    return j.withColumn("overlap", hi - lo).drop("_b", "_w", "_wr")
