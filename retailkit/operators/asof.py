"""As-of join: the last value at or before a time, per key (CHG-13/14).

Both sides become one stream per key, values before questions at equal times.  The last value is carried in two levels, like
``running``: inside a bucket of time by a window over (key, bucket); from earlier buckets by a window over one row per
(key, bucket), its last value.  So a key with a third of all rows is spread over its buckets, and no pair of a question and
all its earlier values is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(questions: DataFrame, values: DataFrame, keys: list[str], at: str, time: str, order: list[str], value: str, out: str, bucket,
          heavy: DataFrame | None | str = "all") -> DataFrame:
    """``questions`` with ``out``: the ``value`` of the last row of ``values`` (by ``time``, then ``order``) at or before ``at``.

    ``bucket`` makes a column's bucket from its name, non-decreasing in time.  Without an earlier value ``out`` is NULL; a question
    without a time has none.  Values without a time are left out.  ``heavy``: the keys that are cut into buckets (``running.heavy_keys``;
    None: no key is), "all" cuts every key.
    """
    names = questions.columns
    q = questions.select(*keys, F.col(at).alias("_time"), F.lit(1).alias("_ask"), F.struct(*names).alias("_q"),
                         F.lit(None).cast(values.schema[value].dataType).alias("_v"), *[F.lit(None).cast(values.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)])
    v = values.filter(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_time"), F.lit(0).alias("_ask"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"),
                                                      F.col(value).alias("_v"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    asked = q.filter(F.col("_time").isNotNull())
    rows = v.unionByName(asked)
    along = [F.col("_time"), F.col("_ask"), *[F.col(f"_o{i}") for i in range(len(order))]]
    held: Column = F.when(F.col("_ask") == 0, F.struct("_v"))                 # a value may be NULL itself
    whole = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unasked = questions.filter(F.col(at).isNull()).withColumn(out, F.lit(None).cast(values.schema[value].dataType))
    if heavy is None:
        found = rows.withColumn("_in", F.last(held, ignorenulls=True).over(whole)).filter(F.col("_ask") == 1)
        return found.select("_q.*", F.col("_in")["_v"].alias(out)).unionByName(unasked)
    if not isinstance(heavy, str):                                           # the other keys as one group each, the heavy ones on their own
        hk = F.broadcast(heavy)
        light = as_of(questions.join(hk, keys, "left_anti"), values.join(hk, keys, "left_anti"), keys, at, time, order, value, out, bucket, None)
        return light.unionByName(as_of(questions.join(hk, keys, "left_semi"), values.join(hk, keys, "left_semi"), keys, at, time, order, value, out, bucket))
    rows = rows.withColumn("_bucket", bucket("_time"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.last(held, ignorenulls=True).over(inside))
    ends = v.withColumn("_bucket", bucket("_time")).groupBy(*keys, "_bucket").agg(F.max_by(F.struct("_v"), F.struct(*along)).alias("_end"))
    spots = ends.unionByName(asked.withColumn("_bucket", bucket("_time")).select(*keys, "_bucket").distinct()
                             .withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    spots = spots.groupBy(*keys, "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_was"))
    found = rows.filter(F.col("_ask") == 1).join(carried, [*keys, "_bucket"], "left")
    answered = found.select("_q.*", F.coalesce("_in", "_was")["_v"].alias(out))
    return answered.unionByName(unasked)
