"""All-or-nothing acceptance of baskets in order, in parallel rounds (CHG-10).

A basket (a transfer request) takes all its lines or none; what it takes is gone for the later baskets of its key (the source).  So a
basket's answer hangs on earlier ones that share an item, and ``fold.sequential_baskets`` visits a key's baskets one by one, a key
to a task.  Here every line has two bounds of what earlier baskets used of its item: the least (accepted ones, and undecided lines that
give back) and the most (accepted ones, and undecided lines that take).  A basket whose lines all fit at the most is surely accepted, one
with a line that doesn't fit at the least is surely refused; both are exact.  Rounds repeat this on what is undecided.  The first
undecided basket of a key has equal bounds, so each round settles some, and in practice nearly all: an item is either far from
used up, or used up.  The bounds are running sums over (key, item), two-level for items with many rows, so neither a key nor an item with a third of
the rows is one task's.  A round moves its undecided lines twice, by item and by basket.  What many rounds leave, because requests depend on each other in long chains, goes through the sequential
form with the use that is already sure taken off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailkit.operators.fold import sequential_baskets
from retailkit.operators.running import heavy_keys, running_sums
from retailkit.session import ensure_checkpoint_dir

ROUNDS = 24


def settle_baskets(lines: DataFrame, key: str, basket: list[str], time: str, item: str, qty: str, available: str, bucket,
                   carry: tuple[str, ...] = (), rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """One row per (key, basket, item): time, qty (summed), available, lines, carry (smallest), accepted, used_before.

    Baskets of a key come in the order of their earliest ``time`` (NULL first), then of ``basket``.  ``bucket`` makes a bucket of the running sums
    from a time column, not falling in time; ``available`` is the item's stock for the key before all baskets, NULL for an unknown item, which
    refuses its basket.  ``used_before`` is what earlier accepted baskets took of the item.  ``key`` and ``item`` have no nulls; a null
    ``qty`` counts as 0; a negative one gives back; null basket columns are a basket of their own.  No lines: no rows.  ``report``, if
    given, gets the number of undecided baskets after every round.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    ids = [key, *basket]
    whole = Window.partitionBy(*ids)                                # a basket is a request: its lines are few
    dealt = lines.select(*dict.fromkeys([*ids, item, time, qty, available, *carry])).repartition(*ids)
    one = dealt.groupBy(*ids, item).agg(F.coalesce(F.sum(qty), F.lit(0)).cast("long").alias(qty), F.max(available).cast("long").alias(available),
                                        F.count(F.lit(1)).alias("lines"), F.min(time).alias(time), *[F.min(c).alias(c) for c in carry])
    one = one.withColumn(time, F.min(time).over(whole)).checkpoint()
    order, by_item, day = [F.col(time), *[F.col(c) for c in basket]], [key, item], bucket(time)
    heavy = heavy_keys(one, by_item)
    q, ok = F.col(qty), F.col("_ok")
    state = one.withColumns({"_base": F.lit(0).cast("long"), "_ok": F.lit(None).cast("boolean")})

    def undecided(s: DataFrame) -> DataFrame:
        sums = running_sums(s.filter(ok.isNull() | ok), by_item, order, {
            "_sure": F.when(ok, q), "_least": F.when(ok.isNull(), F.least(q, F.lit(0))), "_most": F.when(ok.isNull(), F.greatest(q, F.lit(0)))}, day, inclusive=False, heavy=heavy)
        return sums.filter(ok.isNull()).withColumn("_base", F.col("_base") + F.col("_sure"))

    decided, cols = [], [*one.columns, "accepted"]
    for _ in range(rounds):
        u = undecided(state)
        fits = F.coalesce(F.col("_base") + F.col("_most") + q <= F.col(available), F.lit(False))
        fails = F.coalesce(F.col("_base") + F.col("_least") + q > F.col(available), F.lit(True))
        u = u.withColumns({"_all": F.bool_and(fits).over(whole), "_any": F.bool_or(fails).over(whole)})
        u = u.withColumn("_ok", F.when(F.col("_any"), F.lit(False)).when(F.col("_all"), F.lit(True)))
        state = u.drop("_sure", "_least", "_most", "_all", "_any").checkpoint()
        decided.append(state.filter(ok.isNotNull()).withColumnRenamed("_ok", "accepted").select(*cols))
        left = state.filter(ok.isNull())
        if report is not None:
            report.append(left.select(*ids).distinct().count())
        if left.isEmpty():
            break
    else:
        rest = undecided(state).withColumn("_left", F.col(available) - F.col("_base"))
        rest = rest.withColumn("_basket", F.to_json(F.struct(*basket), {"ignoreNullFields": "false"}))
        settled = sequential_baskets(rest, key, "_basket", [time, *basket], item, qty, "_left").select(key, "_basket", "accepted")
        decided.append(rest.join(settled, [key, "_basket"]).select(*cols))
    final = reduce(DataFrame.unionByName, decided)
    return running_sums(final, by_item, order, {"used_before": F.when(F.col("accepted"), q)}, day, inclusive=False, heavy=heavy)
