"""Sequential accept/reject folds (WIN-11, WIN-12).

"Refuse a credit sale when balance + amount > limit; refused sales do not
count" is path dependent: whether a sale is accepted depends on which
earlier sales were.  There is no associative summary of such a prefix, so
the events of one key must be visited in order once.  We do that without
gathering a key's events anywhere: rows are hash-partitioned by key,
sorted within partitions, and streamed through ``mapInPandas`` in Arrow
batches while a small dict carries the running balance of each key.
Memory per task is O(keys in the partition), not O(events of a key).
A lost executor simply recomputes the partition: the order is total, so
the replay gives the same answer.
"""

from __future__ import annotations

import sys
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T


# The fold runs in Python workers; ship this module by value so workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sequential_accept(events: DataFrame, key: str, order: list[str], amount: str, checked: str,
                      start: str, limit: str, partitions: int | None = None) -> DataFrame:
    """Add ``accepted`` (bool) and ``balance_after`` (decimal(18,2)).

    ``checked`` rows (sales) are accepted iff balance + amount <= limit (a NULL
    limit counts as 0); unchecked rows (payments, signed amounts) always apply.
    ``start`` is the key's opening balance (taken from its first row).
    """
    out_schema = T.StructType(events.schema.fields + [
        T.StructField("accepted", T.BooleanType()), T.StructField("balance_after", T.DecimalType(18, 2))])
    cents = Decimal("0.01")

    def fold(batches):
        state: dict = {}
        for pdf in batches:
            acc, bal = [], []
            for k, a, chk, s0, lim in zip(pdf[key], pdf[amount], pdf[checked], pdf[start], pdf[limit]):
                b = state.get(k)
                if b is None:
                    b = Decimal(s0) if s0 is not None else Decimal(0)
                a = Decimal(a) if a is not None else Decimal(0)
                if chk:
                    ok = b + a <= (Decimal(lim) if lim is not None else Decimal(0))
                else:
                    ok = True
                if ok:
                    b = b + a
                state[k] = b
                acc.append(ok)
                bal.append(b.quantize(cents))
            yield pdf.assign(accepted=acc, balance_after=bal)

    dealt = events.repartition(partitions, key) if partitions else events.repartition(key)     # without a number Spark may coalesce
    ordered = dealt.sortWithinPartitions(key, *order)
    return ordered.mapInPandas(fold, out_schema)


def sequential_baskets(lines: DataFrame, key: str, basket: str, order: list[str], item: str, qty: str,
                       available: str, partitions: int | None = None) -> DataFrame:
    """All-or-nothing acceptance of baskets in order (CHG-10 transfers, WIN-12 coupled keys).

    A basket (e.g. a transfer) is a group of lines sharing ``key`` (its source) and ``basket``; it is
    accepted only if every item fits: used[item] + Σ qty <= available, where ``used`` counts the
    items of baskets accepted earlier from the same source.  Lines are hash-partitioned by ``key``,
    sorted by (key, order..., basket) and streamed; only the current basket's lines and one
    counter per (key, item) are held in memory -- never a key's whole history.

    Returns one row per basket: key, basket, accepted, lines.
    """
    out_schema = T.StructType([lines.schema[key], lines.schema[basket],
                               T.StructField("accepted", T.BooleanType()), T.StructField("lines", T.LongType())])

    def fold(batches):
        import pandas as pd
        used: dict = {}
        cur = None
        need: dict = {}
        avail: dict = {}
        nlines = 0
        rows = []

        def close():
            if cur is None:
                return
            ok = all(used.get((cur[0], i), 0) + q <= (avail[i] if avail[i] is not None else 0)
                     for i, q in need.items())
            if ok:
                for i, q in need.items():
                    used[(cur[0], i)] = used.get((cur[0], i), 0) + q
            rows.append((cur[0], cur[1], ok, nlines))

        for pdf in batches:
            for k, b, it, q, av in zip(pdf[key], pdf[basket], pdf[item], pdf[qty], pdf[available]):
                if (k, b) != cur:
                    close()
                    cur, need, avail, nlines = (k, b), {}, {}, 0
                need[it] = need.get(it, 0) + (int(q) if q is not None else 0)
                avail[it] = None if av is None else int(av)
                nlines += 1
            if rows:
                yield pd.DataFrame(rows, columns=[key, basket, "accepted", "lines"])
                rows = []
        close()
        if rows:
            yield pd.DataFrame(rows, columns=[key, basket, "accepted", "lines"])

    dealt = lines.repartition(partitions, key) if partitions else lines.repartition(key)
    ordered = dealt.sortWithinPartitions(key, *order, basket)
    return ordered.mapInPandas(fold, out_schema)
