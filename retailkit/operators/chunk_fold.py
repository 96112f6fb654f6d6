"""Accept/reject folds of keys with very many rows, by validity intervals (WIN-11, WIN-12).

``fold.sequential_accept`` visits a key's events in one task.  Here a key of more than ``chunk`` rows is cut along the
order into chunks of that many rows, which are folded in parallel:

1. Every chunk is folded from a guessed opening balance.  Besides the change of the balance, the fold returns the interval
   of openings for which each of its decisions comes out the same: an accepted row bounds it from above (opening <= limit -
   what the chunk had accepted before - amount), a refused one from below.
2. The chunks' summaries, one small row each, are chained by key: a chunk whose opening lies in its interval is right,
   whatever was guessed.  Behind a chunk that isn't, openings are better guesses.
3. Chunks that were not right are folded again from their new opening, until all are right or ``rounds`` are used up.
4. A key that has wrong chunks even then (its balance keeps touching the limit, so every decision hangs on the ones before) is
   folded in one stream from its first wrong chunk on, whose opening is known.
5. All openings known, one more pass over the chunks makes the decisions.

Guesses: an unrefused balance, pushed down by as much as it has passed the limit before (what refusing would have done
if amounts were small).  Returns and other unchecked rows always apply, as in the plain fold.  Amounts, limits and openings are
sums of money with two decimal places and are counted in cents.

Only summaries are shuffled by key, only chunks by (key, chunk); a task holds one balance.  Keys of at most ``chunk`` rows go
through the plain fold.  Both ways give the same decisions (tested against the loop).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.operators.fold import sequential_accept
from retailkit.operators.running import running_sum
from retailkit.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK, ROUNDS = 100_000, 4
SUMMARY = "_chunk long, _rows long, _lo long, _hi long, _delta long"


def _cents(c: str) -> Column:
    return F.coalesce((F.col(c).cast("decimal(18,2)") * 100).cast("long"), F.lit(0))


def _typed(rows: DataFrame, key: str, fields: str) -> T.StructType:
    return T.StructType([T.StructField("_key", rows.schema[key].dataType)] + T._parse_datatype_string(fields).fields)


def _summaries(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(_key, SUMMARY) of every chunk of ``rows``, folded from ``_open``."""
    def fold(batches):
        import pandas as pd
        at, n, opening, total, lo, hi = None, 0, 0, 0, None, None
        out: list[tuple] = []
        for b in batches:
            for k, c, o, a, checked, limit in zip(b["_key"], b["_chunk"], b["_open"], b["_amount"], b["_checked"], b["_limit"]):
                if (k, c) != at:
                    if at is not None:
                        out.append((*at, n, lo, hi, total))
                    at, n, opening, total, lo, hi = (k, c), 0, int(o), 0, None, None
                n += 1
                a = int(a)
                if checked:
                    edge = int(limit) - total - a                 # the highest opening that accepts this row
                    if opening > edge:
                        lo = edge if lo is None or edge > lo else lo
                        continue
                    hi = edge if hi is None or edge < hi else hi
                total += a
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if at is not None:
            yield pd.DataFrame([(*at, n, lo, hi, total)], columns=names).astype({"_lo": "Int64", "_hi": "Int64"})

    schema = _typed(rows, key, SUMMARY)
    names = schema.names
    dealt = rows.select(F.col(key).alias("_key"), "_chunk", "_open", "_amount", "_checked", "_limit", *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    ordered = dealt.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", *[f"_o{i}" for i in range(len(order))])
    return ordered.mapInPandas(fold, schema)


def _chained(summaries: DataFrame) -> DataFrame:
    """(_key, _chunk, _rows, _open, _valid): openings by the chunks before; ``_start`` opens a key."""
    def chain(batches):
        import pandas as pd
        at, balance = None, 0
        for b in batches:
            out = []
            for k, c, n, start, lo, hi, delta in zip(b["_key"], b["_chunk"], b["_rows"], b["_start"], b["_lo"], b["_hi"], b["_delta"]):
                if k != at:
                    at, balance = k, int(start)
                out.append((k, c, n, balance, (pd.isna(lo) or balance > lo) and (pd.isna(hi) or balance <= hi)))
                balance += int(delta)
            yield pd.DataFrame(out, columns=names)

    schema = T.StructType([summaries.schema["_key"]] + T._parse_datatype_string("_chunk long, _rows long, _open long, _valid boolean").fields)
    names = schema.names
    return summaries.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInPandas(chain, schema)


def _tails(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(_key, _chunk, _open) of the chunks of ``rows``, in one stream per key from ``_open`` of its first row."""
    def fold(batches):
        import pandas as pd
        at, chunk, balance = None, None, 0
        for b in batches:
            out = []
            for k, c, o, a, checked, limit in zip(b["_key"], b["_chunk"], b["_open"], b["_amount"], b["_checked"], b["_limit"]):
                if k != at:
                    at, chunk, balance = k, None, int(o)
                if c != chunk:
                    chunk = c
                    out.append((k, c, balance))
                if not checked or balance + int(a) <= int(limit):
                    balance += int(a)
            if out:
                yield pd.DataFrame(out, columns=names)

    schema = _typed(rows, key, "_chunk long, _open long")
    names = schema.names
    dealt = rows.select(F.col(key).alias("_key"), "_chunk", "_open", "_amount", "_checked", "_limit", *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    return dealt.repartition("_key").sortWithinPartitions("_key", "_chunk", *[f"_o{i}" for i in range(len(order))]).mapInPandas(fold, schema)


def _decided(rows: DataFrame, fields: list[T.StructField], order: list[str], key: str) -> DataFrame:
    """The events with accepted and balance_after, every chunk from its opening."""
    names = [f.name for f in fields]

    def fold(batches):
        from decimal import Decimal
        at, balance = None, 0
        for b in batches:
            accepted, after = [], []
            for k, c, o, a, checked, limit in zip(b[key], b["_chunk"], b["_open"], b["_amount"], b["_checked"], b["_limit"]):
                if (k, c) != at:
                    at, balance = (k, c), int(o)
                ok = not checked or balance + int(a) <= int(limit)
                balance += int(a) if ok else 0
                accepted.append(ok)
                after.append(Decimal(balance).scaleb(-2))
            yield b[names].assign(accepted=accepted, balance_after=after)

    schema = T.StructType(fields + [T.StructField("accepted", T.BooleanType()), T.StructField("balance_after", T.DecimalType(18, 2))])
    return rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", *order).mapInPandas(fold, schema)


def accept_in_chunks(events: DataFrame, key: str, order: list[str], amount: str, checked: str, start: str, limit: str, bucket: Column,
                     chunk: int = CHUNK, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, int]]:
    """(events with ``accepted`` and ``balance_after``, report) for keys of any size.

    ``bucket`` is non-decreasing along ``order`` within a key (a day).  The report counts chunks, rounds, the rows folded
    again and the rows that had to go through one stream.
    """
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    fields = events.schema.fields
    rows = running_sum(events, [key], [F.col(o) for o in order], F.lit(1), "_at", bucket=bucket)
    rows = rows.withColumn("_chunk", F.floor((F.col("_at") - 1) / chunk).cast("long")).drop("_at")
    rows = rows.withColumns({"_amount": _cents(amount), "_limit": _cents(limit), "_start": _cents(start), "_checked": F.coalesce(F.col(checked), F.lit(False))})
    rows = rows.checkpoint()

    # guesses from the chunks' sums
    sums = rows.groupBy(F.col(key).alias("_key"), "_chunk").agg(F.sum("_amount").alias("s"), F.max("_limit").alias("limit"),
                                                               F.min_by("_start", F.struct(*order)).alias("start"))
    along = Window.partitionBy("_key").orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("start").over(along)
    sums = sums.withColumn("_start", first).withColumn("upto", first + F.sum("s").over(along)).withColumn("was", F.coalesce(F.lag("upto").over(along), first))
    over = F.greatest(F.lit(0), F.max(F.col("upto") - F.col("limit")).over(before))
    guesses = sums.select("_key", "_chunk", "_start", (F.col("was") - F.coalesce(over, F.lit(0))).alias("_open")).checkpoint()
    starts = guesses.select("_key", "_chunk", "_start")

    def opened(openings: DataFrame) -> DataFrame:
        o = openings.select(F.col("_key").alias(key), "_chunk", "_open")
        return rows.join(o, [key, "_chunk"])

    report = {"chunks": guesses.count(), "rounds": 1, "refolded_rows": 0, "streamed_rows": 0}
    known = _summaries(opened(guesses), key, order).checkpoint()
    while True:
        chained = _chained(known.join(starts, ["_key", "_chunk"])).checkpoint()
        wrong = chained.filter("NOT _valid")
        again = wrong.agg(F.sum("_rows")).first()[0]
        if again is None or report["rounds"] > rounds:
            break
        report["rounds"] += 1
        report["refolded_rows"] += again
        anew = _summaries(opened(wrong), key, order)
        known = known.join(wrong.select("_key", "_chunk"), ["_key", "_chunk"], "left_anti").unionByName(anew).checkpoint()
    openings = chained.select("_key", "_chunk", "_open")
    if again is not None:
        since = wrong.groupBy("_key").agg(F.min("_chunk").alias("_since"), F.min_by("_open", "_chunk").alias("_open"))
        s = since.select(F.col("_key").alias(key), "_since", "_open")
        tail = rows.join(s, key).filter(F.col("_chunk") >= F.col("_since"))
        report["streamed_rows"] = chained.join(since.drop("_open"), "_key").filter("_chunk >= _since").agg(F.sum("_rows")).first()[0]
        fixed = _tails(tail, key, order).checkpoint()
        openings = openings.join(fixed.select("_key", "_chunk"), ["_key", "_chunk"], "left_anti").unionByName(fixed)
    return _decided(opened(openings), fields, order, key), report


def accept(events: DataFrame, key: str, order: list[str], amount: str, checked: str, start: str, limit: str, bucket: Column, chunk: int = CHUNK) -> DataFrame:
    """``sequential_accept`` for any distribution of keys: those of more than ``chunk`` rows go through ``accept_in_chunks``."""
    hot = events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select(key)
    ensure_checkpoint_dir(events.sparkSession)
    hot = hot.checkpoint()
    if hot.isEmpty():
        return sequential_accept(events, key, order, amount, checked, start, limit)
    few = sequential_accept(events.join(hot, key, "left_anti"), key, order, amount, checked, start, limit)
    many, _ = accept_in_chunks(events.join(hot, key, "left_semi"), key, order, amount, checked, start, limit, bucket, chunk)
    return few.unionByName(many)
