"""Chains of renames by pointer doubling (CHG-30).

A batch of edits renames codes one after the other: an edit at ``seq`` moves all that stands under ``old`` to ``new``.  So what stood
under a code at first follows the code's first edit, then the first later edit of where it has come to, and so on.  Edits are
the nodes: each points to the first edit of its ``new`` with a higher ``seq`` (a running minimum along the code's arrivals and
departures, two-level, so that a much renamed code isn't one task's), and pointers double in length every round: a
chain of n edits takes log2 n joins.  Sequence numbers rise along a chain, so a cycle of names ends where the edits end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.operators.running import running_agg
from retailkit.session import ensure_checkpoint_dir

BUCKET = 4096           # sequence numbers of a bucket of the running minimum


def last_names(renames: DataFrame) -> DataFrame:
    """(old, last, hops): for each renamed code, where what stood under it at first stands after all edits (old, new, seq).

    ``seq`` is a unique whole number.  Edits with a null code or that rename a code to itself do nothing.
    """
    ensure_checkpoint_dir(renames.sparkSession)
    e = renames.filter(F.col("old") != F.col("new")).select("old", "new", F.col("seq").cast("long").alias("seq"))
    visits = e.select(F.col("old").alias("code"), "seq", F.col("seq").alias("leaves")).unionByName(
        e.select(F.col("new").alias("code"), "seq", F.lit(None).cast("long").alias("leaves")))
    ahead = running_agg(visits, ["code"], [F.col("seq").desc()], "leaves", "then", bucket=-F.floor(F.col("seq") / BUCKET), inclusive=False, agg="min")
    then = ahead.filter(F.col("leaves").isNull()).select("seq", "then")
    at = e.join(then, "seq").select("seq", "old", F.col("new").alias("last"), "then", F.lit(1).cast("long").alias("hops")).checkpoint()
    while not at.filter(F.col("then").isNotNull()).isEmpty():
        onward = at.select(F.col("seq").alias("then"), F.col("last").alias("_last"), F.col("then").alias("_then"), F.col("hops").alias("_hops"))
        at = at.join(onward, "then", "left").select(
            "seq", "old", F.coalesce("_last", "last").alias("last"), F.col("_then").alias("then"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")).checkpoint()
    return at.groupBy("old").agg(F.min_by("last", "seq").alias("last"), F.min_by("hops", "seq").alias("hops"))


def rename_all(rows: DataFrame, code: str, renames: DataFrame) -> DataFrame:
    """``rows`` with ``code`` after all edits."""
    names = last_names(renames).select(F.col("old").alias(code), F.col("last").alias("_last"))
    return rows.join(names, code, "left").withColumn(code, F.coalesce("_last", code)).drop("_last").select(*rows.columns)
