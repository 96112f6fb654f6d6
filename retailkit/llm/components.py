"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.llm.common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node of the component of every node in ``edges`` (a, b); nulls and loops are ignored.

    Each round links all larger neighbours of a node to the smallest node around (large star), then all smaller
    ones (small star), until every edge leads to a component's smallest node.  Sums are combined before the
    shuffle; every round is written to the shared folder.
    """
    e = cut(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = cut(small.filter(F.col("u") != F.col("v")).distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.unionByName(pairs.select(F.col("comp").alias("node"), "comp").distinct())
