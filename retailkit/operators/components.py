"""Connected components by alternating stars.

Every round points each node's larger neighbours at its smallest neighbour (large star), then its smaller ones at theirs (small star), until
nothing moves; the number of rounds grows with the logarithm of the longest chain.  Neighbourhoods are never collected: a round is two
minima by node and two joins, so a node with very many neighbours is a skewed join key, which AQE splits, and no task's group.
Rounds are cut into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.session import ensure_checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected ``edges`` (a, b): ``root`` is the smallest node of the component.  Edges with a null end are left out; a node whose
    only edge is to itself is a component.  No edges: no rows."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e = e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()       # a > b from here on
    was = None
    while (now := _state(e)) != was:
        was = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct().checkpoint()
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("root"))
