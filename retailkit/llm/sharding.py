"""Operator 5: sharding by extendible hashing.

A row's key hashes to 60 bits of MD5.  The directory is indexed by the first bits of the hash; a bucket
splits on its next bit only while its bytes exceed the limit.  So the bucket of a row is the shortest prefix
of its hash under which no more than ``limit`` bytes stand.  Spark finds the buckets of LEVELS of bits at once: bytes are
summed by cell (the bits up to the level's last), each cell adds to its prefix at every depth of the level, and a cell's bucket
is the shallowest of its prefixes that fits.  Only the rows of cells that are still too large go on to the next level, up
to all HASH_BITS.  Every sum is combined before the shuffle.

Cells that exceed the limit with all bits (repeated keys, huge rows) can't be split by more.  Their
rows overflow into chains: a row of more than half the limit is a shard of its own (the only way a shard
may exceed the limit: one row that is larger), the others fill shards by their running bytes in steps of
half the limit.  The running sum is two-level, so a key with a third of all rows isn't one task's.

Result: doc_id, n_bytes, depth (bits of the bucket), bucket (the prefix as a number), chain (0 unless the
cell overflowed: then 1, 2, ... for filled shards; a lone row has the negative of its rank).

Inputs: null text has 0 bytes; a null key is the key "".  Repeated rows are rows of their own.  An empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailkit.llm.common import cut, read_table

HASH_BITS = 60
LEVELS = (24, 36, 48, HASH_BITS)          # the last bit of each level
LIMIT = 4 << 20


def hash60(key) -> F.col:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, first: int, last: int) -> DataFrame:
    """(cell, leaf_depth, leaf) for every cell of ``last`` bits of ``sizes`` (cell, n_bytes) that fits ``limit``, by its shallowest
    fitting prefix of ``first`` bits or more; prefixes of fewer bits don't fit."""
    cells = sizes.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes"))
    depths = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")
    at_depth = cells.select("cell", "n_bytes", depths).withColumn("bucket", F.expr(f"shiftright(cell, {last} - depth)"))
    fits = (at_depth.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("n_bytes")).filter(F.col("n_bytes") <= limit).select("depth", "bucket"))
    # only prefixes whose parent is too large are in the directory
    parents = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    leaves = fits.join(parents, ["depth", "bucket"], "left_anti")
    return at_depth.select("cell", "depth", "bucket").join(leaves, ["depth", "bucket"]).select("cell", F.col("depth").alias("leaf_depth"), F.col("bucket").alias("leaf"))


def chained(rows: DataFrame, limit: int) -> DataFrame:
    """Chains of the rows (cell, part, n_bytes, ...) of overflowing cells; ``part`` cuts a cell's rows into bounded parts."""
    half = limit // 2
    order = [F.col("doc_id"), F.col("n_bytes"), F.col("row_id")]
    rows = rows.withColumn("lone", F.col("n_bytes") > half)
    inside = Window.partitionBy("cell", "lone", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("cell", "lone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("cell", "lone", "part").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
    parts = parts.select("cell", "lone", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    run = rows.withColumn("b", F.sum("n_bytes").over(inside)).withColumn("r", F.count("*").over(inside)).join(parts, ["cell", "lone", "part"])
    upto = F.greatest(F.col("b0") + F.col("b"), F.lit(1))
    return run.withColumn("chain", F.when(F.col("lone"), -(F.col("r0") + F.col("r"))).otherwise(F.floor((upto - 1) / half) + 1).cast("long"))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = cut(rows.withColumn("hash", hash60(F.col("doc_id"))).withColumn("row_id", F.monotonically_increasing_id()))
    out, first = None, 0
    for last in LEVELS:
        rows = rows.withColumn("cell", F.shiftright("hash", HASH_BITS - last))
        found = rows.join(directory(rows, limit, first, last), "cell", "left")
        plain = found.filter(F.col("leaf").isNotNull()).select("doc_id", "n_bytes", F.col("leaf_depth").alias("depth"), F.col("leaf").alias("bucket"), F.lit(0).cast("long").alias("chain"))
        out = plain if out is None else out.unionByName(plain)
        rows = cut(found.filter(F.col("leaf").isNull()).select(*rows.columns))
        if rows.isEmpty():
            return out
        first = last + 1
    over = chained(rows.withColumn("part", F.shiftright("row_id", 10)), limit)
    return out.unionByName(over.select("doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("cell").alias("bucket"), "chain"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


# DuckDB twin; a cell that no prefix fits (never so for distinct keys and rows under the limit) would lack rows here.
OP5_SQL = f"""
WITH r AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) >> {HASH_BITS - LEVELS[0]} AS cell FROM documents),
     d AS (SELECT CAST(range AS INTEGER) AS depth FROM range({LEVELS[0] + 1})),
     s AS (SELECT depth, cell >> ({LEVELS[0]} - depth) AS bucket, sum(n_bytes) AS b FROM r, d GROUP BY 1, 2),
     c AS (SELECT r.doc_id, r.n_bytes, s.depth, s.bucket, row_number() OVER (PARTITION BY r.cell, r.doc_id ORDER BY s.depth) AS k
           FROM r JOIN s ON s.b <= {LIMIT} AND r.cell >> ({LEVELS[0]} - s.depth) = s.bucket)
SELECT doc_id, n_bytes, depth, CAST(bucket AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS chain FROM c WHERE k = 1
"""
