"""Tagged change sets: all that a posting changes, from one read, written once (CHG-8, CHG-15).

A posting job makes several kinds of rows of every input line: product deltas, batch deltas, audit rows, status changes, rejects.
``tagged`` turns a line into one row per kind with ``explode``, so the input is read once; a row holds its kind's struct and
nulls for the others.  ``post`` writes the set into a folder of the posting's own, partitioned by kind, so a retry of the posting
replaces its own output and nothing else; a task holds one open file per kind, so its rows aren't sorted by kind.  The shuffle files behind a set are
removed when it is written, so they don't lie beside those of what reads it.  ``rows_of`` reads one kind back; other kinds' files aren't opened.

``add_to_stock`` and ``add_to_batches`` apply deltas to a snapshot: they are summed by key before they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.upsert import upsert
from retailkit.session import settings

KIND = "kind"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
KINDS = 16              # more kinds than any set has
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tagged(lines: DataFrame, kinds: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """(kind, one struct column per kind): for each line a row per kind whose condition (first of the pair) holds."""
    typed = {k: F.struct(*cols) for k, (_, cols) in kinds.items()}
    made = lines.select(*[F.when(cond, typed[k]).alias(k) for k, (cond, _) in kinds.items()])
    type_of = {f.name: f.dataType for f in made.schema.fields}
    one = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias(KIND), *[(F.col(o) if o == k else F.lit(None).cast(type_of[o])).alias(o) for o in kinds])) for k in kinds]
    return made.select(F.explode(F.array(*one)).alias("r")).filter("r IS NOT NULL").select("r.*")


def post(changes: DataFrame, folder: str) -> None:
    """Write a posting's change set; a retry replaces it."""
    spark = changes.sparkSession
    with settings(spark, {WRITERS: max(int(spark.conf.get(WRITERS)), KINDS), CLEANUP: True}):
        changes.write.mode("overwrite").partitionBy(KIND).parquet(folder, compression="zstd")


def rows_of(spark: SparkSession, changes: DataFrame, folder: str, kind: str) -> DataFrame:
    """The rows of one kind of a written change set with the schema of ``changes``; none if the set has none."""
    return spark.read.schema(changes.schema).parquet(folder).filter(F.col(KIND) == kind).select(f"{kind}.*")


def add_to_stock(products: DataFrame, deltas: DataFrame, missing: int | None = 0) -> DataFrame:
    """Products (barcode, stock, stock_levels, ...) after deltas (barcode, branch_name, units): the total and the branch's entry grow.  A total that
    is NULL counts as ``missing``."""
    by_key = deltas.groupBy("barcode", "branch_name").agg(F.sum("units").alias("units"))
    by_code = by_key.groupBy("barcode").agg(F.sum("units").alias("_units"), F.map_from_entries(F.collect_list(F.struct("branch_name", "units"))).alias("_delta"))
    j = products.join(by_code, "barcode", "left")
    levels = F.when(F.col("_units").isNotNull(), X.map_add("stock_levels", "_delta")).otherwise(F.col("stock_levels").cast("map<string,bigint>"))
    return (j.withColumn("stock", F.when(F.col("_units").isNotNull(), F.coalesce("stock", F.lit(missing).cast("long")) + F.col("_units")).otherwise(F.col("stock")).cast("long"))
            .withColumn("stock_levels", levels).drop("_units", "_delta").select(*products.columns))


def add_to_batches(batches: DataFrame, deltas: DataFrame) -> DataFrame:
    """Batches after deltas (product_barcode, batch_number, branch_id, expiry_date, units): quantities add up, a new key is a new batch;
    an existing batch keeps its expiry date."""
    keys = ["product_barcode", "batch_number", "branch_id"]
    t = batches.select(*keys, "expiry_date", "quantity", "quantity_available", "quantity_received")
    d = deltas.groupBy(*keys).agg(F.min("expiry_date").alias("expiry_date"), F.sum("units").alias("quantity"))
    d = d.withColumns({"quantity_available": F.col("quantity"), "quantity_received": F.col("quantity")})
    return upsert(t, d, keys, "add", add_cols=("quantity", "quantity_available", "quantity_received"), keep_cols=("expiry_date",)).drop("_action")
