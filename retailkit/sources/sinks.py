"""Sinks: the monthly summary table (SRC-4), appended audit events (SRC-7), export rows (SRC-5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_monthly_summary(summary: DataFrame, path: str) -> None:
    """SRC-4: nightly refresh of the month x branch x product table.

    Partitioned by month with *dynamic* partition overwrite: a refresh that recomputes only the
    latest months replaces those partitions and leaves older months untouched (the reference's
    suggested incremental refresh instead of rebuilding the whole view)."""
    (summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))


# -- SRC-4, incremental: only months whose rows changed are built again -------------------------
#
# <path>/data           the summary, partitioned by month
# <path>/marks/<n>      after refresh n: month, rows and an order-free hash of the source rows, and whether it was built then

def month_marks(rows: DataFrame, month: Column) -> DataFrame:
    """(month, n, h): number and order-free hash of every month's source rows; sums are combined before the shuffle."""
    marked = rows.withColumn("_month", month)
    h = F.xxhash64(*[c for c in rows.columns]).cast("decimal(38,0)")
    return marked.groupBy(F.col("_month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).filter(F.col("month").isNotNull())


def refresh_months(rows: DataFrame, month: Column, build: Callable[[DataFrame], DataFrame], path: str, refresh: int) -> None:
    """Refresh number ``refresh`` (1, 2, ...): build the months whose marks differ from those of the refresh before, and replace these
    partitions only.  ``build`` makes the summary (with a column month) from source rows.

    Data is written before marks, and a retry of the same refresh compares with the same earlier marks, so it builds the
    same months again.  Months that have lost all rows leave the marks, and readers go by the marks.
    """
    spark = rows.sparkSession
    now = month_marks(rows, month)
    if refresh > 1:
        old = spark.read.parquet(f"{path}/marks/{refresh - 1}").select("month", F.col("n").alias("_n"), F.col("h").alias("_h"))
        now = now.join(old, "month", "left").withColumn("built", ~(F.col("n").eqNullSafe(F.col("_n")) & F.col("h").eqNullSafe(F.col("_h")))).drop("_n", "_h")
    else:
        now = now.withColumn("built", F.lit(True))
    pending = f"{path}/pending/{refresh}"
    now.coalesce(1).write.mode("overwrite").parquet(pending)            # a row per month
    now = spark.read.parquet(pending)
    stale = now.filter("built").select(F.col("month").alias("_month"))
    source = rows.withColumn("_month", month).join(stale, "_month", "left_semi").drop("_month")
    write_monthly_summary(build(source), f"{path}/data")
    now.write.mode("overwrite").parquet(f"{path}/marks/{refresh}")


def changed_months(spark: SparkSession, path: str, refresh: int) -> DataFrame:
    """(month): the months that refresh number ``refresh`` built."""
    return spark.read.parquet(f"{path}/marks/{refresh}").filter("built").select("month")


def read_months(spark: SparkSession, path: str, refresh: int) -> DataFrame:
    """The summary as of refresh number ``refresh``, the last one."""
    valid = spark.read.parquet(f"{path}/marks/{refresh}").select("month")
    return spark.read.parquet(f"{path}/data").join(valid, "month", "left_semi")


def append_audit(rows: DataFrame, path: str) -> None:
    """SRC-7: audit rows are only ever appended."""
    rows.write.mode("append").parquet(path)


def write_export(rows: DataFrame, path: str) -> None:
    """SRC-5: {dataElement, period, orgUnit, value} rows as JSON lines (no HTTP push)."""
    rows.write.mode("overwrite").json(path)
