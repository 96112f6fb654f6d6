"""Dense global numbering without an unpartitioned window (WIN-8).

``row_number().over(Window.orderBy(x))`` moves the whole table into one
task.  Instead: range-partition on the ordering column, count rows per
partition (one small row per partition), turn the counts into offsets with
a window over those few rows, and number rows inside each partition.
The partitioned frame is checkpointed (reliable storage) so both passes
see the same partition ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order_col: str, out: str, partitions: int | None = None) -> DataFrame:
    from retailkit.session import ensure_checkpoint_dir
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    # Range bounds come from a sample; materialise the partition ids once in the
    # shared checkpoint folder so the count pass and the numbering pass agree
    # (and a lost executor does not re-sample different bounds).
    r = df.repartitionByRange(n, F.col(order_col)).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(order_col)
    numbered = r.withColumn("_rn", F.row_number().over(w))
    return (numbered.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long")).drop("_pid", "_rn", "_off"))
