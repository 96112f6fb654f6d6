"""Structured Streaming versions of the live reports (STR-1..4).

The sources are file streams over the supplied tables; the retail
derivations of ``Retail`` run unchanged on them (stream-static joins to the
dimension tables).  Sinks are parquet folders (and their checkpoints) under
the shared ``spark.checkpoint.dir``; every run takes a fresh sub-folder.

* STR-1 hourly sales per branch: for an endless stream, event-time watermark, tumbling windows and
  ``dropDuplicatesWithinWatermark`` on the receipt number in append mode (``hourly_sales``); a bounded run adds up
  micro-batches, so that no window stays open and no late row is lost (``run_hourly_sales``);
* STR-2 stock deltas: ``foreachBatch`` aggregates each micro-batch's sale
  lines per product and writes them idempotently (one folder per batch id);
  the snapshot is the batch snapshot plus the summed deltas;
* STR-3 credit-limit decisions: ``applyInPandasWithState`` keeps one
  balance per customer (O(1) state per key, rows of a key only within one
  micro-batch);
* STR-4 shift attribution: stream-static interval join of sales to shifts.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import pandas as pd
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from retailkit.functions import exprs as X
from retailkit.operators.intervals import points_in_intervals
from retailkit.session import ensure_checkpoint_dir
from retailkit.sources.adapter import Retail
from retailkit.sources.raw import RAW_SCHEMAS


# Functions of this module run in Python workers; ship them by value so the
# workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream of a table that is one Parquet file or a folder of part files; an absent or empty table is an error."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).count():
        raise FileNotFoundError(f"no files in {path}")
    r = spark.readStream.schema(RAW_SCHEMAS[name])
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fs.getFileStatus(jvm_path).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder for one streaming run, inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex[:12]}"


def _run_to_parquet(df: DataFrame, base: str, mode: str = "append") -> str:
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/out"


# -- STR-1 --------------------------------------------------------------------------------
def hourly_sales(headers: DataFrame, delay: str = "1 day") -> DataFrame:
    # watermarks need an instant type: the wall-clock NTZ value is read in the session zone (UTC)
    s = (headers.filter(F.lower("status") == "completed")
         .withColumn("event_ts", F.col("created_at").cast("timestamp"))
         .withWatermark("event_ts", delay)
         .dropDuplicatesWithinWatermark(["receipt_number"]))
    return _windows(s)


def _windows(s: DataFrame) -> DataFrame:
    g = s.groupBy(F.window("event_ts", "1 hour").alias("w"), X.branch_label().alias("branch")).agg(
        F.count(F.lit(1)).alias("transactions"), X.money_sum("total_amount").alias("revenue"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "branch", "transactions", "revenue")


def run_hourly_sales(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """All windows of a bounded run, whatever the order of its rows.

    A watermark would keep the last day's windows open and drop rows that come late.  Here each micro-batch adds the
    windows of the receipts that no earlier batch has shown, and the result adds the batches up.  A batch's folders
    are overwritten when it is tried again."""
    r = Retail(spark, sf_dir, overrides={"orders": stream_table(spark, sf_dir, "orders", max_files)})
    base = run_dir(spark, "hourly")
    seen = "receipt_number STRING, event_ts TIMESTAMP, batch BIGINT"
    part = "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, branch STRING, transactions BIGINT, revenue DECIMAL(18,2), batch BIGINT"
    empty_schema = {"receipts": seen, "windows": part}

    def written(kind: str, before: int | None = None) -> DataFrame:
        if not _exists(spark, f"{base}/{kind}"):
            return spark.createDataFrame([], empty_schema[kind])
        rows = spark.read.schema(empty_schema[kind]).parquet(f"{base}/{kind}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def apply(batch: DataFrame, batch_id: int):
        s = (batch.filter(F.lower("status") == "completed").withColumn("event_ts", F.col("created_at").cast("timestamp"))
             .dropDuplicates(["receipt_number"]).join(written("receipts", batch_id).select("receipt_number"), "receipt_number", "left_anti")).persist()
        _windows(s).write.mode("overwrite").parquet(f"{base}/windows/batch={batch_id}")
        s.select("receipt_number", "event_ts").write.mode("overwrite").parquet(f"{base}/receipts/batch={batch_id}")
        s.unpersist()

    q = (r.sale_headers().writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return written("windows").groupBy("window_start", "window_end", "branch").agg(
        F.sum("transactions").alias("transactions"), X.money_sum("revenue").alias("revenue"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# -- STR-2 --------------------------------------------------------------------------------
def run_stock_deltas(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    from retailkit.plans import stock as K
    r_stream = Retail(spark, sf_dir, overrides={"orders": stream_table(spark, sf_dir, "orders", max_files)})
    r = Retail(spark, sf_dir)
    products = r.products()
    base = run_dir(spark, "stock")
    sales = r_stream.sales()

    def apply(batch: DataFrame, batch_id: int):
        d = K.sale_deltas(batch, products).groupBy("barcode").agg(F.sum("delta").cast("long").alias("delta"))
        # overwrite of the batch's own folder: a retried batch replaces, never duplicates
        d.write.mode("overwrite").parquet(f"{base}/deltas/batch={batch_id}")

    q = (sales.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = "barcode STRING, delta BIGINT, batch INT"
    deltas = spark.read.schema(schema).parquet(f"{base}/deltas") if _exists(spark, f"{base}/deltas") else spark.createDataFrame([], schema)
    tot = deltas.groupBy("barcode").agg(F.sum("delta").alias("d"))
    return products.join(tot, "barcode", "left").select(
        "barcode", (F.coalesce("stock", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("new_stock"))


# -- STR-3 --------------------------------------------------------------------------------
_DEC = T.DecimalType(18, 2)
CREDIT_OUT = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("sale_id", T.LongType()),
                           T.StructField("accepted", T.BooleanType()), T.StructField("balance_after", _DEC)])
CREDIT_STATE = T.StructType([T.StructField("balance", T.StringType())])


def _credit_fold(key, pdfs, state):
    bal = Decimal(state.get[0]) if state.exists else None
    out = []
    for pdf in pdfs:
        out.append(pdf)
    if not out:
        return
    pdf = pd.concat(out).sort_values(["created_at", "sale_id"], kind="mergesort")
    rows = []
    for sid, amt, start, lim, back in zip(pdf["sale_id"], pdf["total_amount"], pdf["current_balance"], pdf["credit_limit"], pdf["is_return"]):
        if bal is None:
            bal = Decimal(start) if start is not None else Decimal(0)
        a = -Decimal(amt) if back else Decimal(amt)
        ok = back or bal + a <= (Decimal(lim) if lim is not None else Decimal(0))
        if ok:
            bal = bal + a
        rows.append((key[0], int(sid), bool(ok), bal.quantize(Decimal("0.01"))))
    state.update((str(bal),))
    yield pd.DataFrame(rows, columns=["customer_id", "sale_id", "accepted", "balance_after"])


def credit_stream(headers: DataFrame, customers: DataFrame) -> DataFrame:
    s = headers.filter((F.col("status") == "completed") & F.col("customer_id").isNotNull()
                       & (F.col("payment_method") == "credit"))
    c = customers.select(F.col("id").alias("customer_id"), "current_balance", "credit_limit")
    ev = s.join(c, "customer_id", "inner").select("customer_id", F.col("id").alias("sale_id"), "created_at",
                                                   "total_amount", "is_return", "current_balance", "credit_limit")
    return ev.groupBy("customer_id").applyInPandasWithState(
        _credit_fold, CREDIT_OUT, CREDIT_STATE, "append", GroupStateTimeout.NoTimeout)


def run_credit_decisions(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Decisions of a bounded run in event-time order, whatever the order of its files.

    A decision depends on all earlier sales of the customer, so a stream decides only what no late row can precede.
    A bounded run first lands its rows, batch by batch, and decides when the input has ended: one more stream over the landed
    rows, as one micro-batch, so that the state's fold sees each customer's rows once and in time order."""
    r = Retail(spark, sf_dir, overrides={"orders": stream_table(spark, sf_dir, "orders", max_files)})
    base = run_dir(spark, "credit")
    headers = r.sale_headers()
    landed = _run_to_parquet(headers, f"{base}/landed")
    whole = spark.readStream.schema(headers.schema).parquet(landed)
    return spark.read.parquet(_run_to_parquet(credit_stream(whole, Retail(spark, sf_dir).customers()), base))


# -- STR-4 --------------------------------------------------------------------------------
def shift_attribution(sales: DataFrame, shifts: DataFrame) -> DataFrame:
    s = sales.select(F.col("id").alias("sale_id"), "user_id", "created_at", "total_amount")
    sh = shifts.select(F.col("id").alias("shift_id"), "user_id", "start_time", "end_time")
    return points_in_intervals(s, sh, "user_id", "created_at", "start_time", "end_time").select("shift_id", "sale_id")


def run_shift_attribution(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    r_stream = Retail(spark, sf_dir, overrides={"events": stream_table(spark, sf_dir, "events", max_files)})
    shifts = Retail(spark, sf_dir).shifts()
    base = run_dir(spark, "shift")
    return spark.read.parquet(_run_to_parquet(shift_attribution(r_stream.event_sales(), shifts), base))
