"""CHG-8 receipts: tables dealt by product or key give the same rows with fewer shuffles, existing batches keep their date."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from retailkit.operators.changeset import add_to_batches, post, rows_of
from retailkit.plans import jobs_postings as JP
from retailkit.plans import postings as PO
from retailkit.session import settings
from retailkit.sources.adapter import Retail

RAW = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
LINES = ("po_id long, supplier_id long, barcode string, quantity int, received_at timestamp_ntz, branch_id int, branch_name string, "
         "given_number string, given_expiry date, given_quantity int")
BATCHES = "product_barcode string, batch_number string, branch_id int, expiry_date date, quantity int, quantity_available int, quantity_received int"


def table(spark, seed=8):
    rnd = random.Random(seed)
    day = dt.datetime(2000, 2, 27)

    def maybe(x):
        return None if rnd.random() < 0.05 else x
    rows = [(maybe(rnd.choice([97, 100, 12, 13])), maybe(rnd.randint(1, 4)), maybe(rnd.randint(1, 3)), i, float(rnd.randint(1, 9)), maybe(day + dt.timedelta(days=rnd.randint(0, 3))))
            for i in range(300)]
    return Retail(spark, "", {"lineitem": spark.createDataFrame(rows + rows[:20], RAW)})


def rows(df):
    return sorted(map(repr, df.collect()))


def test_dealt_tables_have_the_same_rows(spark):
    r = table(spark)
    code = F.concat(F.when(F.col("l_orderkey") % 97 == 0, "X").otherwise(""), F.col("l_partkey").cast("string"))
    plain = r.purchase_order_lines().withColumn("barcode", F.concat(F.when(F.col("po_id") % 97 == 0, "X").otherwise(""), F.col("barcode")))
    assert rows(r.purchase_order_lines(code, by_code=True)) == rows(r.purchase_order_lines(code)) == rows(plain)
    assert rows(r.batches(by_key=True)) == rows(r.batches()) and r.batches(by_key=True).schema == r.batches().schema


def received(spark):
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 2, 28)
    lines = [(i, rnd.choice([1, 2, 9, None]), rnd.choice(["A", "B", "Q", None]), rnd.randint(1, 9), t0 + dt.timedelta(hours=rnd.randint(0, 60)), rnd.choice([1, 2, None]), "Main",
              rnd.choice([None, "", "LOT", "OLD"]), rnd.choice([None, dt.date(2024, 5, 5), dt.date(2024, 6, 6)]), rnd.choice([None, 0, 3])) for i in range(200)]
    suppliers = spark.createDataFrame([(1, "a bc Ltd"), (2, None)], "id long, name string")
    products = spark.createDataFrame([("A", "Milk", 10), ("B", " x y", None)], "barcode string, name string, stock int")
    batches = spark.createDataFrame([("A", "LOT", 1, dt.date(2024, 5, 5), 3, 2, 3), ("A", "OLD", 1, None, 7, 7, 7), (None, "LOT", 1, None, 1, 1, 1), (None, "LOT", 1, None, 1, 1, 1)], BATCHES)
    return spark.createDataFrame(lines, LINES), suppliers, products, batches


def test_lines_are_dealt_once(spark, monkeypatch):
    lines, *tables = received(spark)
    want = rows(PO.received_lines(lines, *tables))
    heavy = spark.createDataFrame([("A",)], "barcode string")
    for few in (0, PO.FEW):
        monkeypatch.setattr(PO, "FEW", few)
        with settings(spark, {JP.ALL_KEYS: False, "spark.sql.autoBroadcastJoinThreshold": -1}):
            dealt = PO.received_lines(lines.repartition("barcode"), *tables[:2], tables[2].repartition("product_barcode"), None)
            plan = dealt._jdf.queryExecution().executedPlan().toString()
            assert rows(dealt) == want
        assert rows(PO.received_lines(lines, *tables, heavy)) == want
    assert plan.count("Exchange hashpartitioning") == 3, plan              # lines, products, batches


def test_existing_batches_keep_their_date_in_one_join(spark):
    batches = received(spark)[3]
    deltas = spark.createDataFrame([("A", "LOT", 1, dt.date(2020, 1, 1), 4), ("A", "OLD", 1, dt.date(2020, 1, 1), 5), ("A", "NEW", 1, dt.date(2020, 1, 2), 6),
                                    ("A", "NEW", 1, dt.date(2020, 1, 1), 1), (None, "LOT", 1, dt.date(2020, 1, 1), 2)],
                                   "product_barcode string, batch_number string, branch_id int, expiry_date date, units long")
    new = add_to_batches(batches, deltas)
    assert rows(new.select("product_barcode", "batch_number", F.col("expiry_date").cast("string").alias("e"), "quantity", "quantity_available")) == rows(spark.createDataFrame(
        [("A", "LOT", "2024-05-05", 7, 6), ("A", "OLD", None, 12, 12), ("A", "NEW", "2020-01-01", 7, 7), (None, "LOT", None, 1, 1), (None, "LOT", None, 1, 1), (None, "LOT", "2020-01-01", 2, 2)],
        "product_barcode string, batch_number string, e string, quantity int, quantity_available int"))
    assert new._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_shuffle_files_of_a_posting_are_removed(spark, tmp_path):
    lines, *tables = received(spark)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in local.getAllBlocks().mkString("\n").split("\n") if x.startswith("shuffle_")}
    changes = PO.receive_orders(lines, *tables)
    before = shuffles()
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    post(changes, str(tmp_path / "set"))
    assert not shuffles() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was
    assert rows_of(spark, changes, str(tmp_path / "set"), "status").count() == lines.filter("barcode IS NOT NULL AND branch_id IS NOT NULL").count()
    assert os.listdir(tmp_path / "set")
