"""Change sets, as-of joins and the incremental monthly table against hand-made rows and loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retailkit.operators.asof import as_of
from retailkit.operators.changeset import add_to_batches, add_to_stock, post, rows_of
from retailkit.operators.running import day_bucket
from retailkit.plans import postings as PO
from retailkit.sources import sinks

LINES = ("po_id long, supplier_id long, barcode string, quantity int, received_at timestamp_ntz, branch_id int, branch_name string, "
         "given_number string, given_expiry date, given_quantity int")
BATCHES = "product_barcode string, batch_number string, branch_id int, expiry_date date, quantity int, quantity_available int, quantity_received int"


def receive(spark, lines):
    suppliers = spark.createDataFrame([(1, "a bc Ltd"), (2, None)], "id long, name string")
    products = spark.createDataFrame([("A", "Milk", 10, {"Main": 4}), ("B", "x y", None, None), ("C", "", 5, {"Main": 5})],
                                     "barcode string, name string, stock int, stock_levels map<string,int>")
    batches = spark.createDataFrame([("A", "LOT", 1, dt.date(2024, 5, 5), 3, 2, 3), ("A", "OLD", 1, None, 7, 7, 7), ("Z", "OTHER", 1, None, 1, 1, 1)], BATCHES)
    df = spark.createDataFrame(lines, LINES)
    return products, batches, PO.receive_orders(df, suppliers, products, batches)


def test_receipt_makes_every_frame_from_one_read(spark, tmp_path):
    t = [dt.datetime(2024, 2, 29, 10, i) for i in range(10)]
    e = dt.date(2024, 5, 5)
    lines = [(1, 1, "A", 5, t[0], 1, "Main", None, None, None), (1, 1, "B", 2, t[0], 1, "Main", "", None, 0), (2, 1, "A", 4, t[1], 1, "Acc", "LOT", e, 3),
             (3, 2, "A", 1, t[2], 1, "Acc", "LOT", dt.date(2024, 6, 6), None), (4, 9, "A", 1, t[3], 1, "Acc", "OLD", e, None),
             (5, 2, "C", 8, t[4], 2, "Main", "NEW", e, None), (6, 2, "C", 8, t[5], 2, "Main", "NEW", dt.date(2024, 7, 7), None), (7, 1, "Q", 9, t[6], 1, "Main", None, None, None)]
    products, batches, changes = receive(spark, lines)
    folder = str(tmp_path / "posting")
    for _ in range(2):                                           # a retry replaces its own output
        post(changes, folder)
    got = {k: rows_of(spark, changes, folder, k) for k in ("product", "batch", "audit", "status", "reject")}
    assert sorted((r.barcode, r.branch_name, r.units) for r in got["product"].collect()) == [
        ("A", "Acc", 1), ("A", "Acc", 1), ("A", "Acc", 3), ("A", "Main", 5), ("B", "Main", 2), ("C", "Main", 8), ("C", "Main", 8)]
    numbers = {(r.product_barcode, r.units, r.batch_number, str(r.expiry_date)) for r in got["batch"].collect()}
    assert numbers == {("A", 5, "AB-240229-MIL-250301", "2025-03-01"), ("B", 2, "AB-240229-XY-250301", "2025-03-01"), ("A", 3, "LOT", "2024-05-05"),
                       ("A", 1, "LOT-240606", "2024-06-06"), ("A", 1, "OLD-240505", "2024-05-05"), ("C", 8, "NEW", "2024-05-05"),
                       ("C", 8, "NEW-240707", "2024-07-07"), ("Q", 9, "AB-240229-ITE-250301", "2025-03-01")}
    audit = sorted((r.product_barcode, r.reference_id, r.quantity_before, r.quantity_after) for r in got["audit"].collect())
    assert audit == [("A", 1, 10, 15), ("A", 2, 15, 18), ("A", 3, 18, 19), ("A", 4, 19, 20), ("B", 1, 0, 2), ("C", 5, 5, 13), ("C", 6, 13, 21)]
    assert {r.po_id for r in got["status"].collect()} == set(range(1, 8)) and [(r.po_id, r.barcode) for r in got["reject"].collect()] == [(7, "Q")]
    stock = {r.barcode: (r.stock, r.stock_levels) for r in add_to_stock(products, got["product"]).collect()}
    assert stock == {"A": (20, {"Main": 9, "Acc": 5}), "B": (2, {"Main": 2}), "C": (21, {"Main": 21})}
    after = {(r.product_barcode, r.batch_number): (r.quantity, r.quantity_available, r.expiry_date) for r in add_to_batches(batches, got["batch"]).collect()}
    assert after["A", "LOT"] == (6, 5, e) and after["A", "OLD"] == (7, 7, None) and after["Z", "OTHER"] == (1, 1, None) and len(after) == 10          # 3 old, 7 new


def test_receipt_of_nothing(spark, tmp_path):
    _, batches, changes = receive(spark, [])
    post(changes, str(tmp_path / "none"))
    assert rows_of(spark, changes, str(tmp_path / "none"), "audit").count() == 0
    assert add_to_batches(batches, rows_of(spark, changes, str(tmp_path / "none"), "batch")).count() == 3


def test_as_of_equals_the_loop(spark):
    rnd = random.Random(14)
    t0 = dt.datetime(2024, 1, 1)
    keys = ["hot"] * 10 + ["a", "b", None]
    values = [(rnd.choice(keys), t0 + dt.timedelta(hours=rnd.randint(0, 400)), i, rnd.choice([None, *range(9)])) for i in range(500)] + [("hot", None, 999, 1)]
    asked = [(i, rnd.choice([*keys, "none"]), t0 + dt.timedelta(hours=rnd.randint(-20, 420))) for i in range(300)] + [(900, "hot", None)]
    q = spark.createDataFrame(asked, "id long, k string, at timestamp_ntz").filter("k IS NOT NULL")
    v = spark.createDataFrame(values, "k string, t timestamp_ntz, ref long, v int").filter("k IS NOT NULL")
    got = {r.id: r.was for r in as_of(q, v, ["k"], "at", "t", ["ref"], "v", "was", day_bucket).collect()}

    def last(k, at):
        before = [(t, i, x) for kk, t, i, x in values if kk == k and t is not None and at is not None and t <= at]
        return max(before, key=lambda r: r[:2])[2] if before else None
    assert got == {i: last(k, at) for i, k, at in asked if k is not None}


def test_refresh_builds_changed_months_only(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = [(m, p, q) for m in (1, 2, 3) for p in ("x", "y") for q in (1, 5)]

    def frame(rs):
        return spark.createDataFrame([(dt.date(2024, m, 9), p, q) for m, p, q in rs], "day date, p string, q int")
    month = F.trunc("day", "month")
    def build(df):
        return df.groupBy(F.trunc("day", "month").alias("month"), "p").agg(F.sum("q").alias("q"))

    def table(n):
        return {(r.month.month, r.p): r.q for r in sinks.read_months(spark, path, n).collect()}

    def built(n):
        return {r.month.month for r in sinks.changed_months(spark, path, n).collect()}
    sinks.refresh_months(frame(rows), month, build, path, 1)
    assert built(1) == {1, 2, 3} and table(1)[1, "x"] == 6
    changed = [r for r in rows if r[0] != 1] + [(2, "x", 3), (4, "z", 2)]                      # month 1 has lost its rows, 2 changed, 4 is new
    random.Random(1).shuffle(changed)
    for _ in range(2):
        sinks.refresh_months(frame(changed), month, build, path, 2)
        assert built(2) == {2, 4}
        assert table(2) == {(2, "x"): 9, (2, "y"): 6, (3, "x"): 6, (3, "y"): 6, (4, "z"): 2}
    swapped = [r if r != (3, "x", 5) else (3, "x", 4) for r in changed]                       # same number of rows, another value
    sinks.refresh_months(frame(swapped), month, build, path, 3)
    assert built(3) == {3} and table(3)[3, "x"] == 5


def test_transfers_arrive_once_and_whole(spark, tmp_path):
    t = [dt.datetime(2024, 1, 1, h) for h in range(9)]
    branches = spark.createDataFrame([(1, "North", "Tamale"), (2, "South", None)], "id long, name string, location string")
    products = spark.createDataFrame([("a", 5, {"North": 1}), ("b", None, None)], "barcode string, stock int, stock_levels map<string,int>")
    transfers = spark.createDataFrame(
        [(1, "North", "In Transit", "a", 3), (1, "North", "In Transit", "b", 4), (2, "North", "Received", "a", 1), (3, "South", "In Transit", "a", 7), (3, "South", "In Transit", "zz", 1),
         (4, None, "In Transit", "a", 2), (5, "South", "In Transit", "a", None)], "transfer_id long, to_location string, status string, barcode string, qty int")
    asked = [(1, 1, "cashier", "South", t[1]), (2, 1, "cashier", "Tamale", t[2]), (3, 1, "admin", None, t[3]), (4, 1, "cashier", "South", t[4]), (5, 2, "ceo", None, t[1]), (6, 3, "Admin", "x", t[1]),
             (7, 9, "admin", None, t[1]), (8, 4, None, " north ", t[0]), (9, 4, None, "", t[1]), (10, 5, "staff", " SOUTH", t[2]), (11, 5, "staff", "South", t[2])]
    requests = spark.createDataFrame(asked, "request_id long, transfer_id long, role string, store_location string, requested_at timestamp_ntz")
    changes = PO.receive_transfers(requests, transfers, products, branches)
    folder = str(tmp_path / "arrivals")
    post(changes, folder)
    got = {k: rows_of(spark, changes, folder, k).collect() for k in ("status", "reject")}
    assert {(r.transfer_id, r.request_id, r.status) for r in got["status"]} == {(1, 2, "Received"), (5, 10, "Received")}
    late = "Transfer already processed"
    assert {(r.request_id, r.reason) for r in got["reject"]} == {(1, "Unauthorized"), (3, late), (4, late), (5, late), (6, "unknown product"), (7, "Transfer not found"),
                                                               (8, "Unauthorized"), (9, "no destination"), (11, late)}
    new = {r.barcode: (r.stock, r.stock_levels) for r in add_to_stock(products, rows_of(spark, changes, folder, "product"), missing=None).collect()}
    assert new["b"] == (None, {"North": 4}) and new["a"] == (8, {"North": 4, "South": 0})
    none = PO.receive_transfers(requests.limit(0), transfers, products, branches)
    assert none.count() == 0


def test_approved_stock_takes(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a", 7, 5, 2), (1, "a", 1, 4, -3), (1, "b", 2, 2, 0), (2, "a", 9, 5, 4), (3, "zz", 1, 0, 1), (4, "a", 1, 1, None), (6, "a", 3, 1, 2)],
                                  "stock_take_id long, product_barcode string, physical_count int, system_count int, variance int")
    approvals = spark.createDataFrame([(1, 2, 8), (2, 3, 8), (3, None, 9), (4, 1, 9), (5, 1, 9)], "stock_take_id long, branch_id int, approved_by long")
    changes = PO.approve_stock_takes(approvals, lines)
    folder = str(tmp_path / "approvals")
    post(changes, folder)
    assert {tuple(r) for r in rows_of(spark, changes, folder, "status").collect()} == {
        (1, "Approved", 8, -1), (2, "Approved", 8, 4), (3, "Approved", 9, 1), (4, "Approved", 9, 0), (5, "Approved", 9, 0)}
    assert sorted((r.product_barcode, r.reference_id, r.quantity_before, r.quantity_after) for r in rows_of(spark, changes, folder, "audit").collect()) == [
        ("a", 1, 4, 1), ("a", 1, 5, 7), ("a", 2, 5, 9), ("zz", 3, 0, 1)]
    products = spark.createDataFrame([("a", None, {"Accra Branch": 1})], "barcode string, stock int, stock_levels map<string,int>")
    new = add_to_stock(products, rows_of(spark, changes, folder, "product")).collect()
    assert [(r.stock, r.stock_levels) for r in new] == [(3, {"Accra Branch": 0, "Kumasi Branch": 4})]
