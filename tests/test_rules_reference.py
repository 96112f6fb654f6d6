"""Hand-made rows with the outcome worked out from the reference's rules."""

from decimal import Decimal as D

import datetime as dt

from retailkit.plans import changes as CH
from retailkit.plans import credit as C
from retailkit.plans import listings as L
from retailkit.plans import ops as O
from retailkit.plans import sales as S
from retailkit.plans import stock as K
from retailkit.plans import tax as TX
from retailkit.plans import ingest as I
from retailkit.sources import tables

T0 = dt.datetime(2001, 5, 1, 10)
HEAD = ("id LONG, user_id LONG, customer_id LONG, store_location STRING, status STRING, is_return BOOLEAN, created_at TIMESTAMP_NTZ, "
        "payment_method STRING, total_amount DECIMAL(12,2), receipt_number STRING, promo_code STRING")
ITEM = "id LONG, is_return BOOLEAN, status STRING, total_amount DECIMAL(12,2), created_at TIMESTAMP_NTZ, store_location STRING, name STRING, barcode STRING, qty INT, price DECIMAL(10,2), cost_price DECIMAL(10,2)"


def heads(spark, *rows):
    full = [(i, u, c, loc, st, ret, T0 + dt.timedelta(hours=i), pay, D(tot), f"R{i}", promo) for i, u, c, loc, st, ret, pay, tot, promo in rows]
    return spark.createDataFrame(full, HEAD)


def test_credit_returns_lower_the_debt(spark):
    h = heads(spark, (1, 1, 7, None, "completed", False, "credit", "100", None), (2, 1, 7, None, "completed", True, "credit", "30", None),
              (3, 1, 7, None, "Completed", False, "credit", "999", None), (4, 1, 7, None, "completed", False, "cash", "999", None),
              (5, 1, 7, None, "completed", False, "credit", "85", None), (6, 1, 7, None, "completed", False, "credit", "80", None))
    pay = spark.createDataFrame([(1, 7, D("20"), T0)], "id LONG, customer_id LONG, amount DECIMAL(10,2), payment_date TIMESTAMP_NTZ")
    cust = spark.createDataFrame([(7, D("10"), D("160"))], "id LONG, current_balance DECIMAL(12,2), credit_limit DECIMAL(12,2)")
    led = C.posted_ledger(h, pay)
    assert {(r.ref_id, r.type, r.debit, r.credit) for r in led.collect()} == {
        (1, "SALE", D("100.00"), D("0.00")), (2, "RETURN", D("0.00"), D("30.00")), (5, "SALE", D("85.00"), D("0.00")),
        (6, "SALE", D("80.00"), D("0.00")), (1, "PAYMENT", D("0.00"), D("20.00"))}
    assert CH.credit_balances(cust, led).first().new_balance == D("225.00")
    got = {r.sale_id: (r.accepted, r.balance_after) for r in C.credit_decisions(h, cust).collect()}
    assert got == {1: (True, D("110.00")), 2: (True, D("80.00")), 5: (False, D("80.00")), 6: (True, D("160.00"))}


def test_payment_mix_has_credit_and_exact_status(spark):
    h = heads(spark, (1, 1, 1, None, "completed", False, "credit", "1", None), (2, 1, 1, None, "Completed", False, "credit", "1", None),
              (3, 1, 1, None, "completed", False, "Mobile Money", "1", None), (4, 1, 1, None, "completed", False, "cheque", "1", None))
    assert {r.bucket: r["count"] for r in S.payment_mix(h).collect()} == {"cash": 1, "momo": 1, "card": 0, "credit": 1}


def test_profitability(spark):
    h = heads(spark, (1, 1, 1, None, "completed", False, "cash", "100", None), (2, 1, 1, None, "Completed", False, "cash", "900", None))
    it = spark.createDataFrame([(1, False, "completed", D("100"), T0, None, "a", "1", 0, D("5"), D("10")), (1, False, "completed", D("100"), T0, None, "b", "2", -2, D("5"), D("10")),
                                (1, False, "completed", D("100"), T0, None, None, "9", 3, D("5"), None)], ITEM)
    r = S.profitability(h, it).first()
    assert (r.revenue, r.cogs, r.gross_profit, r.products_without_cost) == (D("100.00"), D("-10.00"), D("110.00"), 1)
    assert [x.name for x in S.products_without_cost(it).collect()] == ["9"]


def test_reorder_alerts_and_upsert(spark):
    p = spark.createDataFrame([("a", "A", 0, 10, D("1")), ("b", "B", 10, 10, D("1")), ("c", "C", -3, 10, D("1")), ("d", "D", 11, 10, D("1")), ("e", "E", 0, None, D("1"))],
                              "barcode STRING, name STRING, stock INT, reorder_level INT, price DECIMAL(10,2)")
    a = K.reorder_alerts(p)
    assert {r.barcode: (r.priority, r.suggested_quantity) for r in a.collect()} == {"a": ("Critical", 20), "b": ("High", 20), "c": ("High", 20)}
    old = spark.createDataFrame([("a", "old", 5, 3, 6, "High"), ("z", "Z", 1, 1, 2, "High")], a.schema)
    up = {r.barcode: (r.current_stock, r.reorder_level, r.priority, r._action) for r in K.upsert_alerts(old, a).collect()}
    assert up["a"] == (0, 3, "Critical", "update") and up["z"][3] == "keep" and up["b"] == (10, 10, "High", "insert")
    assert [r.barcode for r in K.alert_list(a, p).collect()] == ["a", "c", "b"]


def test_shelf_moves_do_not_use_stock_up(spark):
    p = spark.createDataFrame([("a", 5), ("b", None)], "barcode STRING, stock INT")
    m = spark.createDataFrame([("a", 5), ("a", 5), ("a", 6), ("b", 1)], "barcode STRING, qty INT")
    assert [tuple(r) for r in CH.shelf_moves(m, p).collect()] == [("a", 10, 2)]


def test_promotion_usage_is_discount(spark):
    h = heads(spark, (1, 1, 1, "N1", "completed", False, "cash", "1", "P"), (2, 1, 1, "N1", "completed", True, "cash", "1", "P"), (3, 1, 1, None, "completed", False, "cash", "1", "P"),
              (4, 1, 1, "N1", "completed", False, "cash", "1", "P"))
    lines = spark.createDataFrame([(1, D("5")), (1, D("2")), (2, D("3")), (3, D("4")), (4, D("0"))], "sale_id LONG, discount DECIMAL(10,2)")
    b = spark.createDataFrame([(3, "N1", "L")], "id LONG, name STRING, location STRING")
    ch = O.discount_changes(h, lines, b)
    assert {(r.code, r.branch_id, r.total_discounted) for r in O.promo_usage(ch).collect()} == {("P", 3, D("4.00")), ("P", 1, D("4.00"))}
    promos = spark.createDataFrame([("P", D("5"), None), ("Q", D("5"), 1)], "code STRING, discount_percentage DECIMAL(5,2), branch_id INT")
    assert {r.code: r.total_discounted for r in O.promo_totals(promos, ch).collect()} == {"P": D("8.00"), "Q": D("0.00")}


def test_promo_rekey_restores_others(spark):
    p = spark.createDataFrame([("X", 1, D("5")), ("Y", 2, D("7")), ("X", 2, D("6"))], "code STRING, branch_id INT, discount_percentage DECIMAL(5,2)")
    u = spark.createDataFrame([(4, "Active"), (4, "Active"), (5, "inactive"), (None, "Active")], "branch_id INT, status STRING")
    assert {tuple(r) for r in CH.rekey_promotions(p, u, "X", "5.00").collect()} == {("Y", 2, D("7.00")), ("X", 4, D("5.00"))}


def test_batch_upsert_overwrites(spark):
    t = spark.createDataFrame([("a", "1", 1, 5, 4), ("b", "1", 1, 5, 5)], "product_barcode STRING, batch_number STRING, branch_id INT, quantity INT, quantity_available INT")
    ch = spark.createDataFrame([("a", "1", 1, 9), ("c", "1", 1, 2)], "product_barcode STRING, batch_number STRING, branch_id INT, quantity INT")
    assert {(r.product_barcode, r.quantity, r.quantity_available, r.action) for r in O.batch_upsert(t, ch).collect()} == {
        ("a", 9, 9, "update"), ("b", 5, 5, "keep"), ("c", 2, 2, "insert")}


def test_resync_keeps_products_without_a_map(spark):
    p = spark.createDataFrame([("a", 4, None), ("b", 3, {}), ("c", 1, {"B1": 2})], "barcode STRING, stock INT, stock_levels MAP<STRING,INT>")
    assert {tuple(r) for r in K.resync_map(p).collect()} == {("a", 4, "Main Warehouse", 4), ("b", 3, "Main Warehouse", 3), ("c", 2, "B1", 2)}


def test_stock_key_resolution_and_whole_rejection(spark):
    b = spark.createDataFrame([(1, "Accra", "North"), (2, "North", "South")], "id LONG, name STRING, location STRING")
    it = spark.createDataFrame([(1, False, "completed", D("1"), T0, "North", "n", "a", 2, D("1"), D("1")), (2, False, "completed", D("1"), T0, "South", "n", "a", 1, D("1"), D("1")),
                                (3, True, "completed", D("1"), T0, None, "n", "a", 1, D("1"), D("1")), (4, False, "completed", D("1"), T0, "Else", "n", "a", 1, D("1"), D("1")),
                                (4, False, "completed", D("1"), T0, "Else", "n", "zz", 1, D("1"), D("1"))], ITEM)
    from pyspark.sql import functions as F
    p = spark.createDataFrame([(1, "a", 10)], "id LONG, barcode STRING, stock INT")
    got = {(r.id, r.branch, r.delta) for r in K.sale_deltas(it.withColumn("pos", F.lit(0)), p, b).collect()}
    assert got == {(1, "North", -2), (2, "North", -1), (3, "Main Warehouse", 1)}


def test_upload_codes_are_distinct_and_bad_lines_kept(spark, tmp_path):
    names = [(i, f"Pro{i}", "cat") for i in range(20000)]
    rows = spark.createDataFrame([(i, n, c, "", ) for i, n, c in names], "_row LONG, name STRING, category STRING, barcode_provided STRING")
    prods = spark.createDataFrame([], "barcode STRING, name STRING, category STRING")
    assert I.match_products(rows, prods).select("barcode").distinct().count() == 20000
    (tmp_path / "u.csv").write_text("Product Name,Price\nA,1\nB,2,extra,more\nC,3\n")
    raw = I.read_upload(spark, str(tmp_path / "u.csv"))
    assert [r.line for r in I.rejected_lines(raw).collect()] == ["B,2,extra,more"] and raw.count() == 3


def test_vat_rules(spark):
    settings = spark.createDataFrame([(1, D("12.5")), (2, D("0"))], "branch_id INT, vat_rate DECIMAL(5,2)")
    branches = spark.createDataFrame([(1,), (2,), (3,)], "id LONG")
    rules = spark.createDataFrame([("LEVY", D("2.5"), 1, "Active"), ("OLD", D("9"), 1, "Inactive"), ("X", D("1"), 3, "Active")], "name STRING, rate DECIMAL(5,2), branch_id INT, status STRING")
    got = {tuple(r) for r in TX.active_taxes(rules, branches, settings).collect()}
    assert got == {(1, "VAT", 12.5), (3, "VAT", 12.5), (1, "LEVY", 2.5), (2, "LEVY", 2.5), (3, "LEVY", 2.5), (3, "X", 1.0)}


def test_alias_merge(spark):
    from pyspark.sql import functions as F
    p = spark.createDataFrame([("a", {"N": 2, "North": 3, "B": 1}), ("b", None)], "barcode STRING, stock_levels MAP<STRING,INT>")
    got = {r.barcode: r.stock_levels for r in L.merge_aliases(p, F.lit("North"), F.array(F.lit("N"), F.lit("North"))).collect()}
    assert got == {"a": {"B": 1, "North": 5}, "b": {"North": 0}}


def test_json_text_as_object_or_string(spark):
    from pyspark.sql import functions as F
    rows = [('[{"id":1,"name":"a \\"b\\"","qty":2,"price":1.50}]',), ('"[{\\"id\\":1,\\"name\\":\\"x\\",\\"qty\\":2,\\"price\\":\\"1.50\\"}]"',), ("not json",), (None,)]
    got = [r.v for r in spark.createDataFrame(rows, "t STRING").select(tables.decode_json(F.col("t"), tables.ITEMS).alias("v")).collect()]
    assert (got[0][0].name, got[0][0].price) == ('a "b"', D("1.50")) and (got[1][0].name, got[1][0].qty, got[1][0].price) == ("x", 2, D("1.50")) and got[3] is None
