"""Policy tables, purchase order pages and the tax page's totals on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from retailkit.operators.topk import page_size
from retailkit.plans import ops as O
from retailkit.plans import reports as RP
from retailkit.plans import tax as TX
from retailkit.plans import viewers as V

VIEWERS = [("a", "staff", "admin", 2), ("c", "staff", "cashier", 2), ("n", "staff", None, None), ("z", "staff", "cashier", 0), ("o", "company", "company", 3),
           ("p", "company", "company", None), ("m", "staff", "cashier", 9)]


def viewers(spark, rows=VIEWERS):
    return spark.createDataFrame(rows, "viewer_id string, viewer_type string, role string, store_id int")


def orders(spark, rows):
    lines = spark.createDataFrame(rows, "po_id long, supplier_id long, barcode string, quantity int, order_date timestamp_ntz, status string")
    suppliers = spark.createDataFrame([(1, "S1", 2), (2, "S2", 3), (3, None, None)], "id long, name string, branch_id int")
    branches = spark.createDataFrame([(2, "Two"), (3, "Three")], "id long, name string")
    return lines, V.order_headers(lines, suppliers, branches)


def test_orders_by_viewer(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    rows = [(1, 1, "x", 5, t[0], "Pending"), (1, 1, "y", 1, t[0], "Pending"), (2, 2, "x", 7, t[1], "Received"), (3, 3, "q", 2, t[2], "Pending"), (4, 8, "x", 1, None, "Pending")]
    lines, h = orders(spark, rows)
    got = {r.viewer_id: (r.orders, r.total_qty, r.newest) for r in V.orders_by_viewer(h, viewers(spark)).collect()}
    everything = (4, 16, t[2])                                   # orders without a branch are seen by those who see all
    assert got == {"a": everything, "n": everything, "z": everything, "p": everything, "c": (1, 6, t[0]), "o": (1, 7, t[1]), "m": (0, 0, None)}
    none = {r.viewer_id: r.orders for r in V.orders_by_viewer(orders(spark, [])[1], viewers(spark)).collect()}
    assert set(none) == set(got) and set(none.values()) == {0}
    names = spark.createDataFrame([("x", "Ex")], "barcode string, name string")
    assert sorted((r.po_id, r.barcode, r.product_name, r.branch_name) for r in V.order_details(lines, h, names).collect()) == [
        (1, "x", "Ex", "Two"), (1, "y", None, "Two"), (2, "x", "Ex", "Three"), (3, "q", None, None), (4, "x", "Ex", None)]


def test_order_pages(spark):
    rows = [(i, 1, "x", 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 2), "Pending" if i % 4 else "Received") for i in range(300)]
    h = orders(spark, rows)[1]
    newest = sorted((i for i in range(300) if i % 4), key=lambda i: (i // 2, i), reverse=True)
    page = V.order_register(h.filter("status = 'Pending'"), limit=500, offset=10).orderBy("position").collect()
    assert [r.po_id for r in page] == newest[10:210] and page[0].position == 11
    assert V.order_register(h).groupBy("status").count().collect() and V.order_register(h).count() == 100
    assert (page_size(None, 100), page_size(0, 100), page_size(70, 100), page_size(500, 200), page_size("20", 200)) == (50, 50, 70, 200, 20)


def test_taxes_by_viewer(spark):
    rules = spark.createDataFrame([("LEVY", 2.5, 1, "Active"), ("vat", 9.0, 2, "Active"), ("OWN", 1.0, 3, "Active"), ("OFF", 1.0, 1, "Inactive"), ("LOOSE", 1.0, None, "Active")],
                                  "name string, rate double, branch_id int, status string")
    settings = spark.createDataFrame([(1, 12.5), (3, 0.0)], "branch_id int, vat_rate double")
    got = {}
    for r in V.taxes_by_viewer(rules, settings, viewers(spark)).collect():
        got.setdefault(r.viewer_id, set()).add((r.name, r.rate))
    first = {("VAT", 12.5), ("LEVY", 2.5)}
    assert got == {"a": {("vat", 9.0), ("LEVY", 2.5)}, "c": {("vat", 9.0), ("LEVY", 2.5)}, "n": first, "z": first, "m": first,
                   "o": {("OWN", 1.0)}, "p": first}              # a company of branch 3: no rule of branch 1, no VAT at 0; one without a branch is of branch 1


def test_tax_totals_and_missing_names(spark):
    day = dt.datetime(2024, 3, 1)
    tax, kept = "array<struct<name:string,amount:double>>", "array<struct<name:string,amount:decimal(12,2)>>"
    rows = [("A", 100.0, None), ("B", 50.0, None), ("A", 30.0, [("LEVY", 2.0), (None, 1.0), ("", 4.0), ("OLD", 0.5)]), (None, 20.0, [])]
    h = spark.createDataFrame([("completed", day, *r) for r in rows], f"status string, created_at timestamp_ntz, store_location string, total_amount double, tax_breakdown {tax}")
    h = h.withColumns({"total_amount": F.col("total_amount").cast("decimal(12,2)"), "tax_breakdown": F.col("tax_breakdown").cast(kept)})
    settings = spark.createDataFrame([(1, 15.0)], "branch_id int, vat_rate double")
    rules = spark.createDataFrame([("LEVY", 2.5, 1, "Active"), ("NONE", 1.0, 1, "Active")], "name string, rate double, branch_id int, status string")
    period = dict(start="2024-01-01", end="2024-12-31")
    got = {(r.branch, r.line, r.name): r.amount for r in TX.tax_totals(h, settings, rules, **period).collect()}
    va, vb = 100 - 100 / 1.15, 50 - 50 / 1.15
    want = {"A": (130.0, va + 7.5, va, 2.0), "B": (50.0, vb, vb, 0.0), "Main Branch": (20.0, 0.0, 0.0, 0.0), "TOTAL": (200.0, va + vb + 7.5, va + vb, 2.0)}
    for b, (gross, total, vat, levy) in want.items():
        assert [got[b, k, n] for k, n in (("gross", None), ("net", None), ("tax", None), ("rule", "VAT"), ("rule", "LEVY"), ("rule", "NONE"))] == [
            gross, round(gross - total, 2), round(total, 2), round(vat, 2), levy, 0.0]
    assert len(got) == 24
    assert TX.tax_totals(h.limit(0), settings, rules, **period).count() == 0
    by_rule = {(r.branch, r.tax_name): r.amount for r in TX.tax_by_rule(h, settings, rules, **period).collect()}
    assert by_rule["A", "LEVY"] == 2.0                           # a missing and an empty name in one branch are one name


def test_branch_names_match_letter_for_letter(spark):
    branches = spark.createDataFrame([(2, "Accra", "Coast"), (1, "Coast", "South")], "id long, name string, location string")
    asked = spark.createDataFrame([("Accra",), ("accra",), ("Coast",), (None,)], "input string")
    assert {r.input: (r.branch_id, r.branch_name) for r in O.resolve_branch(asked, branches).collect()} == {
        "Accra": (2, "Accra"), "accra": (None, "accra"), "Coast": (1, "Coast"), None: (None, None)}


def test_first_companys_transactions(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    ct = spark.createDataFrame([(1, 5, 7, 1.0, t[0]), (2, 4, 7, 2.0, t[1]), (3, 4, None, 3.0, t[2]), (4, 4, 9, 4.0, None)], "id long, company_id long, invoice_id long, amount double, created_at timestamp_ntz")
    invoices = spark.createDataFrame([(7, "INV-7")], "id long, invoice_number string")
    assert [(r.id, r.invoice_number) for r in RP.company_transactions(ct, invoices).collect()] == [(4, None), (3, None), (2, "INV-7")]
