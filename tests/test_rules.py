"""Hand-made frames for the semantic traps and the upload rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.functions.parse import clean_num, find_column, flexible_date
from retailkit.plans import credit as C
from retailkit.plans import statements as ST
from retailkit.plans import ingest as I
from retailkit.plans import sales as S
from retailkit.plans import tax as TX


def test_flexible_dates(spark):
    cases = {"13/02/2025": "2025-02-13", "02/13/2025": "2025-02-13", "05/06/2025": "2025-06-05",
             "2025-31-12": "2025-12-31", "1.2.49": "2049-02-01", "1.2.50": "1950-02-01", "31/31/2025": None,
             "": None, "31/02/2025": "2025-03-03", "abc": None}
    df = spark.createDataFrame([(k,) for k in cases], "v STRING").select("v", flexible_date("v").alias("d"))
    got = {r["v"]: (str(r["d"]) if r["d"] else None) for r in df.collect()}
    assert got == cases


def test_clean_numbers(spark):
    cases = {"GHS 10.00": 10.0, "₵5": 5.0, "1,000": 1000.0, "abc": 0.0, "-3": -3.0, "": 0.0, "1.2.3": 1.2}
    df = spark.createDataFrame([(k,) for k in cases], "v STRING").select("v", clean_num("v").alias("n"))
    assert {r["v"]: r["n"] for r in df.collect()} == cases


def test_header_matching_contains_first_pattern_wins():
    cols = ["Supplier Name", "Product Name", "Unit Cost", "Selling Price"]
    assert find_column(cols, ["product name", "name"]) == "Product Name"
    assert find_column(["Supplier Name", "Cost"], ["product name", "name"]) == "Supplier Name"      # T17
    assert find_column(cols, ["cost", "costprice"]) == "Unit Cost"
    assert find_column(cols, ["barcode", "sku"]) is None


def test_null_ordering_is_explicit(spark):
    """T1: PostgreSQL puts NULLs last ascending; jobs say so explicitly."""
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id INT, v INT")
    got = [r["id"] for r in df.orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got == [3, 2, 1]


def test_branch_label_groups_raw_then_labels(spark):
    """T6: NULL and a literal 'Main Branch' stay two rows in the branch matrix."""
    rows = [(1, None, "completed", False, Decimal("10.00"), dt.datetime(2024, 1, 1)),
            (2, "Main Branch", "Completed", False, Decimal("5.00"), dt.datetime(2024, 1, 1)),
            (3, "X", "completed", True, Decimal("7.00"), dt.datetime(2024, 1, 1))]
    h = spark.createDataFrame(rows, "id LONG, store_location STRING, status STRING, is_return BOOLEAN, "
                                    "total_amount DECIMAL(12,2), created_at TIMESTAMP_NTZ")
    got = sorted((r["branch"], r["txn_count"], str(r["revenue"])) for r in S.branch_matrix(h).collect())
    assert got == [("Main Branch", 1, "10.00"), ("Main Branch", 1, "5.00"), ("X", 0, "7.00")]


def test_statement_gap_modes(spark):
    """T8: the legacy opening loses rows of the previous month's last day after midnight."""
    rows = [(1, dt.datetime(2024, 4, 30, 0, 0), "SALE", Decimal("10.00"), Decimal("0"), 1),
            (1, dt.datetime(2024, 4, 30, 23, 59, 59, 500000), "SALE", Decimal("5.00"), Decimal("0"), 2),
            (1, dt.datetime(2024, 5, 31, 23, 59, 59), "PAYMENT", Decimal("0"), Decimal("3.00"), 3)]
    led = spark.createDataFrame(rows, "customer_id LONG, date TIMESTAMP_NTZ, type STRING, debit DECIMAL(18,2), "
                                      "credit DECIMAL(18,2), ref_id LONG").withColumn("description", F.lit("x"))
    ok = ST.statement_lines(led).filter("month = DATE '2024-05-01'").collect()
    legacy = ST.statement_lines(led, legacy_gap=True).filter("month = DATE '2024-05-01'").collect()
    assert [str(r["opening_balance"]) for r in ok] == ["15.00"]
    assert [str(r["balance"]) for r in ok] == ["12.00"]
    assert [str(r["opening_balance"]) for r in legacy] == ["10.00"]


def test_map_fallback_variants(spark):
    """T12: '||' treats 0 as missing, the undefined test does not."""
    df = spark.createDataFrame([({"B2": 0, "B1": 4},), ({"B1": -2},), ({},)], "m MAP<STRING,INT>")
    a = [r[0] for r in df.select(X.map_lookup_alias("m", ["B2", "B1"], zero_is_missing=True)).collect()]
    b = [r[0] for r in df.select(X.map_lookup_alias("m", ["B2", "B1"], zero_is_missing=False)).collect()]
    assert a == [4, -2, 0] and b == [0, -2, 0]


def test_map_add_and_clamp(spark):
    df = spark.createDataFrame([({"A": 1, "B": -3}, {"B": 2, "C": 5})], "m MAP<STRING,INT>, d MAP<STRING,INT>")
    r = df.select(X.map_add("m", "d").alias("x"), X.map_clamp_negative("m").alias("c"),
                  X.map_has_negative("m").alias("n"), X.map_total("m").alias("t")).first()
    assert r["x"] == {"A": 1, "B": -1, "C": 5} and r["c"] == {"A": 1, "B": 0} and r["n"] and r["t"] == -2


def test_tax_null_vs_empty_breakdown(spark, tmp_path):
    """T13: NULL breakdown is legacy (VAT back-calculated), [] is a stored zero."""
    from retailkit.sources.adapter import TAX_TYPE
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("total_amount", T.DecimalType(12, 2)),
                           T.StructField("tax_breakdown", T.ArrayType(TAX_TYPE))])
    h = spark.createDataFrame([(1, 5, Decimal("115.00"), None), (2, 5, Decimal("50.00"), []), (3, 6, Decimal("110.00"), None), (4, None, Decimal("115.00"), None)], schema)
    st = spark.createDataFrame([(1, Decimal("15.00"), None), (2, Decimal("10.00"), None)], "branch_id INT, vat_rate DECIMAL(5,2), "
                                                              "monthly_target DECIMAL(12,2)")
    users = spark.createDataFrame([(5, 7), (6, 2)], "id LONG, branch_id INT")          # branch 7 has no setting: branch 1's rate
    got = {r["id"]: (r["total_tax"], r["source"]) for r in TX.transaction_tax(h, st, users).collect()}
    assert got == {1: (15.0, "VAT (15.0%)"), 2: (0.0, "stored"), 3: (10.0, "VAT (10.0%)"), 4: (15.0, "VAT (15.0%)")}


def test_try_divide_instead_of_ansi_error(spark):
    """T19: ANSI mode raises on division by zero; ratios use try_divide / nullif."""
    r = spark.range(1).select(X.safe_div(F.lit(1), F.lit(0)).alias("x")).first()
    assert r["x"] is None


CSV = """Product Name,Category,Cost,Markup,Current Stock,Batch Number,Expiry Date,Barcode,Physical Count
Red Widget,ECONOMY,GHS 10.00,25,5,LOT-1,13/02/2025,,
Red Widget,economy,"1,000",,3,,,,
New Thing,Tools,₵5,10,2,LOT-9,1.2.49,NEW-1,7
,Skipped,1,1,1,,,,
Known By Code,Whatever,abc,,4,,31/31/2025,7,
"""


def test_bulk_upload(spark, tmp_path):
    p = tmp_path / "upload.csv"
    p.write_text(CSV)
    raw = I.read_upload(spark, str(p))
    rows = I.parse_upload(raw)
    assert rows.count() == 4                                  # the row without a name is skipped
    products = spark.createDataFrame(
        [(1, "1", "red widget", "economy", Decimal("9.00"), Decimal("6.00"), 10, {"B1": 10}, Decimal("1"), 10),
         (7, "7", "Other", "X", Decimal("2.00"), Decimal("1.00"), 1, {}, Decimal("1"), 10)],
        "id LONG, barcode STRING, name STRING, category STRING, price DECIMAL(10,2), cost_price DECIMAL(10,2), "
        "stock INT, stock_levels MAP<STRING,INT>, conversion_rate DECIMAL(10,2), reorder_level INT")
    batches = spark.createDataFrame([], "product_barcode STRING, batch_number STRING, branch_id INT, "
                                        "expiry_date DATE, quantity INT")
    after, new_batches, counts, cats = I.bulk_apply(rows, products, batches, "B1", 1)
    a = {r["barcode"]: r for r in after.collect()}
    assert a["1"]["stock"] == 18 and a["1"]["stock_levels"] == {"B1": 18}      # matched by name+category, twice
    assert str(a["1"]["cost_price"]) == "1000.00"                              # last row's attributes win
    assert a["NEW-1"]["stock"] == 2 and str(a["NEW-1"]["price"]) == "5.50"     # markup price (FN-10)
    assert a["7"]["stock"] == 5 and a["7"]["name"] == "Known By Code"          # matched by barcode
    nb = {(r["product_barcode"], r["batch_number"]): r["expiry_date"] for r in new_batches.collect()}
    assert nb == {("1", "LOT-1"): dt.date(2025, 2, 13), ("NEW-1", "LOT-9"): dt.date(2049, 2, 1)}
    assert [(r["product_barcode"], r["variance"]) for r in counts.collect()] == [("NEW-1", 5)]
    assert cats.count() == 4


def test_barcode_fan_out_and_dedupe(spark):
    """T7: two products share a barcode -> the join doubles the line unless deduplicated."""
    sales = spark.createDataFrame([(1, False, "completed", "X", 3)],
                                  "id LONG, is_return BOOLEAN, status STRING, barcode STRING, qty INT")
    products = spark.createDataFrame([(1, "X", "Alpha"), (2, "X", "Alpha")], "id LONG, barcode STRING, name STRING")
    fan = S.top_products_net(sales, products).first()
    one = S.top_products_net(sales, products, dedupe=True).first()
    assert (fan["total_sold"], one["total_sold"]) == (6, 3)


def test_return_sign_conventions(spark):
    """T2: verbatim 'gross + returns' vs returns stored as positive amounts."""
    h = spark.createDataFrame([(1, "completed", False, Decimal("100.00")), (2, "completed", True, Decimal("30.00"))],
                              "id LONG, status STRING, is_return BOOLEAN, total_amount DECIMAL(12,2)") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert str(S.sales_summary(h).first()["net_sales"]) == "130.00"
    assert str(S.sales_summary(h, returns_stored_positive=True).first()["net_sales"]) == "70.00"
