"""Invariants on the supplied tables, independent of the SQL oracle."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from retailkit.catalog import queries
from retailkit.plans import credit as C
from retailkit.plans import stock as K
from retailkit.sources.adapter import Retail

from conftest import SF_SMALL


def test_fefo_takes_equal_min_of_demand_and_supply(spark):
    r = Retail(spark, SF_SMALL)
    takes = queries()["win03_fefo_sales"](spark, SF_SMALL).groupBy("product_barcode").agg(F.sum("take").alias("t"))
    it = r.sale_items().filter((F.lower("status") == "completed") & ~F.col("is_return") & (F.col("qty") > 0))
    demand = it.groupBy(F.col("barcode").alias("product_barcode")).agg(F.sum("qty").alias("d"))
    supply = r.batches().filter("quantity > 0").groupBy("product_barcode").agg(F.sum("quantity").alias("s"))
    j = demand.join(supply, "product_barcode", "full_outer").join(takes, "product_barcode", "left")
    bad = j.filter(F.coalesce("t", F.lit(0)) != F.least(F.coalesce("d", F.lit(0)), F.coalesce("s", F.lit(0))))
    assert bad.count() == 0


def test_statement_chain_opening_equals_previous_closing(spark):
    st = queries()["rpt18_monthly_statements"](spark, SF_SMALL)
    w = Window.partitionBy("customer_id").orderBy("month")
    chk = st.withColumn("prev_close", F.lag("closing_balance").over(w))
    assert chk.filter(F.col("prev_close").isNotNull() & (F.col("prev_close") != F.col("opening_balance"))).count() == 0
    assert st.filter(F.col("closing_balance") != F.col("opening_balance") + F.col("total_debit")
                     - F.col("total_credit")).count() == 0


def test_branch_revenues_add_up_to_total(spark):
    r = Retail(spark, SF_SMALL)
    m = queries()["rpt09_branch_matrix"](spark, SF_SMALL).agg(F.sum("revenue")).first()[0]
    total = r.sale_headers().filter(F.lower("status") == "completed").agg(F.sum("total_amount")).first()[0]
    assert m == total


def test_resync_stock_equals_map_total(spark):
    rows = queries()["chg19_stock_resync"](spark, SF_SMALL)
    g = rows.groupBy("barcode", "new_stock").agg(F.sum("qty").alias("s"))
    assert g.filter(F.col("s") != F.col("new_stock")).count() == 0


def test_running_balance_ends_at_balance_change(spark):
    r = Retail(spark, SF_SMALL)
    led = C.build_ledger(r.sale_headers(), r.payments())
    last = C.running_balance(led).groupBy("customer_id").agg(F.max_by("balance", F.struct("date", "type", "ref_id"))
                                                             .alias("b"))
    tot = led.groupBy("customer_id").agg((F.sum("debit") - F.sum("credit")).alias("t"))
    assert last.join(tot, "customer_id").filter(F.col("b") != F.col("t")).count() == 0


def test_each_shift_sale_attributed_to_exactly_one_shift(spark):
    pairs = queries()["jn05_shift_sales"](spark, SF_SMALL)
    assert pairs.groupBy("sale_id").count().filter("count > 1").count() == 0
    r = Retail(spark, SF_SMALL)
    assert pairs.select("sale_id").distinct().count() == r.event_sales().count()


def test_audit_chain_is_continuous(spark):
    a = queries()["win09_sale_audit"](spark, SF_SMALL)
    r = Retail(spark, SF_SMALL)
    # every product's first 'before' is its opening stock plus nothing; consecutive rows chain after -> before
    assert a.filter(F.col("quantity_after") - F.col("quantity_before") == 0).count() == 0
    k = K.sale_deltas(r.sale_items(), r.products()).groupBy("barcode").agg(F.sum("delta").alias("d"))
    last = a.groupBy("barcode").agg(F.min("quantity_after").alias("mn"), F.max("quantity_after").alias("mx"))
    assert last.join(k, "barcode").count() == k.count()
