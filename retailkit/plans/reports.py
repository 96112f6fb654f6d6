"""Composite reports: CEO financials, risk radar, receipt lines, itemised statements,
product performance and batch lists (RPT-6, 8, 10, 15, 17, 19, 20, 26, 41)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.functions import exprs as X
from retailkit.operators.running import month_bucket, running_sum
from retailkit.operators.topk import top_k
from retailkit.sources.adapter import TAX_TYPE


def ceo_financials(headers: DataFrame, expenses: DataFrame, invoices: DataFrame, products: DataFrame,
                   branches: DataFrame, settings: DataFrame, start, end, cogs_ratio: str = "0.7",
                   default_target: str = "50000") -> DataFrame:
    """RPT-6 (all branches): revenue, estimated COGS, opex, profits, company revenue, asset value,
    branch count and target.  Independent global aggregates (partial per task, one tiny final),
    combined as uncorrelated scalar subqueries."""
    s = headers.filter((F.lower("status") == "completed") & (F.col("created_at") >= X.lit_ts(start))
                       & (F.col("created_at") <= X.day_end_inclusive(end)))
    rev = s.agg(X.money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("revenue"))
    ex = expenses.filter(F.col("expense_date").between(X.lit_date(start), X.lit_date(end))).agg(
        X.money(F.coalesce(F.sum("amount"), F.lit(0))).alias("opex"))
    comp = invoices.filter(F.col("kind") == "sales").agg(
        X.money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("company_revenue"))
    assets = products.agg(X.money(F.coalesce(F.sum(F.col("stock") * F.col("cost_price")), F.lit(0)))
                          .alias("asset_value"))
    nb = branches.agg(F.count(F.lit(1)).alias("branch_count"))
    tgt = settings.filter(F.col("branch_id") == 1).agg(F.max("monthly_target").alias("t")).select(
        F.coalesce(F.col("t"), X.dec(default_target, 12, 2)).cast("decimal(18,2)").alias("target"))
    j = rev.select("revenue", ex.scalar().alias("opex"), comp.scalar().alias("company_revenue"),
                   assets.scalar().alias("asset_value"), nb.scalar().alias("branch_count"),
                   tgt.scalar().alias("target"))
    r = F.col("revenue").cast("double")
    cogs = r * float(cogs_ratio)
    return j.select("revenue", "company_revenue", F.round(cogs, 2).alias("cogs"), "opex",
                    F.round(r - cogs, 2).alias("gross_profit"),
                    F.round(r - cogs - F.col("opex").cast("double"), 2).alias("net_profit"),
                    "asset_value", "branch_count", "target")


def risk_radar(products: DataFrame) -> DataFrame:
    """RPT-8: one 'Stockout Risk' row when any product has stock <= reorder level."""
    c = products.agg(F.count_if(F.col("stock") <= F.col("reorder_level")).alias("n"))
    return c.filter(F.col("n") > 0).select(
        F.lit("Stockout Risk").alias("type"),
        F.concat(F.col("n").cast("string"), F.lit(" items are critically low on stock.")).alias("message"),
        F.lit("high").alias("severity"))


def ceo_low_stock(products: DataFrame, k: int = 10) -> DataFrame:
    """RPT-10: stock <= reorder_level, lowest stock first."""
    p = products.filter(F.col("stock") <= F.col("reorder_level")).select("id", "name", "stock", "reorder_level")
    return top_k(p, [F.col("stock").asc_nulls_last(), F.col("name").asc(), F.col("id").asc()], k)


def receipt_totals(sales: DataFrame) -> DataFrame:
    """RPT-15 / FN-28 for every sale: line total = price·qty - discount, net = total / (1 + Σ rates/100),
    summed per receipt; tax = total - net (floating point as on the receipt, rounded to cents)."""
    taxes = F.coalesce("tax_breakdown", F.array().cast(T.ArrayType(TAX_TYPE)))
    rate = F.aggregate(taxes, F.lit(0.0), lambda a, t: a + F.coalesce(t["rate"].cast("double"), F.lit(0.0))) / 100
    s = sales.select("id", rate.alias("rate"), F.explode("items").alias("i"))
    fin = (F.col("i.price") * F.col("i.qty") - F.coalesce(F.col("i.discount"), F.lit(0))).cast("double")
    s = s.select("id", fin.alias("final"), (fin / (1 + F.col("rate"))).alias("net"))
    g = s.groupBy("id").agg(F.sum("final").alias("t"), F.sum("net").alias("n"))
    return g.select("id", F.round("t", 2).alias("total"), F.round("n", 2).alias("subtotal"),
                    F.round(F.col("t") - F.col("n"), 2).alias("tax"))


def company_transactions(transactions: DataFrame, invoices: DataFrame) -> DataFrame:
    """RPT-17 transactions list: the first company's transactions with the numbers of their invoices (JN-1, JN-22), newest first."""
    first = transactions.agg(F.min("company_id").alias("c")).scalar()
    i = invoices.select(F.col("id").alias("invoice_id"), "invoice_number")
    j = transactions.filter(F.col("company_id") == first).join(i, "invoice_id", "left")
    return (j.select("id", "company_id", "invoice_id", "invoice_number", "amount", "created_at")
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()))


def product_performance(items: DataFrame, products: DataFrame, branch: str, year: int, month: int,
                        fast_per_day: float = 1.0) -> DataFrame:
    """RPT-26: the summary table the reference reads has no writer, so it is derived from the sales of
    the month at the branch: units and revenue per product, average units per day, and the label
    'Fast Moving' (>= fast_per_day), 'Slow Moving' (> 0) or 'Dead Stock' (none sold).  Every product
    is listed (LEFT JOIN with extra ON predicates, JN-6); the threshold is an argument."""
    start, nxt = X.prev_month_range(year, month)
    days = (nxt - start).days
    s = items.filter((F.lower("status") == "completed") & (F.col("store_location") == branch)
                     & (F.col("created_at") >= X.lit_ts(f"{start} 00:00:00"))
                     & (F.col("created_at") < X.lit_ts(f"{nxt} 00:00:00")))
    g = s.groupBy("barcode").agg(F.sum("qty").alias("q"), F.sum(F.col("qty") * F.col("price")).alias("r"))
    j = products.select("barcode", "name", "category", "stock").join(g, "barcode", "left")
    q = F.coalesce("q", F.lit(0))
    per_day = q.cast("double") / days
    return j.select("barcode", "name", "category", q.cast("long").alias("quantity_sold"),
                    X.money(F.coalesce("r", F.lit(0))).alias("revenue"),
                    F.round(per_day, 4).alias("avg_daily_sales"),
                    F.when(per_day >= fast_per_day, "Fast Moving").when(q > 0, "Slow Moving")
                     .otherwise("Dead Stock").alias("classification"),
                    F.col("stock").alias("current_stock"))


def batches_by_product(batches: DataFrame, products: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """RPT-41 / WIN-6: each product's batches in FEFO order with stock left and their position.

    The position is a running count (two-level, skew-safe), not a window over the whole product."""
    b = batches.filter(F.col("quantity_available") > 0).select(
        "product_barcode", "batch_number", "branch_id", "expiry_date", "quantity_available")
    order = [F.col("expiry_date").asc_nulls_last(), F.col("batch_number"), F.col("branch_id")]
    b = running_sum(b, ["product_barcode"], order, F.lit(1), "fefo_rank", bucket=month_bucket("expiry_date"), heavy=heavy)
    j = b.join(products.select(F.col("barcode").alias("product_barcode"), "name"), "product_barcode", "inner")
    return j.select("product_barcode", "name", "batch_number", "branch_id", "expiry_date", "quantity_available",
                    F.col("fefo_rank").cast("long").alias("fefo_rank"))
