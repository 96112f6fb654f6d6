"""Sales reports: dashboards, branch matrix, product rankings, time series.

Every function takes DataFrames (and an explicit ``as_of`` where the
reference used the wall clock) and returns a lazy DataFrame.  Reports that
the reference answers for one branch / one day per request are computed
here for every branch and day at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.topk import top_k, top_k_per_group

def _completed(ci: bool):
    """FLT-12: LOWER(status)='completed' (ci) vs status='completed'; kept distinct per job."""
    return (F.lower(F.col("status")) == "completed") if ci else (F.col("status") == "completed")


def items_of(sales: DataFrame, header_cols=("id", "user_id", "customer_id", "store_location", "status",
                                             "is_return", "created_at", "payment_method", "total_amount")) -> DataFrame:
    """JN-8: lateral unnest of the item array (rows with an empty array drop out).

    Accepts the nested sales frame, or an already flat item frame (``Retail.sale_items``),
    which is the same rows without the nest-then-unnest round trip.
    """
    if "items" not in sales.columns:
        return sales
    fields = ["barcode", "name", "qty", "price", "cost_price", "discount"]
    return (sales.select(*header_cols, F.posexplode("items").alias("pos", "item"))
            .select(*header_cols, F.col("item.id").alias("item_id"), *[F.col(f"item.{f}").alias(f) for f in fields],
                    "pos"))


# -- RPT-9 / AGG-6 -------------------------------------------------------------
def branch_matrix(headers: DataFrame, start=None, end=None, exact_status: bool = False,
                  between: bool = False, limit: int | None = None, max_limit: int = 500) -> DataFrame:
    """Branch performance matrix: group by the raw location, label afterwards (T6).

    ``between=False``: case-insensitive status and inclusive-day end (``/ceo/branches``);
    ``between=True``: exact status and raw BETWEEN on timestamps (``/ceo/branch-performance``).
    """
    f = _completed(not exact_status)
    if start is not None and end is not None:
        ts = F.col("created_at")
        if between:
            f = f & ts.between(X.lit_ts(start), X.lit_ts(end))
        else:
            f = f & (ts >= X.lit_ts(start)) & (ts <= X.day_end_inclusive(end))
    g = (headers.filter(f).groupBy("store_location")
         .agg(F.count(F.when(~F.col("is_return"), 1)).alias("txn_count"),
              X.money_sum("total_amount").alias("revenue")))
    out = g.select(X.branch_label().alias("branch"), "txn_count", "revenue")
    if limit is not None:
        out = top_k(out, [F.col("revenue").desc_nulls_first(), F.col("branch").asc()], min(limit, max_limit))
    return out


# -- RPT-1 / AGG-2 / FLT-14 / TOP-1 / AGG-14 -----------------------------------
def dashboard_daily(sales: DataFrame) -> DataFrame:
    """Per branch label and day: signed nested-item total and non-return count.

    The inner Σ qty·price stays inside the row (``aggregate`` over the
    array), so only one partial+final aggregation shuffles.
    """
    s = sales.filter(_completed(True)).select(
        X.branch_label().alias("branch"), F.to_date("created_at").alias("day"),
        (X.return_sign() * X.items_gross()).alias("signed"), "is_return")
    return (s.groupBy("branch", "day")
            .agg(X.money_sum("signed", zero=True).alias("total_sales"),
                 F.count(F.when(~F.col("is_return"), 1)).alias("total_transactions")))


def dashboard_daily_flat(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """The same report from a flat line table: Σ qty·price per sale is a partial aggregate
    (combined map-side), joined back to the headers on the sale key; sales without lines
    still count, with a zero total."""
    gross = lines.groupBy("sale_id").agg(F.sum(F.col("qty") * F.col("price")).alias("_gross"))
    h = headers.filter(_completed(True)).select("id", "store_location", "created_at", "is_return")
    s = h.join(gross, h.id == gross.sale_id, "left").select(
        X.branch_label().alias("branch"), F.to_date("created_at").alias("day"),
        (X.return_sign() * F.coalesce("_gross", F.lit(0))).alias("signed"), "is_return")
    return (s.groupBy("branch", "day")
            .agg(X.money_sum("signed", zero=True).alias("total_sales"),
                 F.count(F.when(~F.col("is_return"), 1)).alias("total_transactions")))


def low_stock_counts(products: DataFrame, branch_keys) -> DataFrame:
    """FLT-14 counts per stock-map key (missing key = 0) plus the global stock test."""
    keys = F.array(*[F.lit(k) for k in branch_keys])
    p = products.select("stock_levels", "reorder_level", F.explode(keys).alias("branch"))
    per = p.groupBy("branch").agg(F.count_if(
        X.map_get0("stock_levels", F.col("branch")) <= F.coalesce("reorder_level", F.lit(10))).alias("low_stock"))
    tot = products.agg(F.count_if(X.low_stock_le()).alias("low_stock")).select(
        F.lit("All Branches").alias("branch"), "low_stock")
    return per.unionByName(tot)


def recent_sales(headers: DataFrame, lines: DataFrame, users: DataFrame, k: int = 5) -> DataFrame:
    """Latest k completed non-return sales per branch label with cashier name (TOP-1, JN-1); the amount is the signed
    total of the sale's items."""
    s = (headers.filter(_completed(True) & ~F.col("is_return"))
         .withColumn("branch", X.branch_label())
         .join((users.select(F.col("id").alias("uid"), F.col("name").alias("cashier_name"))),
               F.col("user_id") == F.col("uid"), "left"))
    top = top_k_per_group(s, ["branch"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()], k)
    gross = lines.groupBy("sale_id").agg(F.sum(F.col("qty") * F.col("price")).alias("_gross"))
    top = top.join(gross, top.id == gross.sale_id, "left")
    return top.select("branch", "id", "receipt_number", "created_at",
                      X.money(X.return_sign() * F.coalesce("_gross", F.lit(0))).alias("amount"),
                      F.when(F.col("is_return"), "RETURN").otherwise("SALE").alias("type"), "cashier_name")


def cashier_stats(headers: DataFrame, users: DataFrame, since, k: int = 5) -> DataFrame:
    """Top-k cashiers by sales since a day, grouped by user name (LEFT JOIN users)."""
    s = (headers.filter(_completed(True) & (F.col("created_at") >= X.lit_ts(since)))
         .join((users.select(F.col("id").alias("uid"), "name")), F.col("user_id") == F.col("uid"), "left"))
    g = s.groupBy(F.col("name").alias("cashier")).agg(
        F.count("id").alias("transaction_count"), X.money_sum("total_amount").alias("total_sales"))
    return top_k(g, [F.col("total_sales").desc_nulls_first(), F.col("cashier").asc_nulls_last()], k)


# -- RPT-12 / AGG-1 / AGG-10 ---------------------------------------------------
def sales_summary(headers: DataFrame, start=None, end=None, returns_stored_positive: bool = False) -> DataFrame:
    """AGG-1.  T2: the reference nets as ``gross + returns``, which is right only when return rows
    carry negative totals; that formula is the default, ``returns_stored_positive=True`` subtracts."""
    f = _completed(False)
    if start is not None:
        f = f & (F.col("created_at") >= X.lit_ts(start))
    if end is not None:
        f = f & (F.col("created_at") <= X.lit_ts(end))
    r, amt = F.col("is_return"), F.col("total_amount")
    gross = F.coalesce(F.sum(F.when(~r, amt).otherwise(0)), F.lit(0))
    rets = F.coalesce(F.sum(F.when(r, amt).otherwise(0)), F.lit(0))
    return headers.filter(f).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count(F.when(~r, 1)).alias("sales_transactions"),
        F.count(F.when(r, 1)).alias("return_transactions"),
        X.money(gross).alias("gross_sales"), X.money(rets).alias("returns_amount"),
        X.money(gross - rets if returns_stored_positive else gross + rets).alias("net_sales"),
        X.money(F.coalesce(F.sum(amt), F.lit(0))).alias("total_amount"))


def staff_scoped(headers: DataFrame, users: DataFrame, branch_id: int) -> DataFrame:
    """JN-12: sales whose cashier belongs to the branch -- ``user_id IN (SELECT id FROM users WHERE
    branch_id = b)`` as a left semi join (no duplication, no columns from the right side)."""
    staff = users.filter(F.col("branch_id") == branch_id).select(F.col("id").alias("user_id"))
    return headers.join(staff, "user_id", "left_semi")


def dedupe_products(products: DataFrame) -> DataFrame:
    """T7: the product key drifted from barcode to (barcode, name), so a barcode join can fan out.
    Keep one product per barcode (lowest id) -- a ``min_by`` aggregate, no window."""
    cols = [c for c in products.columns if c != "barcode"]
    g = products.groupBy("barcode").agg(F.min_by(F.struct(*cols), "id").alias("_p"))
    return g.select("barcode", *[F.col(f"_p.{c}").alias(c) for c in cols])


def top_products_net(sales: DataFrame, products: DataFrame, start=None, end=None, k: int = 10,
                     dedupe: bool = False) -> DataFrame:
    """Sold, returned and net units per product name (explode + join on barcode, JN-10).

    As in the reference, a barcode shared by several products multiplies the line (T7); pass
    ``dedupe=True`` to join one product per barcode instead."""
    if dedupe:
        products = dedupe_products(products)
    f = _completed(False)
    if start is not None:
        f = f & (F.col("created_at") >= X.lit_ts(start))
    if end is not None:
        f = f & (F.col("created_at") <= X.lit_ts(end))
    it = items_of(sales.filter(f), ("is_return",)).select("is_return", "barcode", "qty")
    j = it.join(products.select("barcode", F.col("name").alias("pname")), "barcode")
    r = F.col("is_return")
    g = j.groupBy(F.col("pname").alias("name")).agg(
        F.sum(F.when(~r, F.col("qty")).otherwise(0)).alias("total_sold"),
        F.sum(F.when(r, F.col("qty")).otherwise(0)).alias("total_returned"))
    g = g.withColumn("net_sold", F.col("total_sold") - F.col("total_returned"))
    return top_k(g, [F.col("net_sold").desc(), F.col("name").asc()], k)


# -- AGG-9 / TOP-2 / TOP-3 / JN-15 / TOP-4 ------------------------------------
def product_sales(sales: DataFrame, since, ci: bool = True) -> DataFrame:
    """Units and revenue per product name with the return sign (AGG-9)."""
    s = sales.filter(_completed(ci) & (F.col("created_at") >= X.lit_ts(since)))
    it = items_of(s, ("is_return",))
    sign = X.return_sign()
    return it.groupBy("name").agg(
        F.sum(sign * F.col("qty")).alias("units"),
        X.money_sum(sign * F.col("qty") * F.col("price")).alias("revenue"))


def top_products(sales: DataFrame, since, k: int = 5) -> DataFrame:
    return top_k(product_sales(sales, since), [F.col("revenue").desc_nulls_last(), F.col("name").asc()], k)


def slow_movers(sales: DataFrame, products: DataFrame, since, k: int = 5) -> DataFrame:
    """TOP-3 / TOP-4 / JN-15: bottom-k by units; when that list is empty or entirely among the
    top sellers, products with stock that are not top sellers (highest stock first) replace it,
    provided there are any.  The choice is a scalar-subquery flag, not a driver-side branch."""
    from retailkit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(sales.sparkSession)
    # one row per product, read by six branches below: materialise it once (shared checkpoint
    # folder) instead of re-running the sales scan and unnest for every branch
    ps = product_sales(sales, since).checkpoint(eager=True)
    top = top_k(ps, [F.col("revenue").desc_nulls_last(), F.col("name").asc()], k).select("name")
    slow = top_k(ps, [F.col("units").asc_nulls_last(), F.col("name").asc()], k)
    dead = products.filter(F.col("stock") > 0).join(top, "name", "left_anti")           # NOT IN top names
    dead = top_k(dead.select("id", "name", "stock"),
                 [F.col("stock").desc_nulls_first(), F.col("name").asc(), F.col("id").asc()], k)
    outside = slow.join(top, "name", "left_anti").agg(F.count(F.lit(1))).scalar()             # SET-3
    n_slow = slow.agg(F.count(F.lit(1))).scalar()
    n_dead = dead.agg(F.count(F.lit(1))).scalar()
    use_dead = ((n_slow == 0) | (outside == 0)) & (n_dead > 0)            # uncorrelated scalar subqueries
    a = slow.select("name", F.col("units").cast("long").alias("units_sold"), "revenue", F.lit("slow").alias("source"))
    b = dead.select("name", F.lit(0).cast("long").alias("units_sold"), F.lit(0).cast("decimal(18,2)").alias("revenue"),
                    F.lit("dead_stock").alias("source"))
    return a.unionByName(b).filter(F.when(use_dead, F.col("source") == "dead_stock")
                                   .otherwise(F.col("source") == "slow"))


# -- AGG-8 / SRC-4 ---------------------------------------------------------------
def monthly_product_sales(sales: DataFrame) -> DataFrame:
    """Month x branch x product: units and revenue; returns are not netted (T3)."""
    it = items_of(sales.filter(_completed(False)), ("store_location", "created_at"))
    return it.groupBy(F.trunc(F.to_date("created_at"), "month").alias("month"), X.branch_label().alias("branch"),
                      F.col("name").alias("product_name")).agg(
        F.sum("qty").alias("total_qty"),
        X.money_sum(F.col("qty") * F.col("price")).alias("total_revenue"))


# -- AGG-7 / AGG-7b / RPT-28 ------------------------------------------------------
def ytd(sales: DataFrame, as_of):
    """Year-to-date units, revenue, 12-month histogram (zero filled) and per product."""
    s = sales.filter(_completed(False) & (F.col("created_at") >= X.year_start(as_of).cast("timestamp_ntz")))
    it = items_of(s, ("created_at",)).withColumn("rev", F.col("qty") * F.col("price"))
    months = it.groupBy(F.month("created_at").alias("month")).agg(
        F.sum("qty").alias("units"), X.money_sum("rev").alias("revenue"))
    cal = it.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    hist = F.broadcast(cal).join(months, "month", "left").select(
        "month", F.coalesce("units", F.lit(0)).cast("long").alias("units"),
        F.coalesce("revenue", F.lit(0)).cast("decimal(18,2)").alias("revenue"))
    per_product = it.groupBy("barcode").agg(
        F.min_by("name", F.struct("created_at", "name")).alias("name"),
        F.sum("qty").alias("units"), X.money_sum("rev").alias("revenue"))
    return hist, per_product


# -- AGG-11 / RPT-7 / AGG-12 -----------------------------------------------------
def daily_revenue(headers: DataFrame) -> DataFrame:
    s = headers.filter(_completed(True))
    return s.groupBy(F.to_date("created_at").alias("day")).agg(
        F.date_format(F.first(F.to_date("created_at")), "EEE").alias("dow"),
        X.money_sum("total_amount").alias("revenue"))


def trend_7d(headers: DataFrame, as_of_ts, cost_ratio: str = "0.7", forecast_ratio: str = "1.1") -> DataFrame:
    """RPT-7: last 7 days of revenue with cost and forecast ratios (constants are arguments, T16)."""
    t = X.lit_ts(as_of_ts)
    s = headers.filter(_completed(True) & (F.col("created_at") >= F.timestamp_add("DAY", F.lit(-7), t)))
    g = s.groupBy(F.to_date("created_at").alias("day")).agg(X.money_sum("total_amount").alias("revenue"))
    return g.select("day", F.date_format("day", "EEE").alias("dow"), "revenue",
                    X.money(F.round(F.col("revenue") * X.dec(cost_ratio, 4, 2), 2)).alias("costs"),
                    X.money(F.round(F.col("revenue") * X.dec(forecast_ratio, 4, 2), 2)).alias("forecast"))


def last_days_zero_filled(headers: DataFrame, as_of, days: int = 7) -> DataFrame:
    """AGG-12: one row per calendar day of the window, 0 when no sales."""
    d = X.lit_date(as_of)
    s = headers.filter(_completed(False) & (F.to_date("created_at") > F.date_sub(d, days))
                       & (F.to_date("created_at") <= d))
    g = s.groupBy(F.to_date("created_at").alias("day")).agg(X.money_sum("total_amount").alias("revenue"))
    cal = headers.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(d, days - 1), d)).alias("day"))
    return F.broadcast(cal).join(g, "day", "left").select(
        "day", F.coalesce("revenue", F.lit(0)).cast("decimal(18,2)").alias("revenue"))


# -- AGG-13 / TOP-5 / AGG-14 ------------------------------------------------------
def peak_hours(headers: DataFrame, as_of) -> DataFrame:
    s = headers.filter(_completed(False) & (F.col("created_at") >= X.month_start(as_of).cast("timestamp_ntz")))
    return s.groupBy(F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"), X.money_sum("total_amount").alias("revenue"))


def high_value(headers: DataFrame, users: DataFrame, as_of, k: int = 5) -> DataFrame:
    s = headers.filter(_completed(False) & (F.col("created_at") >= X.month_start(as_of).cast("timestamp_ntz")))
    s = s.join((users.select(F.col("id").alias("uid"), F.col("name").alias("cashier_name"))),
               F.col("user_id") == F.col("uid"), "left").drop("uid")
    return top_k(s.select("id", "receipt_number", "total_amount", "created_at", "cashier_name"),
                 [F.col("total_amount").desc_nulls_first(), F.col("id").asc()], k)


def staff_performance(headers: DataFrame, users: DataFrame, as_of, k: int = 10,
                      high_threshold: int = 5000) -> DataFrame:
    """JN-7: LEFT JOIN made inner by the WHERE on the sales side."""
    s = headers.filter(_completed(False) & (F.col("created_at") >= X.month_start(as_of).cast("timestamp_ntz")))
    j = (users.select(F.col("id").alias("uid"), "name")).join(s, F.col("uid") == F.col("user_id"), "inner")
    g = j.groupBy("uid", "name").agg(F.count(F.when(~F.col("is_return"), 1)).alias("transactions"),
                                     X.money_sum("total_amount").alias("sales"))
    g = g.withColumn("performance", F.when(F.col("sales") > high_threshold, "High").otherwise("Normal"))
    return top_k(g.select("name", "transactions", "sales", "performance"),
                 [F.col("sales").desc_nulls_first(), F.col("name").asc()], k)


# -- AGG-3 / AGG-4 / AGG-5 ---------------------------------------------------------
def payment_totals(headers: DataFrame, since=None) -> DataFrame:
    f = _completed(True)
    if since is not None:
        f = f & (F.col("created_at") >= X.lit_ts(since))
    return headers.filter(f).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("count"), X.money_sum("total_amount").alias("total"))


def payment_bucket(method="payment_method", unknown_as_cash: bool = False):
    m = F.lower(X.col(method))
    b = (F.when(m == "cash", "cash")
         .when((m == "momo") | m.contains("mobile"), "momo")
         .when(m == "card", "card"))
    return b.otherwise("cash") if unknown_as_cash else b


def payment_mix(headers: DataFrame) -> DataFrame:
    """AGG-5: count per bucket (credit is one of its own, anything unknown is cash), zero-filled over the bucket list."""
    bucket = F.when(F.lower("payment_method") == "credit", "credit").otherwise(payment_bucket(unknown_as_cash=True))
    s = headers.filter(_completed(False)).withColumn("bucket", bucket)
    g = s.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))
    cal = headers.sparkSession.createDataFrame([("cash",), ("momo",), ("card",), ("credit",)], "bucket STRING")
    return F.broadcast(cal).join(g, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


# -- AGG-24 / AGG-26 / AGG-25 / RPT-29 / RPT-30 ----------------------------------------
def profitability(headers: DataFrame, sales: DataFrame) -> DataFrame:
    """Revenue from the transactions' totals, COGS from the items' cost prices; a quantity of 0 or none counts as 1,
    negative quantities stay.  Percentages of revenue only where it is positive."""
    it = items_of(sales.filter(_completed(False)), ("is_return",))
    q = F.when(F.coalesce("qty", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("qty"))
    cost = it.agg(X.money_sum(q * F.coalesce("cost_price", F.lit(0)), zero=True).alias("cogs"),
                  F.count_distinct(F.when(F.coalesce("cost_price", F.lit(0)) == 0, item_label())).alias("products_without_cost"))
    total = headers.filter(_completed(False)).agg(X.money_sum("total_amount", zero=True).alias("revenue"))
    t = cost.select(total.scalar().alias("revenue"), "cogs", "products_without_cost")

    def pct(part):
        return X.ratio(F.when(F.col("revenue") > 0, part.cast("double") * 100 / F.col("revenue").cast("double")))
    profit = F.col("revenue") - F.col("cogs")
    return t.select("revenue", "cogs", X.money(profit).alias("gross_profit"), pct(F.col("cogs")).alias("cost_ratio_pct"),
                    pct(profit).alias("margin_pct"), "products_without_cost")


def item_label():
    return F.coalesce(F.nullif("name", F.lit("")), F.nullif("barcode", F.lit("")), F.lit("Unknown"))


def products_without_cost(sales: DataFrame) -> DataFrame:
    """The names behind ``profitability``'s count: items sold without a cost price."""
    it = items_of(sales.filter(_completed(False)), ("is_return",))
    return it.filter(F.coalesce("cost_price", F.lit(0)) == 0).select(item_label().alias("name")).distinct()


def best_of(headers: DataFrame, sales: DataFrame, users: DataFrame) -> DataFrame:
    """AGG-26: argmax of product (units), cashier and store (revenue), deterministic ties; rows without a cashier or
    store count under fixed labels."""
    it = items_of(sales.filter(_completed(False)), ("is_return",))
    prod = it.groupBy("name").agg(F.sum("qty").alias("v")).agg(
        F.max_by("name", F.struct("v", F.col("name"))).alias("best_product"))
    h = headers.filter(_completed(False))
    cash = (h.join(users.select(F.col("id").alias("user_id"), "name"), "user_id", "left")
            .groupBy(F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.sum("total_amount").alias("v"))
            .agg(F.max_by("name", F.struct("v", F.col("name"))).alias("best_cashier")))
    store = (h.groupBy(F.coalesce("store_location", F.lit("Accra Main Branch")).alias("b")).agg(F.sum("total_amount").alias("v"))
             .agg(F.max_by("b", F.struct("v", F.col("b"))).alias("best_store")))
    return prod.select("best_product", cash.scalar().alias("best_cashier"), store.scalar().alias("best_store"))


def scaled_item_revenue(sales: DataFrame, k: int = 5) -> DataFrame:
    """AGG-25: item revenue scaled by txn total / item subtotal where both are positive, top-k products."""
    s = sales.filter(_completed(False)).withColumn("_sub", X.items_gross())
    s = s.withColumn("_ratio", F.when((F.col("_sub") > 0) & (F.col("total_amount") > 0),
                                      F.col("total_amount").cast("double") / F.col("_sub").cast("double")).otherwise(1.0))
    it = s.select("_ratio", F.explode("items").alias("i")).select(
        "_ratio", F.col("i.name").alias("name"), (F.col("i.qty") * F.col("i.price")).cast("double").alias("line"))
    g = it.groupBy("name").agg(F.round(F.sum(F.col("line") * F.col("_ratio")), 2).alias("revenue"))
    return top_k(g, [F.col("revenue").desc(), F.col("name").asc()], k)


# -- AGG-19 / AGG-20 / AGG-32 / RPT-40 / RPT-13 ------------------------------------------
def customer_activity(headers: DataFrame) -> DataFrame:
    return headers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("customer_id").isNull()).alias("no_customer"),
        F.count_distinct("customer_id").alias("customers_with_sales"),
        X.money_sum(F.when(F.col("payment_method") == "credit", F.col("total_amount")), zero=True).alias("credit_total"))


def completed_register(headers: DataFrame, customers: DataFrame, k: int = 20) -> DataFrame:
    s = headers.filter(_completed(False)).join(
        customers.select(F.col("id").alias("cid"), F.col("name").alias("customer")), F.col("customer_id") == F.col("cid"),
        "left")
    return top_k(s.select("id", "receipt_number", "created_at", "total_amount", "customer"),
                 [F.col("created_at").desc_nulls_first(), F.col("id").desc()], k)


def returns_register(headers: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """RPT-13: star left join of returns to staff and customers (JN-2)."""
    r = headers.filter(F.col("is_return"))
    r = (r.join((users.select(F.col("id").alias("uid"), F.col("name").alias("cashier_name"))),
                F.col("user_id") == F.col("uid"), "left")
          .join(customers.select(F.col("id").alias("cid"), F.col("name").alias("customer")),
                F.col("customer_id") == F.col("cid"), "left"))
    return r.select("id", "receipt_number", "original_transaction_id", "total_amount", "created_at",
                    "cashier_name", "customer")
