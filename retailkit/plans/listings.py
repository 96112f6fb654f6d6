"""Listings and per-day reports: batches by expiry, daily profit, the full register, approvals, movements, alias merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.functions import scope as SC


def batches_expiry(batches: DataFrame, products: DataFrame) -> DataFrame:
    """RPT-23 list (JN-19, JN-20): batches in stock, soonest expiry first, each with the first product name of its barcode
    and the stock of all products of that barcode."""
    p = products.groupBy(F.col("barcode").alias("product_barcode")).agg(F.min_by("name", "id").alias("name"), F.sum("stock").alias("current_stock"))
    b = batches.filter(F.col("quantity") > 0).select("product_barcode", "batch_number", "branch_id", "expiry_date", "quantity")
    return b.join(p, "product_barcode", "left").orderBy(F.col("expiry_date").asc_nulls_last(), "product_barcode", "batch_number", "branch_id")


def daily_profit(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """AGG-11 bars: revenue, real cost and profit per day; a quantity of 0 or none counts as 1."""
    q = F.when(F.coalesce("qty", F.lit(0)) == 0, 1).otherwise(F.col("qty"))
    cost = lines.groupBy("sale_id").agg(F.sum(q * F.coalesce("cost_price", F.lit(0))).alias("_cost"))
    s = headers.filter(F.col("status") == "completed").select("id", "created_at", "total_amount")
    j = s.join(cost, s.id == cost.sale_id, "left").withColumn("_cost", F.coalesce("_cost", F.lit(0)))
    return j.groupBy(F.to_date("created_at").alias("day")).agg(
        X.money_sum("total_amount").alias("revenue"), X.money_sum("_cost").alias("cost"), X.money_sum(F.col("total_amount") - F.col("_cost")).alias("profit"))


def completed_sales(headers: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-40, the whole register: completed sales of all branches, newest first, with the cashier's name."""
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("cashier_name"))
    s = headers.filter(F.col("status") == "completed").join(u, "user_id", "left")
    return s.select("id", "receipt_number", "created_at", "store_location", "total_amount", "payment_method", "is_return", "cashier_name").orderBy(
        F.col("created_at").desc_nulls_first(), F.col("id").desc())


def approval_history(customers: DataFrame) -> DataFrame:
    """FLT-18: customers whose approval is decided."""
    return customers.filter(F.col("status").isin("Active", "Rejected")).select("id", "name", "account_number", "credit_limit", "status")


def movement_view(audit: DataFrame, headers: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-33: stock movements with product and user, and what the change was."""
    sale = headers.select(F.col("id").alias("reference_id"), "created_at", "user_id")
    name = products.groupBy("barcode").agg(F.min_by("name", "id").alias("_product"))
    who = users.select(F.col("id").alias("user_id"), F.col("name").alias("_user"))
    j = audit.join(sale, "reference_id").join(name, "barcode", "left").join(who, "user_id", "left")
    diff = F.col("quantity_after") - F.col("quantity_before")
    return j.select("reference_id", "pos", "created_at", "barcode", F.coalesce("_product", F.lit("Unknown")).alias("product_name"),
                    F.coalesce("_user", F.lit("System")).alias("user_name"), "quantity_before", "quantity_after",
                    F.when(diff > 0, "Qty Added").when(diff < 0, "Qty Removed").otherwise("Change").alias("change_label"))


def merge_aliases(products: DataFrame, primary: Column, aliases: Column) -> DataFrame:
    """FN-26: the quantities under any of a location's names are added up under the primary one, the other names go."""
    m = F.coalesce(F.col("stock_levels").cast("map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    keys = F.array_distinct(F.concat(F.array(primary), aliases))
    total = F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc + F.coalesce(F.try_element_at(m, k), F.lit(0)))
    rest = F.map_filter(m, lambda k, v: ~F.array_contains(keys, k))
    return products.withColumn("stock_levels", F.map_concat(rest, F.create_map(primary, total)))


def filtered_totals(headers: DataFrame, status=None, since=None, until=None, payment_method=None) -> DataFrame:
    """FLT-11: a branch summary under whichever filters are given."""
    preds = []
    if status is not None:
        preds.append(F.col("status") == status)
    if since is not None:
        preds.append(F.col("created_at") >= X.lit_ts(since))
    if until is not None:
        preds.append(F.col("created_at") <= X.lit_ts(until))
    if payment_method is not None:
        preds.append(F.col("payment_method") == payment_method)
    return headers.filter(SC.all_of(preds)).groupBy(X.branch_label().alias("branch")).agg(
        F.count(F.lit(1)).alias("transactions"), X.money_sum("total_amount").alias("revenue"))
