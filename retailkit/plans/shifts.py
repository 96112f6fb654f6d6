"""Shift reports: interval join of sales to shifts (JN-5) and cash-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.intervals import points_in_intervals
from retailkit.plans.sales import payment_bucket


def shift_sales(shifts: DataFrame, sales: DataFrame) -> DataFrame:
    """Pairs (shift, sale) with sale.user = shift.user AND ts >= start AND (end IS NULL OR ts <= end)."""
    s = sales.select(F.col("id").alias("sale_id"), "user_id", "created_at", "total_amount", "payment_method")
    sh = shifts.select(F.col("id").alias("shift_id"), "user_id", "start_time", "end_time")
    return points_in_intervals(s, sh, "user_id", "created_at", "start_time", "end_time")


def shift_history(shifts: DataFrame, sales: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-4: every shift with its staff name, branch and sales total (0 when none)."""
    tot = shift_sales(shifts, sales).groupBy("shift_id").agg(F.sum("total_amount").alias("t"))
    j = (shifts.join(tot, shifts.id == tot.shift_id, "left")
         .join((users.select(F.col("id").alias("uid"), F.col("name").alias("user_name"),
                                        F.col("store_location").alias("branch"))),
               F.col("user_id") == F.col("uid"), "left"))
    return j.select("id", "user_id", "start_time", "end_time", "user_name", "branch",
                    X.money(F.coalesce("t", F.lit(0))).alias("total_sales"))


def _bucket_sums(pairs: DataFrame) -> DataFrame:
    b = payment_bucket()
    return pairs.groupBy("shift_id").agg(
        X.money_sum(F.when(b == "cash", F.col("total_amount")), zero=True).alias("cash_sales"),
        X.money_sum(F.when(b == "momo", F.col("total_amount")), zero=True).alias("momo_sales"),
        X.money_sum(F.when(b == "card", F.col("total_amount")), zero=True).alias("card_sales"))


def shift_cashup(shifts: DataFrame, sales: DataFrame) -> DataFrame:
    """RPT-2 / RPT-3 for every shift: expected cash = start + cash sales; closed shifts get
    counted - expected and a balanced / over / short label."""
    sums = _bucket_sums(shift_sales(shifts, sales))
    j = shifts.join(sums, shifts.id == sums.shift_id, "left")
    zero = F.lit(0).cast("decimal(18,2)")
    cash = F.coalesce("cash_sales", zero)
    expected = X.money(F.coalesce("start_cash", F.lit(0)) + cash)
    diff = X.money(F.col("end_cash") - expected)
    return j.select(F.col("id").alias("shift_id"), "user_id", X.money("start_cash").alias("start_cash"),
                    cash.alias("cash_sales"), F.coalesce("momo_sales", zero).alias("momo_sales"),
                    F.coalesce("card_sales", zero).alias("card_sales"), expected.alias("expected_cash"),
                    diff.alias("difference"),
                    F.when(F.col("end_cash").isNull(), None).when(diff == 0, "balanced")
                     .when(diff > 0, "over").otherwise("short").alias("result"))


def active_shifts(shifts: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-43: open shifts with the user's name and branch."""
    o = shifts.filter(F.col("end_time").isNull())
    return o.join((users.select(F.col("id").alias("user_id"), "name", "store_location")),
                  "user_id", "left").select("id", "user_id", "start_time", "name", "store_location")


def sales_in_open_shift(sales: DataFrame, shifts: DataFrame) -> DataFrame:
    """RPT-5: a user's sales since the start of their open shift; users with no open shift see all."""
    o = shifts.filter(F.col("end_time").isNull()).groupBy("user_id").agg(F.max("start_time").alias("open_start"))
    j = sales.join(o, "user_id", "left")
    return j.filter(F.col("open_start").isNull() | (F.col("created_at") >= F.col("open_start"))) \
            .select("id", "user_id", "created_at", "total_amount")
