"""Statements of every customer and month at once (RPT-18, RPT-19, RPT-20).

The reference prints one customer's month per request.  Here the month is a column: openings are carried along a customer's
months (a window over one small row per customer and month), lines inside a month come from the two-level running balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.running import day_bucket, running_sum
from retailkit.plans.credit import ledger_order

SIGNED = "debit - credit"
OPENING, PAID, CLOSING, BARE = "Opening Balance (Previous Debt)", "Payment Received", "CLOSING BALANCE", "Transaction (No details)"


def month_of(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def months(ledger: DataFrame) -> DataFrame:
    """(customer_id, month, lines, in_period, debits, credits, net, late, opening): a row per customer and month with activity.

    ``late`` is what came after 00:00 of the month's last day; ``in_period`` counts rows up to the last day's last second."""
    m = ledger.withColumn("month", month_of("date"))
    last = F.last_day("month")
    g = m.groupBy("customer_id", "month").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("date") <= X.day_end_inclusive(last)).alias("in_period"),
        F.sum("debit").alias("debits"), F.sum("credit").alias("credits"), F.sum(F.expr(SIGNED)).alias("net"),
        F.sum(F.when(F.col("date") > last.cast("timestamp_ntz"), F.expr(SIGNED)).otherwise(0)).alias("late"))
    before = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("opening", F.coalesce(F.sum("net").over(before), F.lit(0)))


def statement_lines(ledger: DataFrame, legacy_gap: bool = False) -> DataFrame:
    """RPT-18 ledger form: every ledger row with its month's opening and closing and the balance after it.

    ``legacy_gap=True`` reproduces T8: a statement opens with the rows up to 00:00 of the previous month's last day, so
    that day's later rows are lost to it.
    """
    g = months(ledger)
    along = Window.partitionBy("customer_id").orderBy("month")
    adjacent = F.lag("month").over(along) == F.add_months("month", -1)
    gap = F.coalesce(F.when(adjacent, F.lag("late").over(along)), F.lit(0)) if legacy_gap else F.lit(0).cast("decimal(18,2)")
    g = g.select("customer_id", "month", "opening", "net", gap.alias("gap"))
    run = running_sum(ledger, ["customer_id"], ledger_order(), F.expr(SIGNED), "run", bucket=day_bucket("date")).withColumn("month", month_of("date"))
    j = run.join(g, ["customer_id", "month"])
    return j.select("customer_id", "month", "date", "description", "debit", "credit", X.money(F.col("opening") - F.col("gap")).alias("opening_balance"),
                    X.money(F.col("run") - F.col("gap")).alias("balance"), X.money(F.col("opening") - F.col("gap") + F.col("net")).alias("closing_balance"))


def statement_calendar(ledger: DataFrame, as_of) -> DataFrame:
    """RPT-18 for every month from a customer's first activity to ``as_of`` (or the last activity, if later); a month without
    activity opens and closes with what was carried there."""
    g = months(ledger)
    span = g.groupBy("customer_id").agg(F.min("month").alias("lo"), F.greatest(F.max("month"), X.month_start(as_of)).alias("hi"))
    every = span.select("customer_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    j = every.join(g.select("customer_id", "month", "lines", "debits", "credits"), ["customer_id", "month"], "left").fillna(0, ["lines", "debits", "credits"])
    upto = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("closing", F.sum(F.col("debits") - F.col("credits")).over(upto))
    return j.select("customer_id", "month", F.col("lines").cast("long").alias("lines"),
                    X.money(F.col("closing") - F.col("debits") + F.col("credits")).alias("opening_balance"), X.money("debits").alias("total_debit"),
                    X.money("credits").alias("total_credit"), X.money("closing").alias("closing_balance"))


def statement_source(headers: DataFrame, payments: DataFrame) -> DataFrame:
    """RPT-19: credit purchases of any status (positive) and payments (negative) of every customer and month.

    The reference's month ends with 00:00 of the next month's first day, inclusive: a row of exactly that time is in both months."""
    buy = headers.filter((F.col("payment_method") == "credit") & F.col("customer_id").isNotNull() & F.col("created_at").isNotNull()).select(
        "customer_id", F.col("created_at").alias("date"), F.lit("purchase").alias("kind"),
        F.col("receipt_number").alias("reference"), X.money("total_amount").alias("amount"))
    pay = payments.filter(F.col("payment_date").isNotNull()).select(
        "customer_id", F.col("payment_date").alias("date"), F.lit("payment").alias("kind"),
        F.col("id").cast("string").alias("reference"), X.money(-F.col("amount")).alias("amount"))
    rows, month = buy.unionByName(pay), month_of("date")
    both = F.when(F.col("date") == month.cast("timestamp_ntz"), F.array(F.add_months(month, -1), month)).otherwise(F.array(month))
    return rows.withColumn("month", F.explode(both))


def itemised_statement(ledger: DataFrame, items: DataFrame, settings: DataFrame) -> DataFrame:
    """RPT-20 for every customer and month: an opening row (if |opening| > 0.01), sold items with VAT on top, payments negative, sales
    without items at their ledger amount (T11), and the closing row, the sum of the others before rounding.

    Amounts stay exact decimals until they are rounded to cents at the end."""
    month = month_of("date")
    vat = settings.filter(F.col("branch_id") == 1).agg(F.max("vat_rate").alias("v")).select(F.coalesce("v", F.lit("15.00").cast("decimal(5,2)")).alias("vat"))
    none = [F.lit(None).cast("long").alias("qty"), F.lit(None).cast("decimal(10,2)").alias("price"),
            F.lit(None).cast("decimal(24,6)").alias("subtotal"), F.lit(None).cast("decimal(24,6)").alias("tax")]
    exact = lambda c: c.cast("decimal(24,6)")
    period = ledger.withColumn("month", month).filter(F.col("date") <= X.day_end_inclusive(F.last_day("month")))
    opening = months(ledger).filter((F.col("in_period") > 0) & (F.abs("opening") > X.dec("0.01", 3, 2))).select(
        "customer_id", "month", F.lit(None).cast("timestamp_ntz").alias("date"), F.lit(OPENING).alias("name"), *none, exact(F.col("opening")).alias("total"))
    pays = period.filter(F.col("type") == "PAYMENT").select(
        "customer_id", "month", "date", F.lit(PAID).alias("name"), *none, exact(-F.col("credit")).alias("total"))
    it = items.select(F.col("id").alias("transaction_id"), F.col("name").alias("item"), F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("price", F.lit(0)).alias("price"))
    sold = period.filter(F.col("type") == "SALE").join(it, "transaction_id", "left").withColumn("vat", vat.scalar())
    listed, sub = F.col("qty").isNotNull(), F.col("qty") * F.col("price")            # a sale without items has one row, without an item
    tax = sub * F.col("vat") * X.dec("0.01", 3, 2)
    sales = sold.select("customer_id", "month", "date", F.when(listed, F.col("item")).otherwise(F.coalesce("description", F.lit(BARE))).alias("name"),
                        F.col("qty").cast("long").alias("qty"), "price", exact(sub).alias("subtotal"), exact(tax).alias("tax"),
                        F.when(listed, exact(sub + tax)).otherwise(exact(F.col("debit"))).alias("total"))
    rows = opening.unionByName(pays).unionByName(sales)
    closing = rows.groupBy("customer_id", "month").agg(F.sum("total").alias("total")).select(
        "customer_id", "month", F.lit(None).cast("timestamp_ntz").alias("date"), F.lit(CLOSING).alias("name"), *none, exact(F.col("total")).alias("total"))
    cents = lambda c: X.money(F.round(c, 2)).alias(c)
    return rows.unionByName(closing).select("customer_id", "month", "date", "name", "qty", "price", cents("subtotal"), cents("tax"), cents("total"))
