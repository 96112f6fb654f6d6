"""Customer credit: ledger build, statements with running balances, credit-limit fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.chunk_fold import accept
from retailkit.operators.running import day_bucket, running_sum
from retailkit.operators.sequence import global_row_number


def credit_sales(headers: DataFrame, scope: str = "credit") -> DataFrame:
    """T14: 'credit' = credit-paid completed sales with a customer; 'all' = every completed customer sale."""
    f = (F.col("status") == "completed") & F.col("customer_id").isNotNull()
    if scope == "credit":
        f = f & (F.col("payment_method") == "credit")
    return headers.filter(f)


def build_ledger(headers: DataFrame, payments: DataFrame, scope: str = "credit") -> DataFrame:
    """SET-2 / CHG-18: ledger = sales (debit) UNION ALL payments (credit)."""
    s = credit_sales(headers, scope).select(
        "customer_id", F.col("created_at").alias("date"),
        F.concat(F.coalesce("receipt_number", F.lit("TRX")), F.lit(" (Sale)")).alias("description"),
        F.lit("SALE").alias("type"), X.money("total_amount").alias("debit"), X.money(F.lit(0)).alias("credit"),
        F.col("id").alias("transaction_id"), F.col("id").alias("ref_id"))
    p = payments.select(
        "customer_id", F.col("payment_date").alias("date"), F.lit("Payment Received").alias("description"),
        F.lit("PAYMENT").alias("type"), X.money(F.lit(0)).alias("debit"), X.money("amount").alias("credit"),
        F.lit(None).cast("long").alias("transaction_id"), F.col("id").alias("ref_id"))
    return s.unionByName(p)


def posted_ledger(headers: DataFrame, payments: DataFrame) -> DataFrame:
    """CHG-6/7: the ledger as sales are finalised: a credit sale debits its total, a credit return credits it."""
    s = credit_sales(headers).select(
        "customer_id", F.col("created_at").alias("date"),
        F.concat(F.when(F.col("is_return"), "Credit Return - ").otherwise("Credit Sale - "), F.col("receipt_number")).alias("description"),
        F.when(F.col("is_return"), "RETURN").otherwise("SALE").alias("type"),
        X.money(F.when(F.col("is_return"), 0).otherwise(F.col("total_amount"))).alias("debit"),
        X.money(F.when(F.col("is_return"), F.col("total_amount")).otherwise(0)).alias("credit"),
        F.col("id").alias("transaction_id"), F.col("id").alias("ref_id"))
    return s.unionByName(build_ledger(headers, payments).filter(F.col("type") == "PAYMENT"))


def ledger_order():
    return [F.col("date"), F.col("type"), F.col("ref_id")]


def running_balance(ledger: DataFrame) -> DataFrame:
    """WIN-1 for all customers at once: balance = Σ(debit - credit) up to the row in (date, type, id)."""
    return running_sum(ledger, ["customer_id"], ledger_order(), F.col("debit") - F.col("credit"), "balance",
                       bucket=day_bucket("date")).withColumn("balance", X.money("balance"))


def monthly_statements(ledger: DataFrame) -> DataFrame:
    """RPT-18 for every customer and month: opening (all activity before the month), debits,
    credits and closing.  Opening is a running sum over the (customer, month) totals."""
    m = ledger.withColumn("month", F.trunc(F.to_date("date"), "month"))
    g = m.groupBy("customer_id", "month").agg(F.sum("debit").alias("debits"), F.sum("credit").alias("credits"))
    w = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("opening", F.coalesce(F.sum(F.col("debits") - F.col("credits")).over(w), F.lit(0)))
    return g.select("customer_id", "month", X.money("opening").alias("opening_balance"),
                    X.money("debits").alias("total_debit"), X.money("credits").alias("total_credit"),
                    X.money(F.col("opening") + F.col("debits") - F.col("credits")).alias("closing_balance"))


def missing_ledger_rows(ledger: DataFrame, headers: DataFrame, payments: DataFrame) -> DataFrame:
    """CHG-18 incremental backfill: all-customer sales not in the ledger by transaction id (JN-13),
    payments not in it by (customer, day, description, amount) (JN-14)."""
    s = credit_sales(headers, "all").join(
        ledger.filter(F.col("transaction_id").isNotNull()).select(F.col("transaction_id").alias("id")),
        "id", "left_anti")
    s = s.select("customer_id", F.to_date("created_at").alias("date"),
                 F.concat(F.lit("Sale - "), F.col("receipt_number")).alias("description"),
                 F.lit("sale").alias("type"), X.money("total_amount").alias("debit"), X.money(F.lit(0)).alias("credit"))
    led = ledger.select("customer_id", F.to_date("date").alias("d"), "description", F.col("credit").alias("amt"))
    p = payments.select("customer_id", F.to_date("payment_date").alias("d"),
                        F.lit("Payment Received").alias("description"), X.money("amount").alias("amt"))
    p = p.join(led, ["customer_id", "d", "description", "amt"], "left_anti")
    p = p.select("customer_id", F.col("d").alias("date"), "description", F.lit("payment").alias("type"),
                 X.money(F.lit(0)).alias("debit"), F.col("amt").alias("credit"))
    return s.unionByName(p)


def credit_decisions(headers: DataFrame, customers: DataFrame) -> DataFrame:
    """WIN-11: credit sales in time order; refused when balance + amount > limit; refusals don't count.
    Returns always apply and lower the balance."""
    signed = (X.return_sign() * F.col("total_amount")).cast("decimal(18,2)")
    s = credit_sales(headers, "credit").select("customer_id", F.col("id").alias("sale_id"), "created_at",
                                               signed.alias("total_amount"), (~F.col("is_return")).alias("checked"))
    c = customers.select(F.col("id").alias("customer_id"), "current_balance", "credit_limit")
    ev = s.join(c, "customer_id", "inner")
    r = accept(ev, "customer_id", ["created_at", "sale_id"], "total_amount", "checked",
               "current_balance", "credit_limit", bucket=day_bucket("created_at"))
    return r.select("customer_id", "sale_id", "accepted", "balance_after")


def approvals_queue(customers: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-11 / FLT-18: pending accounts or pending limit increases, with requester name."""
    c = customers.filter((F.col("status") == "Pending") | F.col("pending_credit_limit").isNotNull())
    c = c.join((users.select(F.col("id").alias("created_by"), F.col("name").alias("requested_by"))),
               "created_by", "left")
    return c.select("id", "name", "credit_limit", "pending_credit_limit", "status", "requested_by",
                    F.when(F.col("pending_credit_limit").isNotNull(), "Limit Increase")
                     .otherwise("New Account").alias("request_type"))


def next_account_number(customers: DataFrame) -> DataFrame:
    """AGG-23: MAX over numeric-looking account numbers, plus one."""
    n = customers.filter(F.col("account_number").rlike("^[0-9]+$"))
    return n.agg((F.coalesce(F.max(F.col("account_number").cast("long")), F.lit(0)) + 1).alias("next_account"))


def renumber_accounts(customers: DataFrame) -> DataFrame:
    """WIN-8 re-aimed: customers whose number is not numeric get max+1, max+2, ... in id order.

    The dense sequence comes from per-range-partition counts (two passes), not
    from a window over the whole table in one task.
    """
    start = next_account_number(customers)
    todo = customers.filter(~F.col("account_number").rlike("^[0-9]+$")).select("id", "account_number")
    r = global_row_number(todo, "id", "seq")
    return r.withColumn("next_account", start.scalar()).select(
        "id", F.col("account_number").alias("old_number"),
        (F.col("next_account") + F.col("seq") - 1).cast("string").alias("new_number"))
