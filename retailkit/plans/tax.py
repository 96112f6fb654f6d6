"""Tax: liability by branch and rule, per-transaction tax detail, company totals, applicable rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.functions import exprs as X
from retailkit.sources.adapter import TAX_TYPE


def _taxes(c="tax_breakdown"):
    return F.coalesce(F.col(c), F.array().cast(T.ArrayType(TAX_TYPE)))


def report_rules(tax_rules: DataFrame, settings: DataFrame, viewer_branch: int = 1) -> DataFrame:
    """Columns of the tax report: VAT at the system rate (branch 1 setting, 15 by default)
    followed by the Active rules of the viewer's branch or branch 1 (FLT-4)."""
    vat = system_vat(settings).select(F.col("vat").alias("rate"))
    rules = tax_rules.filter((F.col("status") == "Active") & F.col("branch_id").isin(viewer_branch, 1))
    return vat.select(F.lit("VAT").alias("name"), "rate").unionByName(
        rules.select("name", F.col("rate").cast("double").alias("rate")))


def system_vat(settings: DataFrame) -> DataFrame:
    return settings.filter(F.col("branch_id") == 1).agg(
        F.coalesce(F.max(F.col("vat_rate").cast("double")), F.lit(15.0)).alias("vat"))


def _period(start=None, end=None, as_of=None):
    f = F.col("status") == "completed"
    if start is not None and end is not None:
        return f & (F.col("created_at") >= X.lit_ts(start)) & (F.col("created_at") <= X.day_end_inclusive(end))
    return f & (F.col("created_at") >= X.month_start(as_of).cast("timestamp_ntz"))


def tax_sums(headers_with_tax: DataFrame, settings: DataFrame, **period) -> DataFrame:
    """(branch, kind, tax_name, amount) in one pass and one grouping over the sales.

    Every sale gives a ``gross`` row; a legacy one (NULL breakdown) also its gross for the VAT formula, which is applied to
    the branch's legacy gross (T13); others their breakdown entries (JN-9 explode)."""
    def entry(kind, name, amount):
        return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), amount.cast("decimal(18,2)").alias("amount"))
    total, none = F.col("total_amount"), F.lit(None)
    stored = F.transform("tax_breakdown", lambda t: entry("tax", t["name"], t["amount"]))
    rows = F.concat(F.array(entry("gross", none, total)),
                    F.when(F.col("tax_breakdown").isNull(), F.array(entry("legacy", F.lit("VAT"), total))).otherwise(stored))
    s = headers_with_tax.filter(_period(**period)).select(X.branch_label().alias("branch"), F.explode(rows).alias("e"))
    g = s.groupBy("branch", F.col("e.kind").alias("kind"), F.col("e.name").alias("tax_name")).agg(F.sum("e.amount").alias("sum"))
    g = g.withColumn("sum", F.col("sum").cast("double")).withColumn("vat", system_vat(settings).scalar())
    amount = F.when(F.col("kind") == "legacy", F.col("sum") - F.col("sum") / (1 + F.col("vat") / 100)).otherwise(F.col("sum"))
    return g.select("branch", "kind", "tax_name", amount.alias("amount"))


def tax_amounts(headers_with_tax: DataFrame, settings: DataFrame, **period) -> DataFrame:
    """Per (branch label, tax name): amount."""
    g = tax_sums(headers_with_tax, settings, **period).filter(F.col("kind") != "gross")
    return g.groupBy("branch", "tax_name").agg(F.sum("amount").alias("amount"))


def tax_report(headers_with_tax: DataFrame, settings: DataFrame, **period) -> DataFrame:
    """RPT-16: gross, total tax (all names, T13) and net per branch label."""
    gross = F.col("kind") == "gross"
    j = tax_sums(headers_with_tax, settings, **period).groupBy("branch").agg(
        F.sum(F.when(gross, F.col("amount"))).alias("gross"), F.sum(F.when(~gross, F.col("amount"))).alias("tax"))
    t = F.coalesce("tax", F.lit(0.0))
    return j.select("branch", X.money("gross").alias("gross_revenue"), F.round(t, 2).alias("total_tax"),
                    F.round(F.col("gross") - t, 2).alias("net_revenue"))


def tax_by_rule(headers_with_tax: DataFrame, settings: DataFrame, tax_rules: DataFrame, **period) -> DataFrame:
    """AGG-28: one column per report rule, as rows (branch, rule, amount; 0 when absent).

    Each branch's amounts (a handful of tax names; a missing name counts as "") become one small map, and the rule list, a
    configuration of a few rules, is exploded against it, so the amounts are computed once."""
    amounts = tax_amounts(headers_with_tax, settings, **period)
    named = amounts.groupBy("branch", F.coalesce("tax_name", F.lit("")).alias("k")).agg(F.sum("amount").alias("amount"))
    per_branch = named.groupBy("branch").agg(F.map_from_entries(F.collect_list(F.struct("k", "amount"))).alias("m"))
    rules = report_rules(tax_rules, settings).select(F.col("name").alias("tax_name"), "rate").distinct()
    rule_list = rules.agg(F.array_sort(F.collect_list(F.struct("tax_name", "rate")))).scalar()
    grid = per_branch.select("branch", "m", F.explode(rule_list).alias("r"))
    return grid.select("branch", F.col("r.tax_name").alias("tax_name"), F.col("r.rate").alias("rate"),
                       F.round(F.coalesce(F.try_element_at("m", F.col("r.tax_name")), F.lit(0.0)), 2).alias("amount"))


def tax_rollup(headers_with_tax: DataFrame, **period) -> DataFrame:
    """AGG-27: per-branch totals plus the grand-total row, via ROLLUP."""
    f = (F.col("status") == "completed") & (F.col("created_at") >= X.lit_ts(period["start"])) & \
        (F.col("created_at") <= X.day_end_inclusive(period["end"]))
    s = headers_with_tax.filter(f).select(X.branch_label().alias("branch"), "total_amount",
                                          F.aggregate(_taxes(),
                                                      F.lit(0).cast("decimal(18,2)"),
                                                      lambda a, t: (a + t["amount"]).cast("decimal(18,2)")).alias("tx"))
    g = s.rollup("branch").agg(X.money_sum("total_amount").alias("gross"), X.money_sum("tx").alias("stored_tax"),
                               F.grouping("branch").alias("is_total"))
    return g.select(F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("branch")).alias("branch"),
                    "gross", "stored_tax")


def tax_totals(headers_with_tax: DataFrame, settings: DataFrame, tax_rules: DataFrame, **period) -> DataFrame:
    """AGG-27 / RPT-16 as the tax page shows it, as rows (branch, line, name, amount): gross, net, total tax and every report rule per branch,
    and the TOTAL of each line, by GROUPING SETS.

    The VAT formula is applied to each branch's legacy gross before any total, so the total is the sum of the branches and not the
    formula of the sum.  A rule without an amount is 0; an amount whose name is no report rule counts in the total tax only.
    """
    def part(line, amount, name=F.lit(None)):
        return F.struct(F.lit(line).alias("line"), name.cast("string").alias("name"), amount.cast("double").alias("amount"))
    rules = report_rules(tax_rules, settings).agg(F.sort_array(F.collect_set("name")).alias("r")).scalar()
    amount, name = F.col("amount"), F.col("tax_name")
    gross = F.concat(F.array(part("gross", amount), part("net", amount), part("tax", F.lit(0))), F.transform("_rules", lambda r: part("rule", F.lit(0), r)))
    tax = F.array(part("net", -amount), part("tax", amount), F.when(F.array_contains("_rules", name), part("rule", amount, name)))
    s = tax_sums(headers_with_tax, settings, **period).withColumn("_rules", rules)
    parts = F.when(F.col("kind") == "gross", gross).otherwise(F.filter(tax, lambda e: e.isNotNull()))
    e = s.select("branch", F.explode(parts).alias("e")).select("branch", "e.*")
    g = e.groupingSets([["branch", "line", "name"], ["line", "name"]], "branch", "line", "name").agg(F.sum("amount").alias("amount"), F.grouping("branch").alias("_all"))
    return g.select(F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("branch")).alias("branch"), "line", "name", F.round("amount", 2).alias("amount"))


def transaction_tax(headers_with_tax: DataFrame, settings: DataFrame, users: DataFrame) -> DataFrame:
    """RPT-14 for every sale: stored breakdown when not NULL (even empty), else VAT back-calculated at the rate of the
    cashier's branch, else branch 1's, else 15 (FN-27); amounts as the reference's floats, rounded to cents."""
    rate = settings.select(F.col("branch_id").alias("_branch"), F.col("vat_rate").cast("double").alias("own"))
    first = settings.filter(F.col("branch_id") == 1).agg(F.max(F.col("vat_rate").cast("double")).alias("v")).scalar()
    staff = users.select(F.col("id").alias("user_id"), F.coalesce("branch_id", F.lit(1)).alias("_branch")).join(rate, "_branch", "left")
    s = (headers_with_tax.select("id", "user_id", "total_amount", "tax_breakdown").join(staff.select("user_id", "own"), "user_id", "left")
         .withColumn("vat", F.coalesce("own", first, F.lit(15.0))))
    stored = F.aggregate(_taxes(), F.lit(0.0),
                         lambda a, t: a + t["amount"].cast("double"))
    total = F.col("total_amount").cast("double")
    legacy = total - total / (1 + F.col("vat") / 100)
    tax = F.when(F.col("tax_breakdown").isNull(), legacy).otherwise(stored)
    return s.select("id", "total_amount", F.round(tax, 2).alias("total_tax"), F.round(total - tax, 2).alias("subtotal"),
                    F.when(F.col("tax_breakdown").isNull(), F.concat(F.lit("VAT ("), F.col("vat").cast("string"),
                                                                      F.lit("%)"))).otherwise("stored").alias("source"))


def company_tax_report(transactions: DataFrame, invoices: DataFrame, start, end) -> DataFrame:
    """AGG-29 / JN-22: gross, tax and net of the first company's transactions in a period; the tax is that of the
    transaction's invoice, 0 without one."""
    first = transactions.agg(F.min("company_id").alias("c")).scalar()
    f = (F.col("company_id") == first) & (F.col("transaction_date") >= X.lit_ts(start)) & (F.col("transaction_date") <= X.day_end_inclusive(end))
    i = invoices.select(F.col("id").alias("invoice_id"), "tax_amount")
    j = transactions.filter(f).join(i, "invoice_id", "left").withColumn("_tax", F.coalesce("tax_amount", F.lit(0)))
    return j.agg(X.money_sum("amount", zero=True).alias("gross_sales"), X.money_sum("_tax", zero=True).alias("total_tax"),
                 X.money_sum(F.col("amount") - F.col("_tax"), zero=True).alias("net_sales"), F.count(F.lit(1)).alias("transactions"))


def active_taxes(tax_rules: DataFrame, branches: DataFrame, settings: DataFrame) -> DataFrame:
    """RPT-35 / SET-4 / JN-18 for every branch: Active rules of the branch or branch 1; a VAT row at the branch's own rate
    (else branch 1's) is prepended when that rate is positive and no rule is named VAT."""
    b = branches.select(F.col("id").cast("int").alias("branch_id"))
    rules = tax_rules.filter(F.col("status") == "Active").select(
        F.col("branch_id").alias("rb"), "name", F.col("rate").cast("double").alias("rate"))
    keys = b.select("branch_id", F.explode(F.array_distinct(F.array("branch_id", F.lit(1)))).alias("rb"))
    own = keys.join(rules, "rb").select("branch_id", "name", "rate")
    first = settings.filter(F.col("branch_id") == 1).agg(F.max(F.col("vat_rate").cast("double")).alias("v")).scalar()
    rate = settings.select("branch_id", F.col("vat_rate").cast("double").alias("v"), F.lit(True).alias("_set"))
    vat = (b.join(rate, "branch_id", "left")
           .select("branch_id", F.lit("VAT").alias("name"), F.when(F.col("_set"), F.col("v")).otherwise(first).alias("rate")))
    has_vat = own.filter(F.upper("name") == "VAT").select("branch_id").distinct()
    vat = vat.filter(F.col("rate") > 0).join(has_vat, "branch_id", "left_anti")
    return vat.unionByName(own)
