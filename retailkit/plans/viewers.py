"""Reports for all viewers at once (FLT-1, FLT-4, RPT-32, RPT-35): what each may see is a policy table, joined by equality.

A policy has a row per viewer and key that the viewer may see.  Rows are aggregated by key before they meet it, with the sum over all keys under
``ALL``, so a viewer who may see everything meets one row, and the work doesn't grow with viewers times rows.

Viewers: viewer_id, viewer_type ('staff' or 'company'), role, store_id.  A store of NULL or 0 counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailkit.functions.scope import UNRESTRICTED_ROLES
from retailkit.operators.topk import page_size

ALL = "*"


def own_store():
    return F.nullif("store_id", F.lit(0))


def strict_policy(viewers: DataFrame) -> DataFrame:
    """FLT-1: (viewer_id, scope_key): admins, CEOs and viewers without a store see all keys, others their store's."""
    free = F.coalesce(F.col("role").isin(*UNRESTRICTED_ROLES), F.lit(False)) | own_store().isNull()
    return viewers.select("viewer_id", F.when(free, F.lit(ALL)).otherwise(own_store().cast("string")).alias("scope_key"))


def global_policy(viewers: DataFrame) -> DataFrame:
    """FLT-4: (viewer_id, scope_key): the viewer's branch (1 without one); staff see those of branch 1 too, company viewers don't."""
    own = F.coalesce(own_store(), F.lit(1)).cast("int")
    keys = F.when(F.col("viewer_type") == "company", F.array(own)).otherwise(F.array_distinct(F.array(own, F.lit(1))))
    return viewers.select("viewer_id", F.explode(keys).alias("scope_key"))


def order_headers(po_lines: DataFrame, suppliers: DataFrame, branches: DataFrame) -> DataFrame:
    """RPT-32: a row per purchase order (po_id, supplier_id) with supplier, branch, status, items, quantity and date."""
    h = po_lines.groupBy("po_id", "supplier_id").agg(F.min("status").alias("status"), F.count(F.lit(1)).alias("n_items"),
                                                      F.sum("quantity").cast("long").alias("total_qty"), F.min("order_date").alias("order_date"))
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), F.col("branch_id").cast("long").alias("branch_id"))
    b = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    return h.join(s, "supplier_id", "left").join(b, "branch_id", "left").select(
        "po_id", "supplier_id", "supplier_name", "branch_id", "branch_name", "status", "n_items", "total_qty", "order_date")


def order_register(headers: DataFrame, limit=None, offset: int = 0) -> DataFrame:
    """RPT-32: a page of the newest purchase orders for every branch and status (at most 200 a page, 50 if no size is asked for)."""
    size = page_size(limit, 200)
    newest = [F.col("order_date").desc_nulls_first(), F.col("po_id").desc(), F.col("supplier_id").desc()]
    ranked = headers.withColumn("position", F.row_number().over(Window.partitionBy("branch_id", "status").orderBy(*newest)))
    return ranked.filter((F.col("position") <= offset + size) & (F.col("position") > offset))


def order_details(po_lines: DataFrame, headers: DataFrame, products: DataFrame) -> DataFrame:
    """RPT-32: every order's lines with their products' names, beside the order's supplier, branch and status; an unknown product has no name."""
    p = products.select("barcode", F.col("name").alias("product_name"))
    return (po_lines.select("po_id", "supplier_id", "barcode", "quantity").join(p, "barcode", "left")
            .join(headers.select("po_id", "supplier_id", "supplier_name", "branch_name", "status"), ["po_id", "supplier_id"]))


def orders_by_viewer(headers: DataFrame, viewers: DataFrame) -> DataFrame:
    """RPT-32 under FLT-1 for every viewer: orders, quantity and newest date of what the viewer may see; zeros if that is nothing."""
    by = headers.rollup("branch_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_qty").alias("total_qty"),
                                         F.max("order_date").alias("newest"), F.grouping("branch_id").alias("_all"))
    by = by.withColumn("scope_key", F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("branch_id").cast("string"))).drop("branch_id", "_all")
    j = strict_policy(viewers).join(by, "scope_key", "left")
    return j.select("viewer_id", "scope_key", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total_qty", F.lit(0)).alias("total_qty"), "newest")


def taxes_by_viewer(tax_rules: DataFrame, settings: DataFrame, viewers: DataFrame) -> DataFrame:
    """RPT-35 under FLT-4 for every viewer: the Active rules of the viewer's keys; VAT at the rate of the viewer's branch (branch 1's where it
    has no settings) if that is positive and no rule that the viewer sees is named VAT."""
    rules = tax_rules.filter(F.col("status") == "Active").select(F.col("branch_id").alias("scope_key"), "name", F.col("rate").cast("double").alias("rate"))
    seen = global_policy(viewers).join(rules, "scope_key").select("viewer_id", "name", "rate")
    rate = settings.select(F.col("branch_id").alias("_own"), F.col("vat_rate").cast("double").alias("_rate"), F.lit(True).alias("_set"))
    first = settings.filter(F.col("branch_id") == 1).agg(F.max(F.col("vat_rate").cast("double")).alias("v")).scalar()
    own = viewers.select("viewer_id", F.coalesce(own_store(), F.lit(1)).cast("int").alias("_own")).join(rate, "_own", "left")
    vat = own.select("viewer_id", F.lit("VAT").alias("name"), F.when(F.col("_set"), F.col("_rate")).otherwise(first).alias("rate")).filter(F.col("rate") > 0)
    named = seen.filter(F.upper("name") == "VAT").select("viewer_id").distinct()
    return vat.join(named, "viewer_id", "left_anti").unionByName(seen)
