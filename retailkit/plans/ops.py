"""Operations: audit views, branches, receipt lookup, invoices, promotions,
transfers, procurement, snapshot upserts and the aggregate export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.baskets import settle_baskets
from retailkit.operators.chunk_fold import accept
from retailkit.operators.running import day_bucket
from retailkit.operators.nest import nest
from retailkit.operators.topk import top_k
from retailkit.operators.upsert import upsert
from retailkit.plans.sales import items_of


# -- audit (RPT-33, JN-17, FN-29, FN-30, WIN-10) ----------------------------------
def details_text(c="details") -> Column:
    """FN-30: probe known keys of the JSON details, else generic 'Key: value, ...'."""
    fields = ("total", "receiptNumber", "originalTransactionId", "itemCount", "name", "barcode", "stock", "role", "email")
    known = F.from_json(F.col(c), ", ".join(f"{k} STRING" for k in fields))
    g = known.getField
    total, rn, ot, ic = g("total"), g("receiptNumber"), g("originalTransactionId"), g("itemCount")
    name, bc, stock, role, email = g("name"), g("barcode"), g("stock"), g("role"), g("email")
    entries = F.map_entries(F.from_json(F.col(c), "map<string,string>"))
    generic = F.array_join(F.transform(entries, lambda e: F.concat(
        F.upper(F.substring(e["key"], 1, 1)), e["key"].substr(F.lit(2), F.length(e["key"])), F.lit(": "), e["value"])), ", ")
    return (F.when(F.col(c).isNull(), F.lit(""))
            .when(total.isNotNull() & rn.isNotNull() & ot.isNotNull(),
                  F.concat(F.lit("Return Receipt #"), rn, F.lit(", Total: -"), total, F.lit(", Items: "), ic,
                           F.lit(", Original Transaction: "), ot))
            .when(rn.isNotNull() & total.isNotNull() & ot.isNull(),
                  F.concat(F.lit("Receipt #"), rn, F.lit(", Total: "), total, F.lit(", Items: "), ic))
            .when(name.isNotNull() & bc.isNotNull() & stock.isNotNull(),
                  F.concat(F.lit("Product: "), name, F.lit(" ("), bc, F.lit("), Stock Level: "), stock))
            .when(name.isNotNull() & bc.isNotNull(), F.concat(F.lit("Product: "), name, F.lit(" ("), bc, F.lit(")")))
            .when(role.isNotNull() & email.isNotNull(), F.concat(F.lit("Role: "), role))
            .otherwise(F.coalesce(generic, F.col(c))))


def activity_feed(activity: DataFrame, users: DataFrame, company_users: DataFrame, k: int | None = 200) -> DataFrame:
    """Activity with actor = staff name, else company name (staff first on id clashes, T20)."""
    u = users.select(F.col("id").alias("uid"), F.col("name").alias("staff_name"), "role")
    cu = company_users.select(F.col("id").alias("cuid"), "company_name")
    j = (activity.join(u, F.col("user_id") == F.col("uid"), "left")
         .join(cu, F.col("user_id") == F.col("cuid"), "left"))
    out = j.select("id", "created_at", "action", X.action_label("action").alias("action_label"),
                   F.coalesce("staff_name", "company_name").alias("user_name"),
                   F.when(F.col("role").isNotNull(), F.col("role")).when(F.col("cuid").isNotNull(), "Company")
                    .otherwise("System").alias("user_role"),
                   details_text("details").alias("details_text"))
    if k is None:
        return out
    return top_k(out, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], k)


def movement_deltas(audit: DataFrame) -> DataFrame:
    """WIN-10: delta = after - before and its direction label."""
    d = F.col("quantity_after") - F.col("quantity_before")
    return audit.select("reference_id", "pos", "barcode", "action_type", d.alias("delta"),
                        F.when(d > 0, "Qty Added").when(d < 0, "Qty Removed").otherwise("Change").alias("change"))


# -- branches (RPT-34, FLT-6, JN-16) ------------------------------------------------
def branch_list(branches: DataFrame, settings: DataFrame) -> DataFrame:
    s = settings.select(F.col("branch_id").cast("long").alias("id"), "vat_rate", "monthly_target")
    j = branches.join(s, "id", "left")
    return j.select("id", "name", "location", F.coalesce("vat_rate", X.dec("15.00", 5, 2)).alias("vat_rate"),
                    "monthly_target")


def resolve_branch(inputs: DataFrame, branches: DataFrame, col: str = "input") -> DataFrame:
    """Branch by name OR location, letter for letter; lowest id wins; no match keeps the input.

    The OR condition becomes two equi-joins (broadcast of the bounded branch
    table) and a union, so no nested-loop join is needed.
    """
    i = inputs.select(F.col(col).alias("input")).distinct()
    by_name = i.join(branches, F.col("input") == F.col("name")).select("input", "id", "name")
    by_loc = i.join(branches, F.col("input") == F.col("location")).select("input", "id", "name")
    best = by_name.unionByName(by_loc).groupBy("input").agg(F.min_by(F.struct("id", "name"), "id").alias("m"))
    j = i.join(best, "input", "left")
    return j.select("input", F.col("m.id").alias("branch_id"),
                    F.coalesce(F.col("m.name"), F.col("input")).alias("branch_name"))


# -- receipts (FLT-20, JN-18, RPT-39) ------------------------------------------------
def receipt_lookup(requests: DataFrame, headers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Numeric text -> transaction id; other text -> receipt number, both of completed sales;
    not found -> invoice number or id."""
    r = requests.select("request").distinct()
    headers = headers.filter(F.col("status") == "completed")
    numeric = F.col("request").rlike("^[0-9]+$")
    by_id = (r.filter(numeric).join(headers.select(F.col("id").cast("string").alias("request"), "id", "total_amount"),
                                    "request", "left"))
    by_rcp = (r.filter(~numeric).join(headers.select(F.col("receipt_number").alias("request"), "id", "total_amount"),
                                      "request", "left"))
    found = by_id.unionByName(by_rcp)
    # an invoice is found by its number or its id; of several the one with the lowest id
    key = F.explode(F.array(F.col("invoice_number"), F.col("id").cast("string"))).alias("request")
    inv = (invoices.select("id", "total_amount", key).groupBy("request")
           .agg(F.min(F.struct("id", "total_amount")).alias("i")).select("request", F.col("i.id").alias("inv_id"), F.col("i.total_amount").alias("inv_total")))
    j = found.join(inv, "request", "left")
    return j.select("request",
                    F.when(F.col("id").isNotNull(), "transaction").when(F.col("inv_id").isNotNull(), "invoice")
                     .otherwise("none").alias("source"),
                    F.coalesce("id", "inv_id").alias("found_id"),
                    X.money(F.coalesce("total_amount", "inv_total")).alias("total_amount"))


def barcode_lookup(requests: DataFrame, products: DataFrame) -> DataFrame:
    """RPT-39 for a batch of (barcode, branch): branch stock when the key exists, else total stock."""
    j = requests.join(products.select("barcode", "stock", "stock_levels"), "barcode", "inner")
    has = F.map_contains_key("stock_levels", F.col("branch"))
    return j.select("barcode", "branch",
                    F.when(has, F.try_element_at("stock_levels", F.col("branch"))).otherwise(F.col("stock")).alias("stock"),
                    F.when(has, "branch").otherwise("total").alias("source"))


# -- invoices (SET-1, AGG-30, CHG-24, RPT-38) ------------------------------------------
def recent_invoices(invoices: DataFrame, k: int = 10) -> DataFrame:
    pro = invoices.filter(F.col("kind") == "proforma").select(
        "id", "invoice_number", F.lit("Proforma").alias("type"), "total_amount", F.col("issue_date").alias("date"))
    sal = invoices.filter(F.col("kind") == "sales").select(
        "id", "invoice_number", F.lit("Sales Invoice").alias("type"), "total_amount", F.col("issue_date").alias("date"))
    return top_k(pro.unionByName(sal), [F.col("date").desc_nulls_first(), F.col("id").desc()], k)


def company_dashboard(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """AGG-30 for every company: its invoices, and the credit position of all customers.

    Outstanding counts invoices that are not paid; pending payments are draft proformas.  Credit owed, usage and debtors
    are over the whole customer table, as every company sees them."""
    sales, pro = F.col("kind") == "sales", F.col("kind") == "proforma"
    a = invoices.groupBy("company_id").agg(
        F.count_if(pro).alias("proformas"), F.count_if(sales).alias("sales_invoices"),
        X.money_sum(F.when(sales, F.col("total_amount")), zero=True).alias("total_revenue"),
        X.money_sum(F.when(sales & (F.col("status") != "Paid"), F.col("total_amount") - F.col("paid_amount")), zero=True).alias("outstanding"),
        F.count_if(pro & (F.lower("status") == "draft")).alias("pending_payments"))
    owed, limit = F.coalesce(F.sum("current_balance"), F.lit(0)), F.coalesce(F.sum("credit_limit"), F.lit(0))
    usage = F.round(F.when(limit > 0, owed.cast("double") * 100 / limit.cast("double")).otherwise(0.0), 1)
    return a.select("company_id", "proformas", "sales_invoices", "total_revenue", "outstanding", "pending_payments",
                    customers.agg(X.money(owed).alias("v")).scalar().alias("total_credit_owed"),
                    customers.agg(usage.alias("v")).scalar().alias("credit_usage_pct"),
                    customers.agg(F.count_if(F.col("current_balance") > 0).alias("v")).scalar().alias("active_debtors"))


def convert_proformas(invoices: DataFrame, as_of, due_days: int = 30) -> DataFrame:
    """CHG-24: every draft proforma becomes a sales invoice due ``due_days`` after conversion."""
    p = invoices.filter((F.col("kind") == "proforma") & (F.col("status") == "Draft"))
    return p.select("id", F.col("invoice_number").alias("proforma_number"),
                    F.concat(F.lit("INV-"), F.col("id").cast("string")).alias("invoice_number"),
                    X.lit_date(as_of).alias("issue_date"), F.date_add(X.lit_date(as_of), due_days).alias("due_date"),
                    "subtotal", "tax_amount", "total_amount", F.lit("Unpaid").alias("status"))


def invoice_documents(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """RPT-38 / JN-25 / SRC-6: header + nested lines; returned with per-document line stats."""
    l = lines.select(F.col("sale_id").alias("id"), "barcode", "qty", "price")
    doc = nest(invoices.select("id", "invoice_number", "kind"), l, "id", "items", order=["barcode", "qty", "price"])
    return doc.select("id", "invoice_number", "kind", F.size("items").alias("n_lines"),
                      X.money(F.aggregate("items", F.lit(0).cast("decimal(20,2)"),
                                          lambda a, i: (a + i["qty"] * i["price"]).cast("decimal(20,2)")))
                      .alias("items_total"))


# -- promotions (CHG-4, RPT-31, RPT-37, AGG-33, CHG-31) ----------------------------------
def discount_changes(headers: DataFrame, lines: DataFrame, branches: DataFrame) -> DataFrame:
    """(code, branch_id, change): the discount of every sale with a code, negative for returns; no discount, no row.
    A sale without a known branch counts for branch 1."""
    given = lines.groupBy("sale_id").agg(F.sum("discount").alias("_given"))
    s = headers.filter(F.col("promo_code").isNotNull()).join(given, F.col("id") == F.col("sale_id")).filter(F.col("_given") > 0)
    s = s.join(branches.select(F.col("name").alias("store_location"), F.col("id").cast("int").alias("_branch")), "store_location", "left")
    return s.select(F.col("promo_code").alias("code"), F.coalesce("_branch", F.lit(1)).alias("branch_id"),
                    (X.return_sign() * F.col("_given")).alias("change"))


def promo_usage(changes: DataFrame) -> DataFrame:
    """CHG-4: discounted total per (code, branch)."""
    return changes.groupBy("code", "branch_id").agg(X.money_sum("change").alias("total_discounted"))


def promo_totals(promotions: DataFrame, changes: DataFrame) -> DataFrame:
    """CHG-4: every promotion with its discounted total over all branches."""
    g = changes.groupBy("code").agg(F.sum("change").alias("_sum"))
    return promotions.join(g, "code", "left").select("code", "discount_percentage", "branch_id", X.money(F.coalesce("_sum", F.lit(0))).alias("total_discounted"))


def promotions_for_branch(promotions: DataFrame, usage: DataFrame, branch_id: int) -> DataFrame:
    """RPT-31: promotions of the branch or global (FLT-2), with that branch's usage (JN-6: the
    branch predicate is part of the join condition, so promotions without usage stay)."""
    p = promotions.filter((F.col("branch_id") == branch_id) | F.col("branch_id").isNull())
    u = usage.filter(F.col("branch_id") == branch_id).select("code", F.col("total_discounted").alias("_used"))
    return p.join(u, "code", "left").select("code", "discount_percentage", "branch_id",
                                            X.money(F.coalesce("_used", F.lit(0))).alias("total_discounted"))


def promo_validity(headers: DataFrame, promotions: DataFrame, branches: DataFrame) -> DataFrame:
    """RPT-37 for every sale carrying a code: valid when the code exists for its branch or globally."""
    b = branches.select(F.col("name").alias("store_location"), F.col("id").cast("int").alias("sale_branch"))
    s = headers.filter(F.col("promo_code").isNotNull()).join(b, "store_location", "left")
    p = promotions.select(F.col("code").alias("promo_code"), F.col("branch_id").alias("promo_branch"),
                          F.lit(True).alias("_hit"))
    j = s.join(p, "promo_code", "left")
    ok = F.coalesce(F.col("_hit"), F.lit(False)) & \
        (F.col("promo_branch").isNull() | (F.col("promo_branch") == F.col("sale_branch")))
    return j.select("id", "promo_code", F.coalesce(ok, F.lit(False)).alias("valid"))


def users_per_branch(branches: DataFrame, users: DataFrame) -> DataFrame:
    """AGG-33: active users per branch (LEFT JOIN keeps empty branches)."""
    u = users.filter(F.col("status") == "active").select(F.col("store_location").alias("name"), F.col("id").alias("uid"))
    return branches.join(u, "name", "left").groupBy("id", "name").agg(
        F.count("uid").alias("active_users"))


# -- transfers (CHG-10, CHG-11, FN-26, SET-5) ------------------------------------------------
def with_alias_keys(transfers: DataFrame, branches: DataFrame) -> DataFrame:
    """``transfers`` with ``keys``, the alias keys of the source: of a branch its name, the text given and its location, else the text given.

    The texts that mean a branch come from the branch table, which is small, and meet the lines by broadcast: sources are few, so lines dealt by
    source would be a few tasks'."""
    texts = branches.select(F.explode(F.array("name", "location")).alias("input")).filter("input IS NOT NULL")
    b = branches.select(F.col("name").alias("branch_name"), F.col("location").alias("b_location"))
    named = resolve_branch(texts, branches).join(b, "branch_name", "left").select(
        F.col("input").alias("from_location"),
        F.array_distinct(F.filter(F.array("branch_name", "input", "b_location", "branch_name"),
                                  lambda x: x.isNotNull())).alias("keys"))
    given = F.when(F.col("from_location").isNotNull(), F.array("from_location"))
    return transfers.join(F.broadcast(named), "from_location", "left").withColumn("keys", F.coalesce("keys", given))


def transfer_decisions(transfers: DataFrame, products: DataFrame, branches: DataFrame) -> DataFrame:
    """CHG-10: the source stock of an item is the sum over the alias keys of the source (its
    resolved name, the raw input, the branch's location and name, de-duplicated, SET-5); a
    transfer is dispatched only if every item fits (bool_and).  Items are checked against the
    current snapshot; transfers are independent of each other (not a sequential fold)."""
    t = with_alias_keys(transfers, branches)
    t = t.join(products.select("barcode", "stock_levels"), "barcode", "left")
    avail = F.aggregate("keys", F.lit(0), lambda a, k: a + F.coalesce(F.try_element_at("stock_levels", k), F.lit(0)))
    t = t.withColumn("available", avail)
    return t.groupBy("transfer_id").agg(
        F.bool_and(F.col("stock_levels").isNotNull() & (F.col("available") >= F.col("qty"))).alias("dispatched"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("stock_levels").isNull() | (F.col("available") < F.col("qty"))).alias("short_items"))


def transfer_fold(transfers: DataFrame, products: DataFrame, branches: DataFrame) -> DataFrame:
    """CHG-10, sequential form: transfers from one source are dispatched in time order, all or
    nothing, and an accepted transfer lowers what later ones can take (per product, over the
    source's alias keys).  A transfer is the lines of one (source, transfer id); its time is its
    earliest line.  Decided in parallel rounds (``operators/baskets.py``); an unknown product has no stock."""
    t = with_alias_keys(transfers, branches).join(products.select("barcode", "stock_levels"), "barcode", "left")
    avail = F.when(F.col("stock_levels").isNotNull(), F.aggregate(
        "keys", F.lit(0), lambda a, k: a + F.coalesce(F.try_element_at("stock_levels", k), F.lit(0))))
    # sources and items are keys without nulls in the rounds; a mark keeps a null apart from every text
    source, item = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("from_location", "barcode")]
    t = t.select(source.alias("source"), "transfer_id", item.alias("item"), "qty", "created_at", F.coalesce(avail, F.lit(0)).alias("available"))
    done = settle_baskets(t, "source", ["transfer_id"], "created_at", "item", "qty", "available", day_bucket)
    told = done.groupBy("source", "transfer_id").agg(F.first("accepted").alias("accepted"), F.sum("lines").alias("lines"))
    return told.select(F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("from_location"), "transfer_id", "accepted", "lines")


def transfer_receipts(transfers: DataFrame) -> DataFrame:
    """CHG-11: only 'In Transit' transfers add to the destination key (and the total)."""
    t = transfers.filter(F.col("status") == "In Transit")
    return t.groupBy("barcode", "to_location").agg(F.sum("qty").cast("long").alias("received"))


def pos_stock_decisions(sales: DataFrame, products: DataFrame) -> DataFrame:
    """WIN-12: sale lines in time order take from the product's stock; a line that does not fit
    is refused and does not consume stock."""
    it = items_of(sales.filter(F.lower("status") == "completed")).select(
        F.col("id").alias("sale_id"), "created_at", "pos", "barcode", F.col("qty").cast("decimal(18,2)").alias("qty"))
    p = products.select("barcode", F.lit(0).cast("decimal(18,2)").alias("used"),
                        F.greatest(F.coalesce("stock", F.lit(0)), F.lit(0)).cast("decimal(18,2)").alias("available"),
                        F.lit(True).alias("checked"))
    ev = it.join(p, "barcode", "inner")
    r = accept(ev, "barcode", ["created_at", "sale_id", "pos", "qty"], "qty", "checked", "used", "available", bucket=day_bucket("created_at"))
    return r.select("sale_id", "pos", "barcode", "accepted", F.col("balance_after").alias("used_after"))


# -- procurement (RPT-32, CHG-8, CHG-9, CHG-27, FN-10, FN-11) ----------------------------------
def po_listing(po_lines: DataFrame, suppliers: DataFrame, branches: DataFrame) -> DataFrame:
    h = po_lines.groupBy("po_id", "supplier_id").agg(F.count(F.lit(1)).alias("n_items"),
                                                      F.sum("quantity").cast("long").alias("total_qty"),
                                                      F.min("order_date").alias("order_date"))
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "branch_id")
    b = branches.select(F.col("id").cast("int").alias("branch_id"), F.col("name").alias("branch_name"))
    return h.join(s, "supplier_id", "left").join(b, "branch_id", "left").select(
        "po_id", "supplier_id", "supplier_name", "branch_name", "n_items", "total_qty", "order_date")


def batch_code(supplier_name, received, product_name, expiry):
    """FN-11: SUP-YYMMDD-ITM-YYMMDD (first three letters upper-cased)."""
    return F.concat_ws("-", F.upper(F.substring(supplier_name, 1, 3)), F.date_format(received, "yyMMdd"),
                       F.upper(F.substring(product_name, 1, 3)), F.date_format(expiry, "yyMMdd"))


def po_batches(po_lines: DataFrame, suppliers: DataFrame, products: DataFrame, shelf_days: int = 365) -> DataFrame:
    """CHG-8: received lines become batches with generated codes; codes that clash within a
    product get a -2, -3, ... suffix in (expiry, po) order."""
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    p = products.select("barcode", F.col("name").alias("product_name"))
    j = po_lines.join(s, "supplier_id", "left").join(p, "barcode", "inner")
    exp = F.date_add(F.to_date("order_date"), shelf_days)
    j = j.withColumn("expiry_date", exp).withColumn(
        "code", batch_code(F.col("supplier_name"), F.col("order_date"), F.col("product_name"), F.col("expiry_date")))
    w = Window.partitionBy("barcode", "code").orderBy("expiry_date", "po_id", "supplier_id")
    n = F.row_number().over(w)
    return j.select("po_id", "supplier_id", "barcode", "quantity", "expiry_date",
                    F.when(n == 1, F.col("code")).otherwise(F.concat(F.col("code"), F.lit("-"), n.cast("string")))
                    .alias("batch_code"))


def goods_received(po_lines: DataFrame, products: DataFrame) -> DataFrame:
    """CHG-9: units = packages x conversion rate; a batch only for batch-tracked products."""
    j = po_lines.join(products.select("barcode", "conversion_rate", "track_batch"), "barcode", "inner")
    return j.select("po_id", "barcode", F.col("quantity").alias("packages"),
                    (F.col("quantity") * F.coalesce("conversion_rate", X.dec("1.00"))).cast("decimal(18,2)").alias("units"),
                    F.coalesce("track_batch", F.lit(False)).alias("creates_batch"))


def price_list(products: DataFrame, items: DataFrame) -> DataFrame:
    """CHG-27 / FN-10: a list item's selling price is the product's cost plus the item's markup; no cost counts as 0."""
    factor = 1 + F.col("markup_percentage").cast("decimal(8,2)") / X.dec("100", 5, 2)
    cost = F.coalesce("cost_price", F.lit(0))
    j = items.join(products.select("barcode", "cost_price"), "barcode")
    return j.select("barcode", "cost_price", "markup_percentage", X.money(F.round(cost * factor, 2)).alias("selling_price"))


# -- snapshot upserts (CHG-33, CHG-34) --------------------------------------------------------
def batch_upsert(batches: DataFrame, received: DataFrame) -> DataFrame:
    """CHG-33: received batches overwrite or join the batch table on (product, number, branch)."""
    t = batches.select("product_barcode", "batch_number", "branch_id", "quantity", "quantity_available")
    ch = received.select("product_barcode", "batch_number", "branch_id", "quantity", F.col("quantity").alias("quantity_available"))
    return upsert(t, ch, ["product_barcode", "batch_number", "branch_id"], "overwrite").withColumnRenamed("_action", "action")


def settings_upsert(settings: DataFrame, branches: DataFrame) -> DataFrame:
    """CHG-34: per-branch settings where NULL keeps the old value."""
    ch = branches.select(F.col("id").cast("int").alias("branch_id"),
                         F.when(F.col("id") % 2 == 0, X.dec("15.00", 5, 2)).alias("vat_rate"),
                         F.lit(None).cast("decimal(12,2)").alias("monthly_target"))
    return upsert(settings, ch, ["branch_id"], "keep_if_null").drop("_action")


# -- export (SRC-5) ------------------------------------------------------------------------------
def export_rows(headers: DataFrame, branches: DataFrame) -> DataFrame:
    """Monthly branch metrics unpivoted to {dataElement, period, orgUnit, value} rows."""
    s = headers.filter(F.lower("status") == "completed")
    b = branches.select(F.col("name").alias("store_location"),
                                    F.concat(F.lit("OU"), F.col("id").cast("string")).alias("orgUnit"))
    g = (s.join(b, "store_location", "inner")
         .groupBy("orgUnit", F.date_format("created_at", "yyyyMM").alias("period"))
         .agg(X.money_sum("total_amount").cast("string").alias("revenue"),
              F.count(F.lit(1)).cast("string").alias("transactions")))
    return g.unpivot(["orgUnit", "period"], ["revenue", "transactions"], "metric", "value").select(
        F.when(F.col("metric") == "revenue", "DE_REVENUE").otherwise("DE_TXN_COUNT").alias("dataElement"),
        "period", "orgUnit", "value")
