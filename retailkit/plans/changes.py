"""Per-request writes of the reference re-aimed as batch jobs over event tables:
returns, credit balances, credit-limit decisions, customer deletion, stock counts and
adjustments, batch back-fill and sales from a chosen batch, shelf moves, transfer confirmation,
company quick sales, invoice payments, promotion re-keying and shift open/close pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.running import day_bucket, running_agg


def post_returns(headers: DataFrame) -> DataFrame:
    """CHG-3: each original sale gets has_returns and current_total = total - Σ refunds."""
    ret = headers.filter(F.col("is_return") & F.col("original_transaction_id").isNotNull()).groupBy(
        F.col("original_transaction_id").alias("id")).agg(F.sum("total_amount").alias("refunded"),
                                                            F.count(F.lit(1)).alias("refunds"))
    j = headers.select("id", "total_amount").join(ret, "id", "inner")
    return j.select("id", F.lit(True).alias("has_returns"), "refunds",
                    X.money(F.col("total_amount") - F.col("refunded")).alias("current_total"))


def credit_balances(customers: DataFrame, ledger: DataFrame) -> DataFrame:
    """CHG-6 / CHG-7: balance += credit sales (debit) and -= payments (credit), per customer."""
    g = ledger.groupBy("customer_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    j = customers.select(F.col("id").alias("customer_id"), "current_balance").join(g, "customer_id", "inner")
    return j.select("customer_id", X.money("current_balance").alias("old_balance"),
                    X.money(F.col("current_balance") + F.col("d") - F.col("c")).alias("new_balance"))


def ledger_rows(customers: DataFrame, running: DataFrame) -> DataFrame:
    """CHG-6 / CHG-7: the ledger rows that posting writes, each with the customer's balance after it."""
    j = running.join(customers.select(F.col("id").alias("customer_id"), "current_balance"), "customer_id")
    return j.select("customer_id", "date", "description", "type", "debit", "credit", "transaction_id",
                    X.money(F.col("current_balance") + F.col("balance")).alias("balance"))


def apply_credit_decisions(customers: DataFrame, decisions: DataFrame) -> DataFrame:
    """CHG-26: the latest decision per customer wins (max_by, an aggregate); approve moves the pending
    limit into the limit and activates a pending account, reject clears it and rejects the account."""
    last = decisions.groupBy("customer_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    j = customers.join(last, customers.id == last.customer_id, "inner")
    appr = F.col("decision") == "approve"
    return j.select(
        "id",
        F.when(appr & F.col("pending_credit_limit").isNotNull(), F.col("pending_credit_limit"))
         .otherwise(F.col("credit_limit")).alias("credit_limit"),
        F.lit(None).cast("decimal(12,2)").alias("pending_credit_limit"),      # cleared either way
        F.when(F.col("status") == "Pending", F.when(appr, "Active").otherwise("Rejected"))
         .otherwise(F.col("status")).alias("status"))


def delete_customers(customers: DataFrame, headers: DataFrame, payments: DataFrame, ledger: DataFrame,
                     doomed: DataFrame) -> DataFrame:
    """CHG-32: remove the customers in ``doomed`` with their payments, ledger rows and sales
    (left anti joins on the delete list); returns the remaining row count of each table."""
    d = doomed.select(F.col("id").alias("customer_id")).distinct()
    keep = {
        "customers": customers.join(d, customers.id == d.customer_id, "left_anti"),
        "payments": payments.join(d, "customer_id", "left_anti"),
        "ledger": ledger.join(d, "customer_id", "left_anti"),
        "sales": headers.join(d, "customer_id", "left_anti"),
    }
    out = None
    for name, df in keep.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def approve_counts(lines: DataFrame, products: DataFrame, approved: DataFrame, mode: str = "delta") -> DataFrame:
    """CHG-14: approved stock takes apply to stock -- add the variance (delta) or set the physical
    count (absolute).  Several approved lines of one product: variances add up, the last count
    (highest stock-take id) sets the absolute value."""
    l = lines.join(approved.select("stock_take_id"), "stock_take_id", "left_semi")
    if mode == "delta":
        g = l.groupBy(F.col("product_barcode").alias("barcode")).agg(F.sum("variance").alias("v"))
        expr = F.coalesce("stock", F.lit(0)) + F.col("v")
    else:
        g = l.groupBy(F.col("product_barcode").alias("barcode")).agg(
            F.max_by("physical_count", "stock_take_id").alias("v"))
        expr = F.col("v")
    j = products.select("barcode", "stock").join(g, "barcode", "inner")
    return j.select("barcode", F.col("stock").alias("old_stock"), expr.cast("long").alias("new_stock"))


def adjustments_from_counts(lines: DataFrame, products: DataFrame) -> DataFrame:
    """CHG-15: a signed adjustment with a reason per counted difference; audit before/after."""
    a = lines.filter(F.col("variance") != 0).groupBy(F.col("product_barcode").alias("barcode")).agg(
        F.sum("variance").alias("qty"))
    j = products.select("barcode", F.coalesce("stock", F.lit(0)).alias("before")).join(a, "barcode", "inner")
    return j.select("barcode", F.when(F.col("qty") > 0, "Found").otherwise("Damaged").alias("reason"),
                    F.col("qty").cast("long").alias("quantity"), F.col("before").cast("long").alias("quantity_before"),
                    (F.col("before") + F.col("qty")).cast("long").alias("quantity_after"))


def backfill_batches(batches: DataFrame, default_branch: int = 1) -> DataFrame:
    """CHG-22: available = quantity when 0 or missing; branch defaults to 1."""
    return batches.select(
        "product_barcode", "batch_number",
        F.coalesce("branch_id", F.lit(default_branch)).alias("branch_id"),
        F.when(F.coalesce("quantity_available", F.lit(0)) == 0, F.col("quantity"))
         .otherwise(F.col("quantity_available")).alias("quantity_available"))


def sell_from_batches(batches: DataFrame, picks: DataFrame) -> DataFrame:
    """CHG-29: each pick (barcode, batch, branch, qty) takes from that batch: available -, sold +."""
    g = picks.groupBy("product_barcode", "batch_number", "branch_id").agg(F.sum("qty").alias("q"))
    j = batches.join(g, ["product_barcode", "batch_number", "branch_id"], "inner")
    return j.select("product_barcode", "batch_number", "branch_id",
                    (F.col("quantity_available") - F.col("q")).cast("long").alias("quantity_available"),
                    (F.coalesce("quantity_sold", F.lit(0)) + F.col("q")).cast("long").alias("quantity_sold"))


def shelf_moves(moves: DataFrame, products: DataFrame) -> DataFrame:
    """CHG-28: a move is refused when the product's stock is below its quantity (moves don't use the stock up); accepted
    ones add to the product's shelf quantity."""
    p = products.select("barcode", F.coalesce("stock", F.lit(0)).alias("_stock"))
    ok = moves.join(p, "barcode").filter(F.col("_stock") >= F.col("qty"))
    return ok.groupBy("barcode").agg(F.sum("qty").cast("long").alias("on_shelf"), F.count(F.lit(1)).alias("moves"))


def confirm_transfers(transfers: DataFrame) -> DataFrame:
    """CHG-12: lines in transit get the received quantity as it was given; the transfer is confirmed."""
    t = transfers.filter(F.col("status") == "In Transit")
    return t.select("transfer_id", "to_location", "barcode", F.col("qty").alias("sent"), F.col("received_qty").alias("received"),
                    F.lit("Confirmed").alias("status"))


def quick_sale_stock(sales_items: DataFrame, products: DataFrame, branch: str) -> DataFrame:
    """CHG-23 stock part: the branch key is matched case-insensitively in each product's map (FN-25);
    found -> that key and the total drop, not found -> only the total drops."""
    g = sales_items.groupBy("barcode").agg(F.sum("qty").alias("q"))
    p = products.select("barcode", "stock", "stock_levels",
                        X.map_key_ci("stock_levels", branch).alias("key"))
    j = p.join(g, "barcode", "inner")
    return j.select("barcode", F.col("key").alias("matched_key"),
                    (F.coalesce("stock", F.lit(0)) - F.col("q")).cast("long").alias("new_stock"),
                    F.when(F.col("key").isNotNull(), (F.try_element_at("stock_levels", F.col("key")) - F.col("q")))
                     .cast("long").alias("new_branch_stock"))


def apply_invoice_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """CHG-25: paid += Σ payments; status Paid when paid >= total, else Partially Paid."""
    g = payments.groupBy("invoice_id").agg(F.sum("amount").alias("p"))
    j = invoices.join(g, invoices.id == g.invoice_id, "inner")
    paid = X.money(F.col("paid_amount") + F.col("p"))
    return j.select("id", paid.alias("paid_amount"),
                    F.when(paid >= F.col("total_amount"), "Paid").otherwise("Partially Paid").alias("status"))


def rekey_promotions(promotions: DataFrame, users: DataFrame, code: str, discount: str) -> DataFrame:
    """CHG-31: promotions are restored as they are; one code is made anew for each branch with active users."""
    kept = promotions.filter(F.col("code") != code).select("code", "branch_id", "discount_percentage")
    active = users.filter((F.lower("status") == "active") & F.col("branch_id").isNotNull()).select("branch_id").distinct()
    new = active.select(F.lit(code).alias("code"), "branch_id", F.lit(discount).cast("decimal(5,2)").alias("discount_percentage"))
    return kept.unionByName(new)


def pair_shift_events(events: DataFrame) -> DataFrame:
    """CHG-35: a close event closes the user's open shifts opened before it.  Each open takes the first
    close at or after it: a running minimum over the user's events in reverse time order, computed
    two-level (skew-safe) rather than as one window per user."""
    e = events.withColumn("_close_ts", F.when(F.col("kind") == "close", F.col("ts")))
    order = [F.col("ts").desc(), F.col("kind").asc()]            # at equal times the close comes first
    r = running_agg(e, ["user_id"], order, "_close_ts", "end_time", bucket=-day_bucket("ts"), agg="min")
    return r.filter(F.col("kind") == "open").select("user_id", F.col("ts").alias("start_time"), "end_time")


def product_edits(products: DataFrame, edits: DataFrame, default_branch: str = "Main Warehouse") -> DataFrame:
    """CHG-30: an edit sets the stock of the product's first map key (or the editor's branch when the
    map is empty), recomputes the total as Σ map, keeps tracking flags given as NULL, and may
    rename the barcode (the rename is cascaded to batches by ``rename_batches``)."""
    p = products.select("id", "barcode", "stock_levels", "track_batch")
    j = p.join(edits, "id", "inner")
    key = F.coalesce(F.try_element_at(F.map_keys("stock_levels"), F.lit(1)), F.lit(default_branch))
    new_map = F.map_concat(F.map_filter("stock_levels", lambda k, v: k != key), F.create_map(key, F.col("new_stock")))
    out = j.select("id", F.coalesce("new_barcode", "barcode").alias("barcode"), F.col("barcode").alias("old_barcode"),
                   F.col("new_name").alias("name"), key.alias("stock_key"), new_map.alias("m"),
                   F.coalesce("new_track_batch", "track_batch").alias("track_batch"))
    return out.select("id", "barcode", "old_barcode", "name", "stock_key", X.map_total("m").alias("stock"),
                      "track_batch")


def rename_batches(batches: DataFrame, edited: DataFrame) -> DataFrame:
    """CHG-30 cascade: batches of renamed products take the new barcode."""
    ren = edited.filter(F.col("barcode") != F.col("old_barcode")).select(
        F.col("old_barcode").alias("product_barcode"), F.col("barcode").alias("new_barcode"))
    j = batches.join(ren, "product_barcode", "left")
    return j.select(F.coalesce("new_barcode", "product_barcode").alias("product_barcode"), "batch_number",
                    "branch_id", "quantity")


def normalise_users(users: DataFrame, branches: DataFrame) -> DataFrame:
    """CHG-21: missing status -> 'Active'; e-mail and role lower-cased; a missing store id is filled
    from the branch whose name or location equals the user's store text (case-insensitive, JN-16),
    lowest branch id when several match.  The OR condition is two equi-joins, not a nested loop."""
    b = branches.select(F.col("id").cast("int").alias("bid"), F.lower("name").alias("ln"),
                        F.lower("location").alias("ll"))
    u = users.withColumn("_l", F.lower("store_location"))
    m1 = u.join(b, F.col("_l") == F.col("ln")).select("id", "bid")
    m2 = u.join(b, F.col("_l") == F.col("ll")).select("id", "bid")
    best = m1.unionByName(m2).groupBy("id").agg(F.min("bid").alias("bid"))
    j = u.join(best, "id", "left")
    return j.select("id", F.lower("email").alias("email"), F.lower("role").alias("role"),
                    F.coalesce("status", F.lit("Active")).alias("status"), "store_location",
                    F.coalesce(F.col("store_id"), F.col("bid")).alias("store_id"))


def adjustment_history(lines: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """JN-4 / RPT-36: adjustments x products (inner: name) left-joined to the adjusting user."""
    a = lines.filter(F.col("variance") != 0).select(
        "stock_take_id", F.col("product_barcode").alias("barcode"), F.col("variance").alias("quantity"),
        (F.col("stock_take_id") % 20).alias("adjusted_by"))
    j = a.join(products.select("barcode", "name"), "barcode", "inner").join(
        (users.select(F.col("id").alias("adjusted_by"), F.col("name").alias("user_name"))),
        "adjusted_by", "left")
    return j.select("stock_take_id", "barcode", "name", "quantity", "user_name")
