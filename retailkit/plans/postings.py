"""Postings that change several tables at once: received purchase orders (CHG-8, FN-11), adjustments (CHG-15), counts as of
their time (CHG-13/14), transfers that leave and arrive (CHG-10/11),
stock takes that are approved (CHG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailkit.operators.asof import as_of
from retailkit.operators.baskets import settle_baskets
from retailkit.operators.changeset import tagged
from retailkit.operators.running import day_bucket, running_sum
from retailkit.plans.ops import resolve_branch

FEW = 500_000           # rows of a supplier's key and code, some 50 bytes each
LINE_ORDER = ["received_at", "po_id", "supplier_id", "barcode"]


def year_later(d: Column) -> Column:
    """The same day of the next year; 29 February becomes 1 March."""
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.date_add(F.add_months(d, 12), 1)).otherwise(F.add_months(d, 12))


def short_code(name: Column, default: str) -> Column:
    """FN-11: the first three characters, upper-cased, without white space."""
    filled = F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(name)
    return F.regexp_replace(F.upper(F.substring(filled, 1, 3)), r"\s", "")


def received_lines(lines: DataFrame, suppliers: DataFrame, products: DataFrame, batches: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """The lines of received orders with units, expiry, batch number (FN-11) and ``upto``, the product's units up to the line.

    ``lines``: po_id, supplier_id, barcode, quantity, received_at, branch_id, branch_name, given_number, given_expiry, given_quantity (given by
    hand at the receipt, NULL or 0: not given).  A batch number belongs to the expiry date of the batch that exists, else of the first
    line; a line with the number and another date gets the date as a suffix.  Lines without a barcode or
    branch are left out.  ``heavy``: products whose lines are cut into days (see ``running``).  Up to FEW suppliers are broadcast, so that lines
    dealt by product stay so; of names only the short codes go along.
    """
    s = suppliers.select(F.col("id").alias("supplier_id"), short_code(F.col("name"), "SUP").alias("_supplier"))
    s = F.broadcast(s) if suppliers.limit(FEW + 1).count() <= FEW else s
    p = products.select("barcode", short_code(F.col("name"), "ITEM").alias("_product"), F.coalesce("stock", F.lit(0)).cast("long").alias("stock"), F.lit(True).alias("_known"))
    j = lines.filter("barcode IS NOT NULL AND branch_id IS NOT NULL").join(s, "supplier_id", "left").join(p, "barcode", "left")
    day = F.to_date("received_at")
    j = j.withColumn("units", F.coalesce(F.nullif("given_quantity", F.lit(0)), "quantity").cast("long"))
    j = j.withColumn("expiry_date", F.coalesce("given_expiry", year_later(day))).withColumn("known", F.coalesce("_known", F.lit(False)))
    made = F.concat_ws("-", F.coalesce("_supplier", F.lit("SUP")), F.date_format(day, "yyMMdd"), F.coalesce("_product", F.lit("ITE")), F.date_format("expiry_date", "yyMMdd"))
    j = j.withColumn("number", F.coalesce(F.nullif("given_number", F.lit("")), made))
    j = running_sum(j, ["barcode"], [F.col(c) for c in LINE_ORDER], "units", "upto", bucket=day_bucket("received_at"), heavy=heavy)
    key = ["barcode", "number", "branch_id"]
    # a batch without a date counts as dated 1970-01-01
    has = batches.groupBy(F.col("product_barcode").alias("barcode"), F.col("batch_number").alias("number"), "branch_id").agg(
        F.min(F.coalesce("expiry_date", F.lit("1970-01-01").cast("date"))).alias("_has"))
    j = j.join(has, key, "left")
    first = F.min_by("expiry_date", F.struct(*[c for c in LINE_ORDER if c != "barcode"])).over(Window.partitionBy(*key))
    j = j.withColumn("_owner", F.coalesce("_has", first))
    number = F.when(F.col("_owner") == F.col("expiry_date"), F.col("number")).otherwise(F.concat_ws("-", "number", F.date_format("expiry_date", "yyMMdd")))
    return j.select("po_id", "supplier_id", "barcode", "received_at", "branch_id", "branch_name", "units", "expiry_date", number.alias("batch_number"), "stock", "known", "upto")


def receive_orders(lines: DataFrame, suppliers: DataFrame, products: DataFrame, batches: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """CHG-8: the tagged change set of received orders: product, batch, audit, status, reject.

    A line of an unknown product makes a batch but neither stock nor audit, as in the reference; it is put out as a reject too.  The
    audit row has the product's stock before and after the line, lines in the order of their receipt.
    """
    j = received_lines(lines, suppliers, products, batches, heavy)
    after = (F.col("stock") + F.col("upto")).cast("long")
    known = F.col("known")
    return tagged(j, {
        "product": (known, [F.col("barcode"), F.col("branch_name"), F.col("units")]),
        "batch": (F.lit(True), [F.col("barcode").alias("product_barcode"), F.col("batch_number"), F.col("branch_id"), F.col("expiry_date"), F.col("units")]),
        "audit": (known, [F.lit("Stock In").alias("action_type"), F.col("barcode").alias("product_barcode"), (after - F.col("units")).alias("quantity_before"),
                          after.alias("quantity_after"), F.col("po_id").alias("reference_id"), F.lit("Purchase Order").alias("reference_type"), F.col("branch_id")]),
        "status": (F.lit(True), [F.col("po_id"), F.lit("Received").alias("status")]),
        "reject": (~known, [F.col("po_id"), F.col("barcode"), F.lit("unknown product").alias("reason")]),
    })


def adjust_stock(adjustments: DataFrame, products: DataFrame) -> DataFrame:
    """CHG-15: the tagged change set of adjustments (adjustment_id, barcode, adjustment_type, quantity, reason, branch_id, adjusted_at): the
    adjustment as it was given, the product's deltas, an audit row with stock before and after, rejects of unknown products."""
    branch = F.when(F.col("branch_id") == 2, "Accra Branch").when(F.col("branch_id") == 3, "Kumasi Branch").otherwise("Main Warehouse")
    p = products.select("barcode", F.coalesce("stock", F.lit(0)).cast("long").alias("_stock"), F.lit(True).alias("_known"))
    j = adjustments.join(p, "barcode", "left").withColumn("known", F.coalesce("_known", F.lit(False)))
    j = running_sum(j, ["barcode"], [F.col("adjusted_at"), F.col("adjustment_id")], "quantity", "_upto", bucket=day_bucket("adjusted_at"))
    after, known, units = (F.col("_stock") + F.col("_upto")).cast("long"), F.col("known"), F.col("quantity").cast("long")
    return tagged(j, {
        "adjustment": (F.lit(True), [F.col("adjustment_id"), F.col("barcode"), F.col("adjustment_type"), units.alias("quantity"), F.col("reason"), F.col("branch_id")]),
        "product": (known, [F.col("barcode"), branch.alias("branch_name"), units.alias("units")]),
        "audit": (known, [F.lit("Stock Adjustment").alias("action_type"), F.col("barcode").alias("product_barcode"), (after - units).alias("quantity_before"),
                          after.alias("quantity_after"), F.col("adjustment_id").alias("reference_id"), F.lit("Adjustment").alias("reference_type"), F.col("reason").alias("notes")]),
        "reject": (~known, [F.col("adjustment_id"), F.col("barcode"), F.lit("unknown product").alias("reason")]),
    })


def counts_as_of(counts: DataFrame, movements: DataFrame, products: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """CHG-13/14: variance of a count against the stock when it was counted: the product's opening stock and all movements
    (barcode, moved_at, ref, delta) up to ``counted_at``.  ``heavy``: products whose movements are cut into days (see ``running``)."""
    run = running_sum(movements, ["barcode"], [F.col("moved_at"), F.col("ref")], "delta", "moved", bucket=day_bucket("moved_at"), heavy=heavy)
    asked = as_of(counts, run, ["barcode"], "counted_at", "moved_at", ["ref"], "moved", "moved", day_bucket, heavy)
    p = products.select("barcode", F.coalesce("stock", F.lit(0)).cast("long").alias("_stock"))
    system = (F.col("_stock") + F.coalesce("moved", F.lit(0))).cast("long")
    j = asked.join(p, "barcode").withColumn("system_count", system)
    return j.select("stock_take_id", "barcode", "counted_at", "system_count", F.col("physical_count").cast("long").alias("physical_count"),
                    (F.col("physical_count") - F.col("system_count")).cast("long").alias("variance"))


# -- CHG-10: transfers that leave their source --------------------------------------
def branch_keys(branches: DataFrame) -> DataFrame:
    """(stock_key, source): every name and location of a branch and the name of the branch that it stands for.  A name or location that
    several branches have belongs to the one with the lowest id."""
    both = branches.select("id", "name", F.explode(F.array_distinct(F.array("name", "location"))).alias("stock_key")).filter("stock_key IS NOT NULL AND stock_key <> ''")
    return both.groupBy("stock_key").agg(F.min_by("name", "id").alias("source"))


def levels_by_source(products: DataFrame, keys: DataFrame) -> DataFrame:
    """(barcode, stock_key, source, units): the entries of the stock map with the source that each counts for."""
    levels = products.select("barcode", F.explode("stock_levels").alias("stock_key", "units"))
    j = levels.join(F.broadcast(keys), "stock_key", "left")             # few keys: dealt by key, the entries would be a few tasks'
    return j.select("barcode", "stock_key", F.coalesce("source", "stock_key").alias("source"), F.coalesce("units", F.lit(0)).cast("long").alias("units"))


def dispatch_transfers(transfers: DataFrame, products: DataFrame, branches: DataFrame, **settle) -> DataFrame:
    """CHG-10: the tagged change set of transfer requests (transfer_id, from_location, to_location, barcode, qty, created_at; one row per line).

    A request is the lines of one (from_location, transfer_id).  Requests of one source, under whichever of its names, are decided in time
    order (earliest line, then id, then the name used), all or nothing: every product must be known and the source's stock, all its
    alias keys together, must cover the request after the earlier accepted ones.  Kinds: ``product`` (what leaves, per product and source),
    ``transfer`` (the accepted request's items, In Transit, ends by their branch names), ``reject`` (every line that the request failed on, with what
    was left for it; the reference reports the first).  A null source or barcode counts as the empty text, a null quantity as 0.
    """
    keys = branch_keys(branches)
    ends = keys.select(F.col("stock_key").alias("to_location"), F.col("source").alias("_to"))
    t = transfers.select("transfer_id", F.coalesce("from_location", F.lit("")).alias("from_location"), "to_location", "barcode", F.col("qty").cast("long").alias("qty"), "created_at")
    t = t.join(F.broadcast(keys.withColumnRenamed("stock_key", "from_location")), "from_location", "left").withColumn("source", F.coalesce("source", "from_location"))
    t = t.join(F.broadcast(ends), "to_location", "left").withColumn("to_location", F.coalesce("_to", "to_location"))
    stock = levels_by_source(products, keys).groupBy("barcode", "source").agg(F.sum("units").alias("_units"))
    levels = stock.groupBy("barcode").agg(F.map_from_entries(F.collect_list(F.struct("source", "_units"))).alias("_levels"))        # one entry per source
    known = products.select("barcode", F.lit(True).alias("_known")).join(levels, "barcode", "left")
    t = t.join(known, "barcode", "left").withColumn("available", F.when(F.col("_known"), F.coalesce(F.try_element_at("_levels", F.col("source")), F.lit(0))))
    t = t.withColumn("barcode", F.coalesce("barcode", F.lit(""))).drop("_levels")
    done = settle_baskets(t, "source", ["transfer_id", "from_location"], "created_at", "barcode", "qty", "available", day_bucket, carry=("to_location",), **settle)
    ok, left, unknown = F.col("accepted"), (F.col("available") - F.col("used_before")).cast("long"), F.col("available").isNull()
    line = [F.col("transfer_id"), F.col("from_location").alias("requested_from")]
    return tagged(done, {
        "product": (ok, [F.col("barcode"), F.col("source"), F.col("qty").alias("units")]),
        "transfer": (ok, [*line, F.col("source").alias("from_location"), F.col("to_location"), F.lit("In Transit").alias("status"), F.col("barcode"), F.col("qty")]),
        "reject": (~ok & (unknown | (left < F.col("qty"))), [*line, F.col("barcode"), left.alias("available"), F.col("qty").alias("requested"),
                                                            F.when(unknown, "not found").otherwise("Insufficient stock").alias("reason")]),
    })


def take_from_stock(products: DataFrame, branches: DataFrame, moved: DataFrame) -> DataFrame:
    """Products (barcode, stock, stock_levels, ...) after ``moved`` (barcode, source, units) has left: the total and the source's entry fall, and
    the entries under the source's other names are merged into it.  Products that nothing left keep their map as it is."""
    gone = moved.groupBy("barcode", "source").agg(F.sum("units").alias("_gone"))
    touched = gone.select("barcode").distinct()
    old = levels_by_source(products.join(touched, "barcode", "left_semi"), branch_keys(branches)).join(gone, ["barcode", "source"], "left")
    rows = old.select("barcode", F.when(F.col("_gone").isNotNull(), F.col("source")).otherwise(F.col("stock_key")).alias("k"), "units").unionByName(
        gone.select("barcode", F.col("source").alias("k"), (-F.col("_gone")).alias("units")))
    new = rows.groupBy("barcode", "k").agg(F.sum("units").cast("long").alias("v")).groupBy("barcode").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_levels"))
    j = products.join(new, "barcode", "left").join(gone.groupBy("barcode").agg(F.sum("_gone").alias("_all")), "barcode", "left")
    return (j.withColumn("stock", (F.col("stock") - F.coalesce("_all", F.lit(0))).cast("long"))
            .withColumn("stock_levels", F.coalesce("_levels", F.col("stock_levels").cast("map<string,bigint>"))).drop("_levels", "_all").select(*products.columns))


# -- CHG-11: transfers that arrive ----------------------------------------------------
def receive_transfers(requests: DataFrame, transfers: DataFrame, products: DataFrame, branches: DataFrame) -> DataFrame:
    """CHG-11: the tagged change set of receipts (request_id, transfer_id, role, store_location, requested_at) of transfers (transfer_id, to_location,
    status, barcode, qty; one row per line).

    The first request that is allowed (admin, CEO or the destination branch, by its name without regard to case and outer spaces) receives a transfer in
    transit whose products are all known, whole or not at all; later ones find it processed.  A transfer without a destination can't be received; a null quantity counts as 0.  Kinds: ``product`` (what arrives, per line),
    ``status`` (the received transfers), ``reject`` (request and reason, the first that applies in the reference's order of checks).
    """
    known = products.select("barcode", F.lit(True).alias("_known"))
    lines = transfers.join(known, "barcode", "left")
    heads = lines.groupBy("transfer_id").agg(F.min("status").alias("status"), F.min("to_location").alias("to_location"),
                                             F.bool_and(F.coalesce("_known", F.lit(False))).alias("_all_known"), F.lit(True).alias("_found"))
    at = resolve_branch(requests.select(F.col("store_location").alias("input")), branches).select(F.col("input").alias("store_location"), "branch_name")
    r = requests.join(at, "store_location", "left").join(heads, "transfer_id", "left")
    here = F.lower(F.trim(F.coalesce("branch_name", F.lit("")))) == F.lower(F.trim(F.coalesce("to_location", F.lit(""))))
    allowed = F.lower(F.coalesce("role", F.lit(""))).isin("admin", "ceo") | here
    late = F.lit("Transfer already processed")
    r = r.withColumn("reason", F.when(F.col("_found").isNull(), "Transfer not found").when(~F.col("status").eqNullSafe("In Transit"), late)
                     .when(~allowed, "Unauthorized").when(~F.col("_all_known"), "unknown product").when(F.col("to_location").isNull(), "no destination"))
    turn = F.struct("requested_at", "request_id")
    first = r.filter("reason IS NULL").groupBy("transfer_id").agg(F.min(turn).alias("_first"))
    r = r.join(first, "transfer_id", "left").withColumn("reason", F.when(turn > F.col("_first"), late).otherwise(F.col("reason")))
    done = lines.join(first.select("transfer_id"), "transfer_id")
    arrived = tagged(done, {"product": (F.lit(True), [F.col("barcode"), F.col("to_location").alias("branch_name"), F.coalesce("qty", F.lit(0)).cast("long").alias("units")])})
    answers = tagged(r, {
        "status": (F.col("reason").isNull(), [F.col("transfer_id"), F.lit("Received").alias("status"), F.col("request_id")]),
        "reject": (F.col("reason").isNotNull(), [F.col("request_id"), F.col("transfer_id"), F.col("reason")]),
    })
    return arrived.unionByName(answers, allowMissingColumns=True)


# -- CHG-14: stock takes that are approved ---------------------------------------------
def approve_stock_takes(approvals: DataFrame, lines: DataFrame) -> DataFrame:
    """CHG-14: the tagged change set of approvals (stock_take_id, branch_id, approved_by) of counted lines (stock_take_id, product_barcode,
    physical_count, system_count, variance).

    Kinds: ``product`` (the variance, per product and the take's branch), ``audit`` (system and physical count; also of a barcode that no product has),
    ``status`` (the take with its total variance, 0 without lines).  Lines without a difference, or with none recorded, change nothing.  An
    approval that is given twice applies twice, as in the reference.
    """
    branch = F.when(F.col("branch_id") == 2, "Accra Branch").when(F.col("branch_id") == 3, "Kumasi Branch").otherwise("Main Warehouse")
    j = approvals.join(lines, "stock_take_id").filter("variance <> 0")
    units = F.col("variance").cast("long")
    changes = tagged(j, {
        "product": (F.lit(True), [F.col("product_barcode").alias("barcode"), branch.alias("branch_name"), units.alias("units")]),
        "audit": (F.lit(True), [F.lit("Stock Take Variance").alias("action_type"), F.col("product_barcode"), F.col("system_count").cast("long").alias("quantity_before"),
                                F.col("physical_count").cast("long").alias("quantity_after"), F.col("stock_take_id").alias("reference_id"),
                                F.lit("Stock Take").alias("reference_type"), F.col("approved_by").alias("user_id")]),
    })
    total = lines.groupBy("stock_take_id").agg(F.sum("variance").cast("long").alias("total"))
    takes = approvals.groupBy("stock_take_id").agg(F.max("approved_by").alias("approved_by")).join(total, "stock_take_id", "left")
    status = tagged(takes, {"status": (F.lit(True), [F.col("stock_take_id"), F.lit("Approved").alias("status"), F.col("approved_by"),
                                                    F.coalesce("total", F.lit(0)).cast("long").alias("variance_total")])})
    return changes.unionByName(status, allowMissingColumns=True)
