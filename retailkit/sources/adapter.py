"""Retail tables derived from the supplied TPC-H-style tables.

Each method returns a lazy, typed DataFrame in the shape the retail jobs
read (sales with nested line items, products with a branch->stock map,
expiry-dated batches, shifts, payments, ...).  The same derivation is
written in SQL in ``retailkit.oracle`` so that every job can be checked
against an independent engine.  Nothing here collects or caches; Catalyst
prunes the columns a job does not read.

Join strategy: no hints.  The choice is left to Spark, which broadcasts only
below ``spark.sql.autoBroadcastJoinThreshold`` (a size check on the plan
statistics) and lets AQE re-plan at runtime with skew splitting.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.sources.raw import read_raw

# ---------------------------------------------------------------------------
# Fixed values of the test-data mapping (they must be identical in the SQL
# oracle): payment method per order priority, status per order status,
# tax rule names and rates, branch keys of the stock map, as-of dates.
# ---------------------------------------------------------------------------
PAYMENT_BY_PRIORITY = {
    "1-URGENT": "cash",
    "2-HIGH": "momo",
    "3-MEDIUM": "card",
    "4-NOT SPECIFIED": "credit",
    "5-LOW": "Mobile Money",
}
STATUS_BY_ORDERSTATUS = {"F": "completed", "O": "Completed", "P": "pending"}
VAT_RATE = "15.00"
LEVY_RATE = "2.50"
STOCK_KEYS = ("Main Warehouse", "B1", "B2")
SALES_AS_OF = "2001-06-15"
EVENTS_AS_OF = "2024-01-20"

MONEY = T.DecimalType(10, 2)
def _half() -> Column:
    return F.lit("0.5").cast("decimal(2,1)")

MONEY12 = T.DecimalType(12, 2)

ITEM_TYPE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("price", MONEY),
    T.StructField("cost_price", MONEY),
    T.StructField("discount", MONEY),
])
TAX_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("rate", T.DecimalType(5, 2)),
    T.StructField("amount", MONEY12),
])


def _case(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def _typed_empty_array(elem: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(elem))


class Retail:
    """Accessor for the retail view of one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # e.g. {"orders": spark.readStream...}: the same derivations then run on a stream
        self.overrides = overrides or {}

    def raw(self, name: str) -> DataFrame:
        if name in self.overrides:
            return self.overrides[name]
        return read_raw(self.spark, self.sf_dir, name)

    # -- dimensions ---------------------------------------------------------
    def branches(self) -> DataFrame:
        """nation -> branches(id, name, location); 25 rows by construction."""
        n, r = self.raw("nation"), self.raw("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
                .select(n.n_nationkey.cast("long").alias("id"), n.n_name.alias("name"),
                        r.r_name.alias("location")))

    def users(self) -> DataFrame:
        """Staff: 20 users (sales carry user_id = id % 20); bounded literal dim."""
        rows = [(i, f"staff{i:02d}", "admin" if i == 0 else ("ceo" if i == 1 else "cashier"),
                 i % 5, f"NATION_{i % 5}", "inactive" if i == 19 else "active")
                for i in range(20)]
        return self.spark.createDataFrame(
            rows, "id BIGINT, name STRING, role STRING, branch_id INT, store_location STRING, status STRING")

    def tax_rules(self) -> DataFrame:
        rows = [(1, "VAT", 15.0, None, "Active"), (2, "LEVY", 2.5, 1, "Active"),
                (3, "TOURISM", 1.0, None, "Inactive")]
        return (self.spark.createDataFrame(rows, "id BIGINT, name STRING, rate DOUBLE, branch_id INT, status STRING")
                .withColumn("rate", F.col("rate").cast("decimal(5,2)")))

    def settings(self) -> DataFrame:
        rows = [(1, 12.5, 500000.0), (2, 15.0, 750000.0), (3, 17.5, None)]
        return (self.spark.createDataFrame(rows, "branch_id INT, vat_rate DOUBLE, monthly_target DOUBLE")
                .select("branch_id", F.col("vat_rate").cast("decimal(5,2)").alias("vat_rate"),
                        F.col("monthly_target").cast("decimal(12,2)").alias("monthly_target")))

    def customers(self) -> DataFrame:
        c = self.raw("customer")
        limit = (F.greatest(c.c_acctbal, F.lit(0.0)).cast(MONEY12) * 100).cast(MONEY12)      # in the range of sale totals
        return c.select(
            c.c_custkey.alias("id"), c.c_name.alias("name"),
            F.when(c.c_custkey % 10 == 0, F.concat(F.lit("ACC-"), c.c_custkey.cast("string")))
             .otherwise(c.c_custkey.cast("string")).alias("account_number"),
            limit.alias("credit_limit"),
            F.round(F.abs(c.c_acctbal).cast(MONEY12) * F.lit("0.1").cast("decimal(2,1)"), 2).cast(MONEY12)
             .alias("current_balance"),
            F.when(c.c_custkey % 9 == 0, (limit * 2).cast(MONEY12)).alias("pending_credit_limit"),
            F.when(c.c_custkey % 7 == 0, "Pending").otherwise("Active").alias("status"),
            (c.c_custkey % 20).alias("created_by"),
            c.c_nationkey.alias("branch_id"),
        )

    def products(self) -> DataFrame:
        p = self.raw("part")
        key = p.p_partkey
        three = F.create_map(F.lit(STOCK_KEYS[0]), p.p_size % 7 - 2, F.lit(STOCK_KEYS[1]), p.p_size % 5,
                             F.lit(STOCK_KEYS[2]), p.p_size % 3 - 1)
        two = F.create_map(F.lit(STOCK_KEYS[0]), p.p_size % 7 - 2, F.lit(STOCK_KEYS[1]), p.p_size % 5)
        empty = F.create_map().cast(T.MapType(T.StringType(), T.IntegerType()))
        return p.select(
            key.alias("id"), key.cast("string").alias("barcode"), p.p_name.alias("name"),
            p.p_type.alias("category"), p.p_brand.alias("brand"),
            p.p_retailprice.cast(MONEY).alias("price"),
            F.when(key % 13 == 0, F.lit(None).cast(MONEY))
             .otherwise((p.p_retailprice * 0.7).cast(MONEY)).alias("cost_price"),
            (p.p_size - 5).alias("stock"),
            F.when(key % 19 == 0, empty).when(key % 2 == 0, three).otherwise(two).alias("stock_levels"),
            (1 + p.p_size % 12).cast(MONEY).alias("conversion_rate"),
            F.when(key % 11 == 0, F.lit(None).cast("int")).otherwise(F.lit(10)).alias("reorder_level"),
            (key % 3 != 0).alias("track_batch"),
            (key % 4 != 0).alias("track_expiry"),
        )

    # -- sales --------------------------------------------------------------
    def sale_lines(self) -> DataFrame:
        """One row per line item with the order key (not yet nested)."""
        l = self.raw("lineitem")
        p = self.products().select("id", "barcode", "name", "price", "cost_price")
        j = l.join(p, l.l_partkey == p.id, "inner")
        qty = l.l_quantity.cast("int")
        return j.select(
            l.l_orderkey.alias("sale_id"), l.l_linenumber.alias("line_no"),
            p.id, p.barcode, p["name"], qty.alias("qty"), p.price, p.cost_price,
            F.round(qty * p.price * l.l_discount.cast("decimal(4,2)"), 2).cast(MONEY).alias("discount"),
            F.round(qty * p.price * l.l_tax.cast("decimal(4,2)"), 2).alias("vat_part"),
        )

    def _orders(self, since=None, until=None) -> DataFrame:
        """Orders, optionally pruned to a period on the stored date column.

        ``created_at`` is ``o_orderdate`` plus less than one day, so ``created_at >= since`` implies
        ``o_orderdate > since - 1 day`` and ``created_at <= until`` implies ``o_orderdate <= until``.
        These conservative predicates reach the Parquet scan (PushedFilters, row-group skipping);
        the jobs still apply their exact period filter on ``created_at``.
        """
        o = self.raw("orders")
        if since is not None:
            o = o.filter(F.col("o_orderdate") > F.timestamp_add("DAY", F.lit(-1), F.lit(str(since)).cast("timestamp_ntz")))
        if until is not None:
            o = o.filter(F.col("o_orderdate") <= F.lit(str(until)).cast("timestamp_ntz"))
        return o

    def sale_headers(self, since=None, until=None) -> DataFrame:
        o = self._orders(since, until)
        c = self.raw("customer").select("c_custkey", "c_name", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name")
        j = (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(n, F.col("c_nationkey") == n.n_nationkey, "left"))
        k = F.col("o_orderkey")
        is_return = k % 10 == 3
        cust = F.when(k % 4 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey"))
        return j.select(
            k.alias("id"),
            (k % 20).alias("user_id"),
            cust.alias("customer_id"),
            F.when(cust.isNotNull(), F.col("c_name")).alias("customer_name"),
            F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("store_location"),
            F.col("o_totalprice").cast(MONEY12).alias("total_amount"),
            _case(F.col("o_orderpriority"), PAYMENT_BY_PRIORITY).alias("payment_method"),
            F.concat(F.when(is_return, F.lit("REF-")).otherwise(F.lit("RCP-")), k.cast("string"))
             .alias("receipt_number"),
            _case(F.col("o_orderstatus"), STATUS_BY_ORDERSTATUS).alias("status"),
            is_return.alias("is_return"),
            F.when(is_return, k - 3).alias("original_transaction_id"),
            F.timestamp_add("MINUTE", (k % 1440).cast("int"), F.col("o_orderdate")).alias("created_at"),
            F.when(k % 7 == 0, F.concat(F.lit("PROMO-"), (F.col("o_custkey") % 25 + 1).cast("string")))
             .alias("promo_code"),
        )

    def sales(self, since=None, until=None) -> DataFrame:
        """Sales with nested ``items`` and ``tax_breakdown`` arrays.

        The lines are grouped by order key (one shuffle; a sale's lines are
        one row by the data model) and joined to the headers on the same
        key, so the join reuses that partitioning.
        """
        lines = self.sale_lines()
        nested = lines.groupBy("sale_id").agg(
            F.array_sort(F.collect_list(F.struct(
                "line_no", "id", "barcode", "name", "qty", "price", "cost_price", "discount"))).alias("_items"),
            F.sum("vat_part").alias("_vat"),
        )
        h = self.sale_headers(since, until)
        j = h.join(nested, h.id == nested.sale_id, "left")
        items = F.coalesce(
            F.transform("_items", lambda s: F.struct(*[s[f.name].alias(f.name) for f in ITEM_TYPE.fields])),
            _typed_empty_array(ITEM_TYPE))
        vat = F.coalesce(F.col("_vat"), F.lit(0)).cast(MONEY12)
        vat_row = F.struct(F.lit("VAT").alias("name"), F.lit(VAT_RATE).cast("decimal(5,2)").alias("rate"),
                           vat.alias("amount"))
        levy_row = F.struct(F.lit("LEVY").alias("name"), F.lit(LEVY_RATE).cast("decimal(5,2)").alias("rate"),
                            F.round(vat * _half(), 2).cast(MONEY12).alias("amount"))
        k = F.col("id")
        tax = (F.when(k % 3 == 0, F.lit(None).cast(T.ArrayType(TAX_TYPE)))
               .when((k % 3 == 1) & (k % 5 == 0), _typed_empty_array(TAX_TYPE))
               .when(k % 2 == 0, F.array(vat_row, levy_row))
               .otherwise(F.array(vat_row)))
        return j.select(*[c for c in h.columns], items.alias("items"), tax.alias("tax_breakdown"))

    def sale_items(self, header_cols=("id", "user_id", "customer_id", "store_location", "status", "is_return",
                                      "created_at", "payment_method", "total_amount"),
                   since=None, until=None) -> DataFrame:
        """The lateral unnest of ``sales().items`` (JN-8) with header columns, built straight
        from the flat line table: one shuffle join on the order key, no nest-then-explode.
        ``pos`` is the item's index in the nested array (same order as ``sales()``)."""
        h = self.sale_headers(since, until).select(*header_cols)
        lines = self.sale_lines().withColumnRenamed("id", "item_id").drop("vat_part")
        j = h.join(lines, h["id"] == lines["sale_id"], "inner")
        w = Window.partitionBy("sale_id").orderBy("line_no", "item_id", "qty", "discount")
        return j.withColumn("pos", F.row_number().over(w) - 1).drop("sale_id", "line_no")

    def refunds(self) -> DataFrame:
        s = self.sale_headers().filter("is_return")
        return s.select(
            F.col("id").alias("transaction_id"),
            F.concat(F.lit("RCP-"), F.col("original_transaction_id").cast("string")).alias("original_receipt_number"),
            F.col("receipt_number").alias("refund_receipt_number"),
            F.col("total_amount").cast(MONEY).alias("refund_amount"),
            "payment_method", F.col("user_id").alias("processed_by"), "created_at")

    # -- stock --------------------------------------------------------------
    def batches(self, by_product: bool = False, by_key: bool = False) -> DataFrame:
        """``by_product``: rows of a product in one partition from the start, so that a grouping of batches by product
        needs no second shuffle (batches are nearly as many as lines; a partial grouping would not shrink them).
        ``by_key``: the same for what is joined by (product_barcode, batch_number, branch_id)."""
        code, number, branch = F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("int")
        l = self.raw("lineitem").withColumns({"_barcode": code, "_ship_day": F.to_date("l_shipdate")})
        if by_key:          # l_suppkey moves as two numbers, of which one is the branch
            keys, order = ["_barcode", "_number", "_branch", "_suppkey_high"], F.col("_number").cast("long")
            l = l.select("_barcode", number.alias("_number"), branch.alias("_branch"), F.shiftright("l_suppkey", 32).alias("_suppkey_high"),
                         "l_quantity", "l_shipdate", "_ship_day").repartition(*keys[:3])
            number, branch = F.col("_number"), F.col("_branch")
        else:
            keys, order = ["_barcode", "l_orderkey", "l_suppkey"], F.col("l_orderkey")
            if by_product:
                l = l.select(*keys, "l_quantity", "l_shipdate", "_ship_day").repartition("_barcode")
        g = l.groupBy(*keys).agg(
            F.sum("l_quantity").cast("int").alias("quantity"),
            F.max("_ship_day").alias("_last_ship"),
            F.min("l_shipdate").alias("created_at"))
        return g.select(
            F.col("_barcode").alias("product_barcode"),
            number.alias("batch_number"),
            F.when(order % 50 == 0, F.lit(None).cast("date"))
             .otherwise(F.col("_last_ship")).alias("expiry_date"),
            "quantity",
            F.col("quantity").alias("quantity_received"),
            F.col("quantity").alias("quantity_available"),
            F.lit(0).alias("quantity_sold"),
            branch.alias("branch_id"),
            F.lit("Active").alias("status"),
            "created_at",
        )

    def line_products(self, name: str = "barcode") -> DataFrame:
        """The product of every line item: no table that is made of lines has more rows of a product than this."""
        return self.raw("lineitem").select(F.col("l_partkey").cast("string").alias(name))

    def count_lines(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            (p.p_partkey % 10).alias("stock_take_id"),
            p.p_partkey.cast("string").alias("product_barcode"),
            (p.p_size - 5 + (p.p_partkey % 5 - 2)).cast("int").alias("physical_count"),
            (p.p_size - 5).alias("system_count"),
        ).withColumn("variance", F.col("physical_count") - F.col("system_count"))

    def transfers(self) -> DataFrame:
        """Flat transfer lines, one per line item."""
        l = self.raw("lineitem")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name")
        nt = n.withColumnRenamed("n_nationkey", "tk").withColumnRenamed("n_name", "to_location")
        to = o.join(c, F.col("o_custkey") == c.c_custkey, "left").join(nt, F.col("c_nationkey") == F.col("tk"), "left")     # lines move once, by order
        j = l.join(to, l.l_orderkey == F.col("o_orderkey"), "left")
        src = _case(F.col("l_suppkey") % 3, {0: STOCK_KEYS[0], 1: STOCK_KEYS[1], 2: STOCK_KEYS[2]})
        return j.select(
            F.col("l_orderkey").alias("transfer_id"), src.alias("from_location"), "to_location",
            F.when(F.col("l_linestatus") == "O", "In Transit").otherwise("Completed").alias("status"),
            F.col("l_partkey").cast("string").alias("barcode"),
            F.col("l_quantity").cast("int").alias("qty"),
            (F.col("l_quantity").cast("int") - F.col("l_partkey") % 3).cast("int").alias("received_qty"),
            F.col("l_shipdate").alias("created_at"))

    def purchase_order_lines(self, code: Column | None = None, by_code: bool = False) -> DataFrame:
        """``code``: the barcode as the order gives it, made of l_orderkey and l_partkey; it must be another for each product of an order.
        ``by_code``: rows of a code in one partition from the start, so that joins and windows by it need no second shuffle."""
        l = self.raw("lineitem")
        l = l.select("l_suppkey", "l_orderkey", (F.col("l_partkey") if code is None else code).alias("_code"), "l_quantity", "l_shipdate")
        return ((l.repartition("_code") if by_code else l).groupBy("l_suppkey", "l_orderkey", "_code")
                .agg(F.sum("l_quantity").cast("int").alias("quantity"),
                     F.min("l_shipdate").alias("order_date"))
                .select(F.col("l_orderkey").alias("po_id"), F.col("l_suppkey").alias("supplier_id"),
                        F.col("_code").cast("string").alias("barcode"), "quantity", "order_date"))

    def company_users(self) -> DataFrame:
        """Company portal users (their ids share the staff id space, T20)."""
        s = self.raw("supplier")
        return s.select(s.s_suppkey.alias("id"), s.s_name.alias("company_name"))

    def suppliers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(s.s_suppkey.alias("id"), s.s_name.alias("name"), s.s_nationkey.alias("branch_id"),
                        s.s_acctbal.cast(MONEY12).alias("balance"))

    def promotions(self) -> DataFrame:
        p = self.raw("part")
        return (p.groupBy("p_brand").agg(F.min("p_size").alias("_s"), F.count("*").alias("_n"))
                .select(F.concat(F.lit("PROMO-"), F.regexp_replace("p_brand", "Brand#", "")).alias("code"),
                        F.col("_s").cast("decimal(5,2)").alias("discount_percentage"),
                        F.when(F.col("_n") % 2 == 0, F.lit(None).cast("int"))
                         .otherwise((F.col("_n") % 5).cast("int")).alias("branch_id")))

    # -- events-derived -------------------------------------------------------
    def shifts(self) -> DataFrame:
        e = self.raw("events")
        g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
            F.min("ts").alias("start_time"), F.max("ts").alias("_last"))
        open_ = (F.col("user_id") % 5 == 0) & (F.col("day") == F.lit("2024-01-30").cast("date"))
        end = F.when(open_, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("_last"))
        return g.select(
            (F.col("user_id") * 100 + F.dayofmonth("day")).alias("id"), "user_id", "start_time",
            end.alias("end_time"),
            (100 + F.col("user_id") % 50).cast(MONEY).alias("start_cash"),
            F.when(open_, F.lit(None).cast(MONEY))
             .otherwise((100 + F.col("user_id") % 50 + (F.col("user_id") * 37) % 200).cast(MONEY)).alias("end_cash"),
            F.when(open_, "open").otherwise("closed").alias("status"))

    def event_sales(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "purchase")
        return e.select(
            F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
            F.col("value").cast(MONEY).alias("total_amount"),
            _case(F.col("event_id") % 4, {0: "cash", 1: "momo", 2: "card", 3: "Mobile Money"})
             .alias("payment_method"))

    def payments(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "purchase")
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"),
                        F.col("value").cast(MONEY).alias("amount"),
                        # the event month moved onto a month with sales
                        F.timestamp_add("DAY", F.lit(-8280), F.col("ts")).alias("payment_date"))

    def expenses(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "error")
        return e.select(F.lit("Ops").alias("category"), F.col("value").cast(MONEY).alias("amount"),
                        F.to_date("ts").alias("expense_date"), (F.col("user_id") % 25).cast("int").alias("branch_id"))

    def credit_decisions(self) -> DataFrame:
        """CEO decisions on pending accounts / limit requests; some customers get two (latest wins)."""
        c = self.raw("customer").filter((F.col("c_custkey") % 9 == 0) | (F.col("c_custkey") % 7 == 0))
        first = F.when(F.col("c_custkey") % 2 == 0, "approve").otherwise("reject")
        a = c.select(F.col("c_custkey").alias("customer_id"),
                     F.timestamp_add("MINUTE", F.col("c_custkey").cast("int"),
                                     F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("decided_at"),
                     first.alias("decision"))
        b = c.filter(F.col("c_custkey") % 4 == 0).select(
            F.col("c_custkey").alias("customer_id"), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("decided_at"),
            F.when(first == "approve", "reject").otherwise("approve").alias("decision"))
        return a.unionByName(b)

    def invoice_payments(self) -> DataFrame:
        """Payments against partially paid sales invoices: a tenth of each line's extended price."""
        l = self.raw("lineitem").select("l_orderkey", "l_extendedprice")
        o = self.raw("orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey")
        j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
        return j.select(F.col("l_orderkey").alias("invoice_id"),
                        F.round(F.col("l_extendedprice").cast(MONEY12) * F.lit("0.1").cast("decimal(2,1)"), 2)
                        .cast(MONEY12).alias("amount"))

    def shift_events(self) -> DataFrame:
        """Open / close events of the shifts (closes only for closed shifts)."""
        s = self.shifts()
        o = s.select("user_id", F.col("start_time").alias("ts"), F.lit("open").alias("kind"))
        c = s.filter(F.col("end_time").isNotNull()).select("user_id", F.col("end_time").alias("ts"),
                                                            F.lit("close").alias("kind"))
        return o.unionByName(c)

    def activity_logs(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"),
                        F.col("props").alias("details"), F.col("ts").alias("created_at"))

    def invoices(self) -> DataFrame:
        o = self.raw("orders")
        total = F.col("o_totalprice").cast(MONEY12)
        tax = F.round(total * F.lit("0.13").cast("decimal(3,2)"), 2).cast(MONEY12)
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") == "P", "proforma").otherwise("sales").alias("kind"),
            F.concat(F.when(F.col("o_orderstatus") == "P", F.lit("PRO-")).otherwise(F.lit("INV-")),
                     F.col("o_orderkey").cast("string")).alias("invoice_number"),
            (F.col("o_custkey") % 10).alias("company_id"),
            F.col("o_orderdate").alias("issue_date"),
            F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
            (total - tax).cast(MONEY12).alias("subtotal"),
            F.lit(0).cast(MONEY12).alias("discount_amount"), tax.alias("tax_amount"),
            F.when(F.col("o_orderstatus") == "F", total)
             .when(F.col("o_orderstatus") == "O", F.round(total * _half(), 2))
             .otherwise(F.lit(0)).cast(MONEY12).alias("paid_amount"),
            total.alias("total_amount"),
            F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "Partially Paid")
             .otherwise("Draft").alias("status"),
            (F.col("o_custkey") % 20).alias("created_by"))
