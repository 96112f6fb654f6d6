"""Registered scope, paging, distinct, decode and edit jobs (third batch) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.functions import scope as SC
from retailkit.operators.nest import nest
from retailkit.operators.topk import page_size, first_per_group, top_k
from retailkit.operators.chains import last_names
from retailkit.plans import changes as CH
from retailkit.plans import shifts as H
from retailkit.plans.sales import payment_bucket


@job("rpt36_transfer_history", """
SELECT transfer_id, from_location, to_location, status, barcode, qty, created_at FROM transfers
WHERE from_location = 'NATION_5' OR to_location = 'NATION_5'""")
def rpt36_transfer_history(spark, d):
    t = Retail(spark, d).transfers()
    return t.filter(SC.either_endpoint("from_location", "to_location", "NATION_5")).select(     # FLT-3
        "transfer_id", "from_location", "to_location", "status", "barcode", "qty", "created_at")


@job("flt05_branch_sentinel", """
SELECT 'All Branches' AS requested, COUNT(*) AS rows FROM sales
UNION ALL SELECT 'NATION_2', COUNT(*) FROM sales WHERE store_location = 'NATION_2'
UNION ALL SELECT 'Nowhere', 0""")
def flt05_branch_sentinel(spark, d):
    r = Retail(spark, d)
    h = r.sale_headers()
    out = None
    for b in ["All Branches", "NATION_2", "Nowhere"]:
        # resolution as a scalar subquery (no collect): is the requested branch a known name?
        known = r.branches().agg(F.coalesce(F.max(F.col("name") == b), F.lit(False))).scalar()
        c = (h.filter(SC.branch_sentinel("store_location", b, known))
             .agg(F.count(F.lit(1)).alias("rows")).select(F.lit(b).alias("requested"), "rows"))
        out = c if out is None else out.unionByName(c)
    return out


@job("flt07_fuzzy_branch", """
SELECT id, name, location FROM branches
WHERE name ILIKE '%nation_1%' OR name ILIKE '%NATION_2%' OR location ILIKE '%nation_1%' OR location ILIKE '%NATION_2%'
ORDER BY CASE WHEN name ILIKE '%nation_2%' THEN 1 WHEN name ILIKE '%nation_1%' THEN 2 ELSE 3 END, id LIMIT 1""")
def flt07_fuzzy_branch(spark, d):
    return SC.fuzzy_pick(Retail(spark, d).branches(), ["%nation_1%", "%NATION_2%"], ["%nation_2%", "%nation_1%"])


@job("flt19_promo_search", """
SELECT code, discount_percentage, branch_id FROM promotions WHERE contains(LOWER(code), 'promo-1')""")
def flt19_promo_search(spark, d):
    return Retail(spark, d).promotions().filter(SC.contains_ci("code", "PROMO-1"))


@job("top08_supplier_page", """
SELECT id, name, balance FROM suppliers ORDER BY name NULLS LAST, id LIMIT 50 OFFSET 20""")
def top08_supplier_page(spark, d):
    s = Retail(spark, d).suppliers().select("id", "name", "balance")
    return top_k(s, [F.col("name").asc_nulls_last(), F.col("id").asc()], page_size(None, 100), offset=20)


@job("agg21_distinct_pairs", """
SELECT DISTINCT store_location, payment_method FROM sales""")
def agg21_distinct_pairs(spark, d):
    return Retail(spark, d).sale_headers().select("store_location", "payment_method").distinct()


@job("agg32_targeted_sums", """
SELECT CAST(SUM(CASE WHEN customer_id = 10 THEN total_amount ELSE 0 END) AS DECIMAL(18,2)) AS total_for_customer_10,
       CAST(SUM(CASE WHEN customer_id IS NULL THEN total_amount ELSE 0 END) AS DECIMAL(18,2)) AS total_for_null_customer
FROM sales WHERE status = 'completed'""")
def agg32_targeted_sums(spark, d):
    h = Retail(spark, d).sale_headers().filter(F.col("status") == "completed")
    return h.agg(
        F.sum(F.when(F.col("customer_id") == 10, F.col("total_amount")).otherwise(0)).cast("decimal(18,2)")
        .alias("total_for_customer_10"),
        F.sum(F.when(F.col("customer_id").isNull(), F.col("total_amount")).otherwise(0)).cast("decimal(18,2)")
        .alias("total_for_null_customer"))


@job("jn20_first_product_per_barcode", """
SELECT barcode, arg_min(name, id) AS name, MIN(id) AS id FROM (
  SELECT id, barcode, name FROM products UNION ALL SELECT id - 1000000, barcode, name || ' old' FROM products WHERE id % 5 = 0)
GROUP BY barcode""")
def jn20_first_product_per_barcode(spark, d):
    p = Retail(spark, d).products().select("id", "barcode", "name")
    p = p.unionByName(p.filter("id % 5 = 0").selectExpr("id - 1000000 AS id", "barcode", "name || ' old' AS name"))
    return first_per_group(p, ["barcode"], F.col("id"), ["name", "id"])


@job("src03_decode_details", """
SELECT a.id, k AS key, json_extract_string(a.details, '$.' || k) AS value
FROM activity_logs a, UNNEST(json_keys(a.details)) t(k)""")
def src03_decode_details(spark, d):
    a = Retail(spark, d).activity_logs()
    m = F.from_json("details", "map<string,string>")            # bad JSON gives NULL, then no rows
    return a.select("id", F.explode(F.coalesce(m, F.create_map().cast("map<string,string>"))).alias("key", "value"))


@job("agg04_shift_payment_pivot", """
SELECT shift_id,
       CAST(SUM(CASE WHEN b = 'cash' THEN total_amount END) AS DECIMAL(18,2)) AS cash,
       CAST(SUM(CASE WHEN b = 'momo' THEN total_amount END) AS DECIMAL(18,2)) AS momo,
       CAST(SUM(CASE WHEN b = 'card' THEN total_amount END) AS DECIMAL(18,2)) AS card
FROM (SELECT shift_id, total_amount,
             CASE WHEN LOWER(payment_method) = 'cash' THEN 'cash'
                  WHEN LOWER(payment_method) = 'momo' OR contains(LOWER(payment_method), 'mobile') THEN 'momo'
                  WHEN LOWER(payment_method) = 'card' THEN 'card' END AS b FROM shift_pairs)
GROUP BY shift_id""")
def agg04_shift_payment_pivot(spark, d):
    r = Retail(spark, d)
    pairs = H.shift_sales(r.shifts(), r.event_sales()).withColumn("b", payment_bucket())
    # explicit pivot values: no extra pass to discover them; unknown methods fall out (NULL bucket)
    p = pairs.groupBy("shift_id").pivot("b", ["cash", "momo", "card"]).agg(F.sum("total_amount"))
    return p.select("shift_id", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("cash", "momo", "card")])


@job("rpt42_transfer_documents", """
SELECT transfer_id, COUNT(*) AS n_lines, CAST(SUM(qty) AS BIGINT) AS total_qty, MIN(barcode) AS first_barcode
FROM transfers GROUP BY transfer_id""")
def rpt42_transfer_documents(spark, d):
    t = Retail(spark, d).transfers()
    heads = t.select("transfer_id").distinct()
    doc = nest(heads, t.select("transfer_id", "barcode", "qty"), "transfer_id", "lines", order=["barcode", "qty"])
    return doc.select("transfer_id", F.size("lines").alias("n_lines"),
                      F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["qty"]).alias("total_qty"),
                      F.try_element_at("lines", F.lit(1))["barcode"].alias("first_barcode"))


EDITS_SQL = """edits AS (
  SELECT p_partkey AS id, p_size AS new_stock, upper(p_name) AS new_name,
         CASE WHEN p_partkey % 20 = 0 THEN 'P-' || CAST(p_partkey AS VARCHAR) END AS new_barcode,
         CASE WHEN p_partkey % 30 = 0 THEN NULL ELSE TRUE END AS new_track_batch
  FROM part WHERE p_partkey % 10 = 0)"""


def _edits(r: Retail):
    p = r.raw("part").filter(F.col("p_partkey") % 10 == 0)
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("new_stock"),
                    F.upper("p_name").alias("new_name"),
                    F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("P-"), F.col("p_partkey").cast("string")))
                     .alias("new_barcode"),
                    F.when(F.col("p_partkey") % 30 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))
                     .alias("new_track_batch"))


@job("chg30_product_edits", f"""
WITH {EDITS_SQL}
SELECT p.id, COALESCE(e.new_barcode, p.barcode) AS barcode, p.barcode AS old_barcode, e.new_name AS name,
       'Main Warehouse' AS stock_key,
       CAST(COALESCE((SELECT SUM(sl.qty) FROM stock_levels sl WHERE sl.barcode = p.barcode
                      AND sl.branch <> 'Main Warehouse'), 0) + e.new_stock AS BIGINT) AS stock,
       COALESCE(e.new_track_batch, p.track_batch) AS track_batch
FROM products p JOIN edits e ON e.id = p.id""")
def chg30_product_edits(spark, d):
    r = Retail(spark, d)
    return CH.product_edits(r.products(), _edits(r))


@job("chg30_batch_rename", f"""
WITH {EDITS_SQL},
ren AS (SELECT CAST(id AS VARCHAR) AS old_barcode, new_barcode FROM edits WHERE new_barcode IS NOT NULL)
SELECT COALESCE(ren.new_barcode, b.product_barcode) AS product_barcode, COUNT(*) AS batches,
       CAST(SUM(b.quantity) AS BIGINT) AS quantity
FROM batches b LEFT JOIN ren ON ren.old_barcode = b.product_barcode GROUP BY 1""")
def chg30_batch_rename(spark, d):
    r = Retail(spark, d)
    edited = CH.product_edits(r.products(), _edits(r))
    b = CH.rename_batches(r.batches(), edited)
    return b.groupBy("product_barcode").agg(F.count(F.lit(1)).alias("batches"),
                                            F.sum("quantity").cast("long").alias("quantity"))


# renames made from the orders: every order renames its customer's number, taken as a code, to another one
RENAMES_SQL = """renames AS (SELECT CAST(o_custkey AS VARCHAR) AS old, CAST((o_custkey * 7 + o_orderkey) % 2000 + 1 AS VARCHAR) AS new, o_orderkey AS seq
  FROM orders WHERE o_orderkey % 5 = 0)"""


@job("chg30_rename_chains", f"""
WITH RECURSIVE {RENAMES_SQL},
e AS (SELECT * FROM renames WHERE old <> new),
nxt AS (SELECT a.seq, MIN(b.seq) AS then FROM e a LEFT JOIN e b ON b.old = a.new AND b.seq > a.seq GROUP BY a.seq),
f AS (SELECT a.old AS start, a.new AS code, a.seq, 1 AS hops FROM e a WHERE a.seq = (SELECT MIN(seq) FROM e WHERE old = a.old)
      UNION ALL
      SELECT f.start, e.new, e.seq, f.hops + 1 FROM f JOIN nxt ON nxt.seq = f.seq JOIN e ON e.seq = nxt.then),
l AS (SELECT start, arg_max(code, hops) AS last, MAX(hops) AS hops FROM f GROUP BY start)
SELECT COALESCE(l.last, b.product_barcode) AS product_barcode, COUNT(*) AS batches, CAST(SUM(b.quantity) AS BIGINT) AS quantity,
       CAST(MAX(COALESCE(l.hops, 0)) AS BIGINT) AS longest_chain
FROM batches b LEFT JOIN l ON l.start = b.product_barcode GROUP BY 1""")
def chg30_rename_chains(spark, d):
    r = Retail(spark, d)
    o = r.raw("orders").filter(F.col("o_orderkey") % 5 == 0)
    renames = o.select(F.col("o_custkey").cast("string").alias("old"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 2000 + 1).cast("string").alias("new"),
                       F.col("o_orderkey").alias("seq"))
    names = last_names(renames).select(F.col("old").alias("product_barcode"), "last", "hops")
    b = r.batches().join(names, "product_barcode", "left")
    return b.groupBy(F.coalesce("last", "product_barcode").alias("product_barcode")).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("quantity").cast("long").alias("quantity"), F.max(F.coalesce("hops", F.lit(0))).cast("long").alias("longest_chain"))


STAFF_SQL = """staff AS (
  SELECT s.s_suppkey AS id, s.s_name || '@Shop.Example' AS email,
         CASE s.s_suppkey % 3 WHEN 0 THEN 'Cashier' WHEN 1 THEN 'MANAGER' ELSE 'admin' END AS role,
         CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE 'active' END AS status,
         CASE WHEN s.s_suppkey % 2 = 0 THEN upper(n.n_name) ELSE lower(r.r_name) END AS store_location,
         CASE WHEN s.s_suppkey % 5 = 0 THEN s.s_nationkey END AS store_id
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def _staff(r: Retail):
    s = r.raw("supplier")
    n = r.raw("nation")
    g = r.raw("region")
    j = (s.join(n, s.s_nationkey == n.n_nationkey, "left")
         .join(g, F.col("n_regionkey") == g.r_regionkey, "left"))
    k = F.col("s_suppkey")
    return j.select(k.alias("id"), F.concat(F.col("s_name"), F.lit("@Shop.Example")).alias("email"),
                    F.when(k % 3 == 0, "Cashier").when(k % 3 == 1, "MANAGER").otherwise("admin").alias("role"),
                    F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("active")).alias("status"),
                    F.when(k % 2 == 0, F.upper("n_name")).otherwise(F.lower("r_name")).alias("store_location"),
                    F.when(k % 5 == 0, F.col("s_nationkey")).alias("store_id"))


@job("chg21_normalise_users", f"""
WITH {STAFF_SQL},
m AS (SELECT u.id, MIN(CAST(b.id AS INTEGER)) AS bid FROM staff u JOIN branches b
      ON LOWER(u.store_location) = LOWER(b.name) OR LOWER(u.store_location) = LOWER(b.location) GROUP BY u.id)
SELECT u.id, LOWER(u.email) AS email, LOWER(u.role) AS role, COALESCE(u.status, 'Active') AS status,
       u.store_location, COALESCE(u.store_id, m.bid) AS store_id
FROM staff u LEFT JOIN m ON m.id = u.id""")
def chg21_normalise_users(spark, d):
    r = Retail(spark, d)
    return CH.normalise_users(_staff(r), r.branches())


@job("jn04_adjustment_history", """
SELECT c.stock_take_id, c.product_barcode AS barcode, p.name, c.variance AS quantity, u.name AS user_name
FROM count_lines c JOIN products p ON p.barcode = c.product_barcode
LEFT JOIN users u ON u.id = c.stock_take_id % 20 WHERE c.variance <> 0""")
def jn04_adjustment_history(spark, d):
    r = Retail(spark, d)
    return CH.adjustment_history(r.count_lines(), r.products(), r.users())
