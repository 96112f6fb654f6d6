"""Registered postings (CHG-8, CHG-10, CHG-11, CHG-13/14, CHG-15) and the incremental monthly table (SRC-4), with their SQL oracle twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.operators.changeset import add_to_batches, add_to_stock, post, rows_of
from retailkit.operators.running import HEAVY, heavy_keys
from retailkit.plans import postings as PO
from retailkit.plans import sales as S
from retailkit.session import ensure_checkpoint_dir, settings
from retailkit.sources import sinks

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"         # false: rows dealt by some of a join's keys aren't dealt again for the join
TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"       # of shuffled bytes; a task sorts its lines twice, larger ones would spill


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- CHG-8: received orders -------------------------------------------------------
# receipts made from purchase order lines: some have a number, a date or a quantity given by hand, some an unknown product
LINES_SQL = """lines AS (
  SELECT po_id, supplier_id, CASE WHEN po_id % 97 = 0 THEN 'X' ELSE '' END || barcode AS barcode, quantity, order_date AS received_at,
         CAST(supplier_id AS INTEGER) AS branch_id, CASE po_id % 3 WHEN 0 THEN 'Main Warehouse' WHEN 1 THEN 'B1' ELSE 'B2' END AS branch_name,
         CASE WHEN po_id % 4 = 0 THEN 'LOT-' || CAST(po_id % 8 AS VARCHAR) WHEN po_id % 5 = 1 THEN CAST(po_id AS VARCHAR) END AS given_number,
         CASE WHEN po_id % 4 = 0 THEN CAST(order_date AS DATE) + 200 WHEN po_id % 10 = 1 THEN CAST(order_date AS DATE)
              WHEN po_id % 10 = 6 THEN CAST(order_date AS DATE) + 5 END AS given_expiry,
         CASE WHEN po_id % 6 = 0 THEN quantity - 1 END AS given_quantity
  FROM purchase_order_lines)"""

RECEIVED_SQL = f"""{LINES_SQL},
named AS (
  SELECT l.*, COALESCE(NULLIF(l.given_quantity, 0), l.quantity) AS units, p.stock, p.barcode IS NOT NULL AS known, s.name AS supplier, p.name AS product,
         COALESCE(l.given_expiry, CASE WHEN strftime(l.received_at, '%m%d') = '0229' THEN CAST(l.received_at AS DATE) + 366
                                       ELSE CAST(CAST(l.received_at AS DATE) + INTERVAL 1 YEAR AS DATE) END) AS expiry_date
  FROM lines l LEFT JOIN suppliers s ON s.id = l.supplier_id LEFT JOIN products p ON p.barcode = l.barcode),
numbered AS (
  SELECT *, COALESCE(given_number, concat_ws('-', regexp_replace(upper(substring(COALESCE(supplier, 'SUP'), 1, 3)), '\\s', '', 'g'), strftime(received_at, '%y%m%d'),
                     regexp_replace(upper(substring(COALESCE(product, 'ITEM'), 1, 3)), '\\s', '', 'g'), strftime(expiry_date, '%y%m%d'))) AS number FROM named),
owned AS (
  SELECT n.*, CASE WHEN b.batch_number IS NOT NULL THEN COALESCE(b.expiry_date, DATE '1970-01-01')
                   ELSE FIRST_VALUE(n.expiry_date) OVER (PARTITION BY n.barcode, n.number, n.branch_id ORDER BY n.received_at, n.po_id, n.supplier_id) END AS owner
  FROM numbered n LEFT JOIN batches b ON b.product_barcode = n.barcode AND b.batch_number = n.number AND b.branch_id = n.branch_id),
received AS (
  SELECT *, CASE WHEN owner = expiry_date THEN number ELSE number || '-' || strftime(expiry_date, '%y%m%d') END AS batch_number,
         COALESCE(stock, 0) + SUM(units) OVER (PARTITION BY barcode ORDER BY received_at, po_id, supplier_id ROWS UNBOUNDED PRECEDING) AS after FROM owned)"""


def _received(spark, d, kind: str):
    r = Retail(spark, d)
    po = F.col("po_id")
    day = F.to_date("order_date")
    code = F.concat(F.when(F.col("l_orderkey") % 97 == 0, "X").otherwise(""), F.col("l_partkey").cast("string"))
    heavy = heavy_keys(r.line_products(), ["barcode"])
    dealt = heavy is None           # products of few lines each: lines and batches are dealt by product once, for all that follows
    lines = r.purchase_order_lines(code, by_code=dealt).select(
        "po_id", "supplier_id", "barcode", "quantity", F.col("order_date").alias("received_at"),
        F.col("supplier_id").cast("int").alias("branch_id"), F.when(po % 3 == 0, "Main Warehouse").when(po % 3 == 1, "B1").otherwise("B2").alias("branch_name"),
        F.when(po % 4 == 0, F.concat(F.lit("LOT-"), (po % 8).cast("string"))).when(po % 5 == 1, po.cast("string")).alias("given_number"),
        F.when(po % 4 == 0, F.date_add(day, 200)).when(po % 10 == 1, day).when(po % 10 == 6, F.date_add(day, 5)).alias("given_expiry"),
        F.when(po % 6 == 0, F.col("quantity") - 1).alias("given_quantity"))
    changes = PO.receive_orders(lines, r.suppliers(), r.products(), r.batches(by_product=dealt), heavy)
    folder = _folder(spark, "receipts")
    with settings(spark, {ALL_KEYS: not dealt, TASK_SIZE: "16m"}):
        post(changes, folder)
    return r, rows_of(spark, changes, folder, kind)


@job("chg08_receipt_products", f"""
WITH {RECEIVED_SQL},
g AS (SELECT barcode, SUM(units) AS units FROM received WHERE known GROUP BY barcode),
m AS (SELECT barcode, branch, SUM(qty) AS qty FROM (
        SELECT barcode, branch, qty FROM stock_levels UNION ALL SELECT barcode, branch_name, units FROM received WHERE known) GROUP BY 1, 2)
SELECT p.barcode, CAST(CASE WHEN g.units IS NULL THEN p.stock ELSE COALESCE(p.stock, 0) + g.units END AS BIGINT) AS stock,
       m.branch, CAST(m.qty AS BIGINT) AS branch_stock
FROM products p LEFT JOIN g USING (barcode) LEFT JOIN m USING (barcode)""")
def chg08_receipt_products(spark, d):
    r, deltas = _received(spark, d, "product")
    new = add_to_stock(r.products().select("barcode", "stock", "stock_levels"), deltas)
    return new.select("barcode", "stock", F.explode_outer("stock_levels").alias("branch", "branch_stock"))


@job("chg08_receipt_batches", f"""
WITH {RECEIVED_SQL},
g AS (SELECT barcode AS product_barcode, batch_number, branch_id, MIN(expiry_date) AS expiry_date, SUM(units) AS units FROM received GROUP BY 1, 2, 3)
SELECT COALESCE(b.product_barcode, g.product_barcode) AS product_barcode, COALESCE(b.batch_number, g.batch_number) AS batch_number,
       COALESCE(b.branch_id, g.branch_id) AS branch_id, CASE WHEN b.batch_number IS NULL THEN g.expiry_date ELSE b.expiry_date END AS expiry_date,
       CAST(COALESCE(b.quantity, 0) + COALESCE(g.units, 0) AS INTEGER) AS quantity,
       CAST(COALESCE(b.quantity_available, 0) + COALESCE(g.units, 0) AS INTEGER) AS quantity_available,
       CAST(COALESCE(b.quantity_received, 0) + COALESCE(g.units, 0) AS INTEGER) AS quantity_received
FROM batches b FULL OUTER JOIN g ON g.product_barcode = b.product_barcode AND g.batch_number = b.batch_number AND g.branch_id = b.branch_id""")
def chg08_receipt_batches(spark, d):
    r, deltas = _received(spark, d, "batch")
    return add_to_batches(r.batches(by_key=True), deltas)


@job("chg08_receipt_audit", f"""
WITH {RECEIVED_SQL}
SELECT 'Stock In' AS action_type, barcode AS product_barcode, CAST(after - units AS BIGINT) AS quantity_before, CAST(after AS BIGINT) AS quantity_after,
       po_id AS reference_id, 'Purchase Order' AS reference_type, branch_id FROM received WHERE known""")
def chg08_receipt_audit(spark, d):
    return _received(spark, d, "audit")[1]


@job("chg08_receipt_status", f"WITH {LINES_SQL} SELECT DISTINCT po_id, 'Received' AS status FROM lines")
def chg08_receipt_status(spark, d):
    return _received(spark, d, "status")[1].distinct()


@job("chg08_receipt_rejects", f"""
WITH {LINES_SQL}
SELECT po_id, barcode, 'unknown product' AS reason FROM lines WHERE barcode NOT IN (SELECT barcode FROM products)""")
def chg08_receipt_rejects(spark, d):
    return _received(spark, d, "reject")[1]


# -- CHG-15: adjustments ----------------------------------------------------------
# adjustments made from line items: the type by the return flag, the reason by the status of the line
ADJUSTED_SQL = """adjustments AS (
  SELECT l_orderkey * 10 + l_linenumber AS adjustment_id, CASE WHEN l_orderkey % 89 = 0 THEN 'X' ELSE '' END || CAST(l_partkey AS VARCHAR) AS barcode,
         CASE WHEN l_returnflag = 'R' THEN 'Damaged' ELSE 'Found' END AS adjustment_type,
         CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS INTEGER) AS BIGINT) AS quantity,
         l_linestatus AS reason, CAST(l_orderkey % 4 AS INTEGER) AS branch_id, l_shipdate AS adjusted_at
  FROM lineitem WHERE l_orderkey % 7 = 0)"""


def _adjusted(spark, d, kind: str):
    r = Retail(spark, d)
    li = r.raw("lineitem").filter("l_orderkey % 7 = 0")
    a = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("adjustment_id"),
        F.concat(F.when(F.col("l_orderkey") % 89 == 0, "X").otherwise(""), F.col("l_partkey").cast("string")).alias("barcode"),
        F.when(F.col("l_returnflag") == "R", "Damaged").otherwise("Found").alias("adjustment_type"),
        (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("int")).cast("long").alias("quantity"),
        F.col("l_linestatus").alias("reason"), (F.col("l_orderkey") % 4).cast("int").alias("branch_id"), F.col("l_shipdate").alias("adjusted_at"))
    changes = PO.adjust_stock(a, r.products())
    folder = _folder(spark, "adjustments")
    post(changes, folder)
    return r, rows_of(spark, changes, folder, kind)


@job("chg15_adjustment_rows", f"WITH {ADJUSTED_SQL} SELECT adjustment_id, barcode, adjustment_type, quantity, reason, branch_id FROM adjustments")
def chg15_adjustment_rows(spark, d):
    return _adjusted(spark, d, "adjustment")[1]


@job("chg15_adjusted_products", f"""
WITH {ADJUSTED_SQL},
a AS (SELECT a.barcode, CASE branch_id WHEN 2 THEN 'Accra Branch' WHEN 3 THEN 'Kumasi Branch' ELSE 'Main Warehouse' END AS branch, quantity
      FROM adjustments a JOIN products p ON p.barcode = a.barcode),
g AS (SELECT barcode, SUM(quantity) AS units FROM a GROUP BY barcode),
m AS (SELECT barcode, branch, SUM(qty) AS qty FROM (SELECT barcode, branch, qty FROM stock_levels UNION ALL SELECT * FROM a) GROUP BY 1, 2)
SELECT p.barcode, CAST(CASE WHEN g.units IS NULL THEN p.stock ELSE COALESCE(p.stock, 0) + g.units END AS BIGINT) AS stock,
       m.branch, CAST(m.qty AS BIGINT) AS branch_stock
FROM products p LEFT JOIN g USING (barcode) LEFT JOIN m USING (barcode)""")
def chg15_adjusted_products(spark, d):
    r, deltas = _adjusted(spark, d, "product")
    new = add_to_stock(r.products().select("barcode", "stock", "stock_levels"), deltas)
    return new.select("barcode", "stock", F.explode_outer("stock_levels").alias("branch", "branch_stock"))


@job("chg15_adjustment_audit", f"""
WITH {ADJUSTED_SQL},
j AS (SELECT a.*, COALESCE(p.stock, 0) + SUM(a.quantity) OVER (PARTITION BY a.barcode ORDER BY adjusted_at, adjustment_id ROWS UNBOUNDED PRECEDING) AS after
      FROM adjustments a JOIN products p ON p.barcode = a.barcode)
SELECT 'Stock Adjustment' AS action_type, barcode AS product_barcode, CAST(after - quantity AS BIGINT) AS quantity_before, CAST(after AS BIGINT) AS quantity_after,
       adjustment_id AS reference_id, 'Adjustment' AS reference_type, reason AS notes FROM j""")
def chg15_adjustment_audit(spark, d):
    return _adjusted(spark, d, "audit")[1]


# -- CHG-13/14: counts as of their time ---------------------------------------------
@job("chg14_counts_as_of", """
WITH mv AS (SELECT barcode, created_at AS moved_at, CASE WHEN is_return THEN qty ELSE -qty END AS delta FROM sale_items WHERE LOWER(status) = 'completed'
            UNION ALL SELECT barcode, order_date, quantity FROM purchase_order_lines),
c AS (SELECT stock_take_id, product_barcode AS barcode, physical_count,
             TIMESTAMP '1993-01-01 12:00:00' + CAST(CAST(product_barcode AS BIGINT) * 37 % 2500 AS INTEGER) * INTERVAL 1 DAY AS counted_at FROM count_lines),
s AS (SELECT c.stock_take_id, c.barcode, c.counted_at, c.physical_count, COALESCE(SUM(mv.delta), 0) AS moved
      FROM c LEFT JOIN mv ON mv.barcode = c.barcode AND mv.moved_at <= c.counted_at GROUP BY 1, 2, 3, 4)
SELECT s.stock_take_id, s.barcode, s.counted_at, CAST(COALESCE(p.stock, 0) + s.moved AS BIGINT) AS system_count,
       CAST(s.physical_count AS BIGINT) AS physical_count, CAST(s.physical_count - COALESCE(p.stock, 0) - s.moved AS BIGINT) AS variance
FROM s JOIN products p ON p.barcode = s.barcode""")
def chg14_counts_as_of(spark, d):
    r = Retail(spark, d)
    sold = r.sale_items().filter(F.lower("status") == "completed").select(
        "barcode", F.col("created_at").alias("moved_at"), F.concat_ws("-", F.lit("s"), "id", "pos").alias("ref"),
        F.when(F.col("is_return"), F.col("qty")).otherwise(-F.col("qty")).cast("long").alias("delta"))
    bought = r.purchase_order_lines().select(
        "barcode", F.col("order_date").alias("moved_at"), F.concat_ws("-", F.lit("p"), "po_id", "supplier_id").alias("ref"), F.col("quantity").cast("long").alias("delta"))
    day = (F.col("product_barcode").cast("long") * 37 % 2500).cast("int")
    counts = r.count_lines().select("stock_take_id", F.col("product_barcode").alias("barcode"), "physical_count",
                                    (F.lit("1993-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(day)).alias("counted_at"))
    return PO.counts_as_of(counts, sold.unionByName(bought), r.products(), heavy_keys(r.line_products(), ["barcode"], HEAVY // 2))


# -- CHG-10: transfers that leave their source ----------------------------------------
# requests made from the transfer lines, of smaller quantities; the stock keys get branches, so that two of them are one source
DISPATCH_SQL = """RECURSIVE b2 AS (SELECT id, name, location FROM branches UNION ALL SELECT 1000, 'Kumasi Hub', 'B2' UNION ALL SELECT 1001, 'Main Warehouse', 'B1'),
keys AS (SELECT stock_key, arg_min(name, id) AS source FROM (SELECT id, name, name AS stock_key FROM b2 UNION ALL SELECT id, name, location FROM b2) GROUP BY 1),
stock AS (SELECT sl.barcode, COALESCE(k.source, sl.branch) AS source, SUM(sl.qty) AS units FROM stock_levels sl LEFT JOIN keys k ON k.stock_key = sl.branch GROUP BY 1, 2),
req AS (SELECT t.transfer_id, t.from_location, COALESCE(e.source, t.to_location) AS to_location, COALESCE(k.source, t.from_location) AS source,
               CASE WHEN t.transfer_id % 97 = 0 THEN 'X' ELSE '' END || t.barcode AS barcode, t.qty // 12 + 1 AS qty, t.created_at
        FROM transfers t LEFT JOIN keys k ON k.stock_key = t.from_location LEFT JOIN keys e ON e.stock_key = t.to_location),
one AS (SELECT r.source, r.transfer_id, r.from_location, r.barcode, MIN(r.to_location) AS to_location, MIN(r.created_at) AS t, CAST(SUM(r.qty) AS BIGINT) AS q,
               CASE WHEN MAX(p.barcode) IS NOT NULL THEN CAST(COALESCE(MAX(s.units), 0) AS BIGINT) END AS av
        FROM req r LEFT JOIN products p ON p.barcode = r.barcode LEFT JOIN stock s ON s.barcode = r.barcode AND s.source = r.source GROUP BY 1, 2, 3, 4),
bk AS (SELECT source, transfer_id, from_location, list({'item': barcode, 'q': q, 'av': av}) AS need,
              ROW_NUMBER() OVER (PARTITION BY source ORDER BY MIN(t), transfer_id, from_location) AS rn FROM one GROUP BY 1, 2, 3),
f(source, rn, transfer_id, from_location, accepted, short, used) AS (
  SELECT source, 0, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, NULL::STRUCT(item VARCHAR, q BIGINT, av BIGINT)[], MAP {}::MAP(VARCHAR, BIGINT) FROM (SELECT DISTINCT source FROM bk)
  UNION ALL
  SELECT bk.source, bk.rn, bk.transfer_id, bk.from_location, list_bool_and(list_transform(bk.need, lambda x: COALESCE(COALESCE(f.used[x.item], 0) + x.q <= x.av, FALSE))),
         list_transform(list_filter(bk.need, lambda x: NOT COALESCE(COALESCE(f.used[x.item], 0) + x.q <= x.av, FALSE)),
                        lambda x: {'item': x.item, 'q': x.q, 'av': x.av - COALESCE(f.used[x.item], 0)}),
         CASE WHEN list_bool_and(list_transform(bk.need, lambda x: COALESCE(COALESCE(f.used[x.item], 0) + x.q <= x.av, FALSE)))
              THEN map_concat(f.used, map_from_entries(list_transform(bk.need, lambda x: {'k': x.item, 'v': COALESCE(f.used[x.item], 0) + x.q}))) ELSE f.used END
  FROM f JOIN bk ON bk.source = f.source AND bk.rn = f.rn + 1),
decided AS (SELECT o.*, f.accepted FROM one o JOIN f ON f.source = o.source AND f.transfer_id = o.transfer_id AND f.from_location = o.from_location WHERE f.rn > 0)"""


def _dispatched(spark, d, kind: str):
    r = Retail(spark, d)
    t = r.transfers()
    t = t.withColumns({"barcode": F.concat(F.when(F.col("transfer_id") % 97 == 0, "X").otherwise(""), F.col("barcode")), "qty": F.floor(F.col("qty") / 12) + 1})
    more = spark.createDataFrame([(1000, "Kumasi Hub", "B2"), (1001, "Main Warehouse", "B1")], "id long, name string, location string")
    branches = r.branches().unionByName(more)
    changes = PO.dispatch_transfers(t, r.products(), branches)
    folder = _folder(spark, "dispatch")
    post(changes, folder)
    return r, branches, rows_of(spark, changes, folder, kind)


@job("chg10_dispatch_transfers", f"""
WITH {DISPATCH_SQL}
SELECT transfer_id, from_location AS requested_from, source AS from_location, to_location, 'In Transit' AS status, barcode, q AS qty FROM decided WHERE accepted""")
def chg10_dispatch_transfers(spark, d):
    return _dispatched(spark, d, "transfer")[2]


@job("chg10_dispatch_rejects", f"""
WITH {DISPATCH_SQL}
SELECT transfer_id, from_location AS requested_from, s.item AS barcode, s.av AS available, s.q AS requested,
       CASE WHEN s.av IS NULL THEN 'not found' ELSE 'Insufficient stock' END AS reason
FROM (SELECT transfer_id, from_location, UNNEST(short) AS s FROM f WHERE rn > 0 AND NOT accepted)""")
def chg10_dispatch_rejects(spark, d):
    return _dispatched(spark, d, "reject")[2]


@job("chg10_dispatch_products", f"""
WITH {DISPATCH_SQL},
gone AS (SELECT barcode, source, SUM(q) AS units FROM decided WHERE accepted GROUP BY 1, 2),
m AS (SELECT barcode, branch, SUM(qty) AS qty FROM (
        SELECT sl.barcode, CASE WHEN g.units IS NOT NULL THEN g.source ELSE sl.branch END AS branch, sl.qty
        FROM stock_levels sl LEFT JOIN keys k ON k.stock_key = sl.branch LEFT JOIN gone g ON g.barcode = sl.barcode AND g.source = COALESCE(k.source, sl.branch)
        UNION ALL SELECT barcode, source, -units FROM gone) GROUP BY 1, 2)
SELECT p.barcode, CAST(p.stock - COALESCE((SELECT SUM(units) FROM gone WHERE gone.barcode = p.barcode), 0) AS BIGINT) AS stock, m.branch, CAST(m.qty AS BIGINT) AS branch_stock
FROM products p LEFT JOIN m USING (barcode)""")
def chg10_dispatch_products(spark, d):
    r, branches, moved = _dispatched(spark, d, "product")
    new = PO.take_from_stock(r.products().select("barcode", "stock", "stock_levels"), branches, moved)
    return new.select("barcode", "stock", F.explode_outer("stock_levels").alias("branch", "branch_stock"))


# -- CHG-11: transfers that arrive -------------------------------------------------------
# two requests for most transfers: by a user of some branch, in lower case and with spaces, and later by an admin or again a branch; some lines have an unknown product
ARRIVAL_SQL = """tl AS (SELECT transfer_id, to_location, status, CASE WHEN transfer_id % 31 = 0 THEN 'X' ELSE '' END || barcode AS barcode, qty FROM transfers),
heads AS (SELECT tl.transfer_id, MIN(status) AS status, MIN(to_location) AS to_location, bool_and(p.barcode IS NOT NULL) AS all_known
          FROM tl LEFT JOIN products p ON p.barcode = tl.barcode GROUP BY 1),
requests AS (
  SELECT o_orderkey * 2 AS request_id, o_orderkey AS transfer_id, 'cashier' AS role, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE ' ' || lower(n_name) || ' ' END AS store_location, o_orderdate AS requested_at
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = (c_nationkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 25
  UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 900000000 ELSE 0 END, CASE WHEN o_orderkey % 3 = 0 THEN 'Admin' ELSE 'cashier' END, NULL, o_orderdate
  FROM orders WHERE o_orderkey % 4 <> 1),
named AS (SELECT q.*, (SELECT arg_min(b.name, b.id) FROM branches b WHERE b.name = q.store_location OR b.location = q.store_location) AS branch FROM requests q),
checked AS (
  SELECT q.*, CASE WHEN h.transfer_id IS NULL THEN 'Transfer not found' WHEN h.status IS DISTINCT FROM 'In Transit' THEN 'Transfer already processed'
                   WHEN lower(role) NOT IN ('admin', 'ceo') AND lower(trim(COALESCE(branch, store_location, ''))) <> lower(trim(COALESCE(h.to_location, ''))) THEN 'Unauthorized'
                   WHEN NOT h.all_known THEN 'unknown product' WHEN h.to_location IS NULL THEN 'no destination' END AS wrong
  FROM named q LEFT JOIN heads h ON h.transfer_id = q.transfer_id),
answered AS (SELECT *, CASE WHEN MIN(CASE WHEN wrong IS NULL THEN request_id END) OVER (PARTITION BY transfer_id) < request_id THEN 'Transfer already processed' ELSE wrong END AS reason FROM checked)"""


def _arrived(spark, d, kind: str):
    r = Retail(spark, d)
    t = r.transfers().withColumn("barcode", F.concat(F.when(F.col("transfer_id") % 31 == 0, "X").otherwise(""), F.col("barcode")))
    o, k = r.raw("orders"), F.col("o_orderkey")
    c, n = r.raw("customer").select("c_custkey", "c_nationkey"), r.raw("nation").select("n_nationkey", "n_name")
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("_n", (F.col("c_nationkey") + F.when(k % 5 == 0, 1).otherwise(0)) % 25).join(n, F.col("_n") == F.col("n_nationkey"))
    first = own.select((k * 2).alias("request_id"), k.alias("transfer_id"), F.lit("cashier").alias("role"),
                       F.when(k % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("store_location"), F.col("o_orderdate").alias("requested_at"))
    later = o.filter(k % 4 != 1).select((k * 2 + 1).alias("request_id"), (k + F.when(k % 50 == 0, 900000000).otherwise(0)).alias("transfer_id"),
                                        F.when(k % 3 == 0, "Admin").otherwise("cashier").alias("role"), F.lit(None).cast("string").alias("store_location"), F.col("o_orderdate").alias("requested_at"))
    changes = PO.receive_transfers(first.unionByName(later), t, r.products(), r.branches())
    folder = _folder(spark, "arrivals")
    post(changes, folder)
    return r, rows_of(spark, changes, folder, kind)


@job("chg11_received_products", f"""
WITH {ARRIVAL_SQL},
a AS (SELECT tl.barcode, tl.to_location AS branch, tl.qty FROM tl JOIN answered q ON q.transfer_id = tl.transfer_id AND q.reason IS NULL),
g AS (SELECT barcode, SUM(qty) AS units FROM a GROUP BY barcode),
m AS (SELECT barcode, branch, SUM(qty) AS qty FROM (SELECT barcode, branch, qty FROM stock_levels UNION ALL SELECT * FROM a) GROUP BY 1, 2)
SELECT p.barcode, CAST(p.stock + COALESCE(g.units, 0) AS BIGINT) AS stock, m.branch, CAST(m.qty AS BIGINT) AS branch_stock
FROM products p LEFT JOIN g USING (barcode) LEFT JOIN m USING (barcode)""")
def chg11_received_products(spark, d):
    r, deltas = _arrived(spark, d, "product")
    new = add_to_stock(r.products().select("barcode", "stock", "stock_levels"), deltas, missing=None)
    return new.select("barcode", "stock", F.explode_outer("stock_levels").alias("branch", "branch_stock"))


@job("chg11_received_status", f"WITH {ARRIVAL_SQL} SELECT transfer_id, 'Received' AS status, request_id FROM answered WHERE reason IS NULL")
def chg11_received_status(spark, d):
    return _arrived(spark, d, "status")[1]


@job("chg11_receive_rejects", f"WITH {ARRIVAL_SQL} SELECT request_id, transfer_id, reason FROM answered WHERE reason IS NOT NULL")
def chg11_receive_rejects(spark, d):
    return _arrived(spark, d, "reject")[1]


# -- CHG-14: stock takes that are approved ------------------------------------------------
APPROVED_SQL = """approvals AS (SELECT DISTINCT stock_take_id, CAST(stock_take_id % 4 AS INTEGER) AS branch_id, 100 + stock_take_id AS approved_by FROM count_lines WHERE stock_take_id % 5 <> 4),
l AS (SELECT c.*, a.approved_by, CASE a.branch_id WHEN 2 THEN 'Accra Branch' WHEN 3 THEN 'Kumasi Branch' ELSE 'Main Warehouse' END AS branch
      FROM count_lines c JOIN approvals a USING (stock_take_id))"""


def _approved(spark, d, kind: str):
    r = Retail(spark, d)
    take = F.col("stock_take_id")
    approvals = r.count_lines().select("stock_take_id").distinct().filter(take % 5 != 4).select(
        take, (take % 4).cast("int").alias("branch_id"), (take + 100).alias("approved_by"))
    changes = PO.approve_stock_takes(approvals, r.count_lines())
    folder = _folder(spark, "approvals")
    post(changes, folder)
    return r, rows_of(spark, changes, folder, kind)


@job("chg14_approved_products", f"""
WITH {APPROVED_SQL},
g AS (SELECT product_barcode AS barcode, SUM(variance) AS units FROM l WHERE variance <> 0 GROUP BY 1),
m AS (SELECT barcode, branch, SUM(qty) AS qty FROM (
        SELECT barcode, branch, qty FROM stock_levels UNION ALL SELECT product_barcode, branch, variance FROM l WHERE variance <> 0) GROUP BY 1, 2)
SELECT p.barcode, CAST(CASE WHEN g.units IS NULL THEN p.stock ELSE COALESCE(p.stock, 0) + g.units END AS BIGINT) AS stock, m.branch, CAST(m.qty AS BIGINT) AS branch_stock
FROM products p LEFT JOIN g USING (barcode) LEFT JOIN m USING (barcode)""")
def chg14_approved_products(spark, d):
    r, deltas = _approved(spark, d, "product")
    new = add_to_stock(r.products().select("barcode", "stock", "stock_levels"), deltas)
    return new.select("barcode", "stock", F.explode_outer("stock_levels").alias("branch", "branch_stock"))


@job("chg14_approved_audit", f"""
WITH {APPROVED_SQL}
SELECT 'Stock Take Variance' AS action_type, product_barcode, CAST(system_count AS BIGINT) AS quantity_before, CAST(physical_count AS BIGINT) AS quantity_after,
       stock_take_id AS reference_id, 'Stock Take' AS reference_type, approved_by AS user_id FROM l WHERE variance <> 0""")
def chg14_approved_audit(spark, d):
    return _approved(spark, d, "audit")[1]


@job("chg14_approved_status", f"""
WITH {APPROVED_SQL}
SELECT stock_take_id, 'Approved' AS status, approved_by, CAST(SUM(variance) AS BIGINT) AS variance_total FROM l GROUP BY stock_take_id, approved_by""")
def chg14_approved_status(spark, d):
    return _approved(spark, d, "status")[1]


# -- SRC-4: the monthly table, refreshed where its sales changed ----------------------
@job("src04_refreshed_months", """
SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, COALESCE(store_location, 'Main Branch') AS branch, name AS product_name,
       CAST(SUM(qty) AS BIGINT) AS total_qty, CAST(SUM(qty * price) AS DECIMAL(18,2)) AS total_revenue,
       CAST(date_trunc('month', created_at) AS DATE) IN (DATE '1996-02-01', DATE '1997-07-01') AS refreshed
FROM sale_items WHERE status = 'completed' GROUP BY 1, 2, 3""")
def src04_refreshed_months(spark, d):
    r = Retail(spark, d)
    path = _folder(spark, "monthly")
    items = r.sale_items()
    month = F.trunc(F.to_date("created_at"), "month")
    late = month.isin(F.lit("1996-02-01").cast("date"), F.lit("1997-07-01").cast("date")) & (F.col("id") % 2 == 0)     # came in after the first build
    sinks.refresh_months(items.filter(~late), month, S.monthly_product_sales, path, 1)
    sinks.refresh_months(items, month, S.monthly_product_sales, path, 2)
    again = sinks.changed_months(spark, path, 2).select("month", F.lit(True).alias("refreshed"))
    out = sinks.read_months(spark, path, 2).join(again, "month", "left")
    return out.select("month", "branch", "product_name", "total_qty", "total_revenue", F.coalesce("refreshed", F.lit(False)).alias("refreshed"))
