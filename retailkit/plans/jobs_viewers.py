"""Registered purchase order listings and reports for all viewers at once, with their SQL oracle twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.plans import viewers as V

# the orders' status is made from their number; company viewers from suppliers, some without a store
HEADERS_SQL = """pol AS (SELECT *, CASE po_id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Ordered' ELSE 'Received' END AS status FROM purchase_order_lines),
h AS (SELECT l.po_id, l.supplier_id, s.name AS supplier_name, CAST(s.branch_id AS BIGINT) AS branch_id, b.name AS branch_name, l.status, l.n_items, l.total_qty, l.order_date
      FROM (SELECT po_id, supplier_id, MIN(status) AS status, COUNT(*) AS n_items, CAST(SUM(quantity) AS BIGINT) AS total_qty, MIN(order_date) AS order_date
            FROM pol GROUP BY po_id, supplier_id) l
      LEFT JOIN suppliers s ON s.id = l.supplier_id LEFT JOIN branches b ON b.id = s.branch_id)"""
VIEWERS_SQL = """viewers AS (
  SELECT 's' || CAST(id AS VARCHAR) AS viewer_id, 'staff' AS viewer_type, role, branch_id AS store_id FROM users
  UNION ALL SELECT 'c' || CAST(id AS VARCHAR), 'company', 'company', CASE WHEN id % 7 <> 0 THEN CAST(branch_id % 6 AS INTEGER) END FROM suppliers)"""


def _orders(r):
    po = F.col("po_id") % 3
    lines = r.purchase_order_lines().withColumn("status", F.when(po == 0, "Pending").when(po == 1, "Ordered").otherwise("Received"))
    return lines, V.order_headers(lines, r.suppliers(), r.branches())


def _viewers(r):
    staff = r.users().select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("viewer_id"), F.lit("staff").alias("viewer_type"), "role", F.col("branch_id").alias("store_id"))
    return staff.unionByName(r.suppliers().select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("viewer_id"), F.lit("company").alias("viewer_type"), F.lit("company").alias("role"),
        F.when(F.col("id") % 7 != 0, (F.col("branch_id") % 6).cast("int")).alias("store_id")))


@job("rpt32_po_register", f"""
WITH {HEADERS_SQL}
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY branch_id, status ORDER BY order_date DESC NULLS FIRST, po_id DESC, supplier_id DESC) AS INTEGER) AS position FROM h)
WHERE position <= 50""")
def rpt32_po_register(spark, d):
    return V.order_register(_orders(Retail(spark, d))[1])


@job("rpt32_po_details", f"""
WITH {HEADERS_SQL}
SELECT l.po_id, l.supplier_id, l.barcode, l.quantity, p.name AS product_name, h.supplier_name, h.branch_name, h.status
FROM pol l JOIN h ON h.po_id = l.po_id AND h.supplier_id = l.supplier_id LEFT JOIN products p ON p.barcode = l.barcode""")
def rpt32_po_details(spark, d):
    r = Retail(spark, d)
    lines, headers = _orders(r)
    return V.order_details(lines, headers, r.products())


@job("flt01_orders_by_viewer", f"""
WITH {HEADERS_SQL}, {VIEWERS_SQL},
v AS (SELECT viewer_id, CASE WHEN role IN ('admin', 'ceo') OR COALESCE(store_id, 0) = 0 THEN '*' ELSE CAST(store_id AS VARCHAR) END AS scope_key FROM viewers)
SELECT v.viewer_id, v.scope_key, COUNT(h.po_id) AS orders, CAST(COALESCE(SUM(h.total_qty), 0) AS BIGINT) AS total_qty, MAX(h.order_date) AS newest
FROM v LEFT JOIN h ON v.scope_key = '*' OR v.scope_key = CAST(h.branch_id AS VARCHAR) GROUP BY 1, 2""")
def flt01_orders_by_viewer(spark, d):
    r = Retail(spark, d)
    return V.orders_by_viewer(_orders(r)[1], _viewers(r))


@job("flt04_taxes_by_viewer", f"""
WITH {VIEWERS_SQL},
v AS (SELECT viewer_id, viewer_type, CASE WHEN COALESCE(store_id, 0) = 0 THEN 1 ELSE store_id END AS own FROM viewers),
seen AS (SELECT v.viewer_id, t.name, CAST(t.rate AS DOUBLE) AS rate FROM v JOIN tax_rules t ON t.status = 'Active'
         AND (t.branch_id = v.own OR (v.viewer_type <> 'company' AND t.branch_id = 1))),
vat AS (SELECT v.viewer_id, 'VAT' AS name, CASE WHEN st.branch_id IS NOT NULL THEN CAST(st.vat_rate AS DOUBLE)
               ELSE (SELECT MAX(CAST(vat_rate AS DOUBLE)) FROM settings WHERE branch_id = 1) END AS rate
        FROM v LEFT JOIN settings st ON st.branch_id = v.own)
SELECT * FROM vat WHERE rate > 0 AND viewer_id NOT IN (SELECT viewer_id FROM seen WHERE UPPER(name) = 'VAT') UNION ALL SELECT * FROM seen""")
def flt04_taxes_by_viewer(spark, d):
    r = Retail(spark, d)
    return V.taxes_by_viewer(r.tax_rules(), r.settings(), _viewers(r))
