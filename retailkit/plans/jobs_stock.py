"""Registered stock jobs with their SQL oracle twins."""

from __future__ import annotations

from retailkit.catalog import job, Retail, SALES_AS_OF, STOCK_KEYS
from retailkit.operators.running import heavy_keys
from retailkit.plans import stock as K

AS_OF = SALES_AS_OF
ALIASES = ("B2", "B1", "Main Warehouse")       # branch-stock alias order used by the lookups
FEFO_ORDER = "expiry_date ASC NULLS LAST, batch_number, branch_id"


@job("rpt21_inventory_list", """
SELECT p.id, p.barcode, p.name, p.stock, CAST(COALESCE(t.total, 0) AS BIGINT) AS calculated_total,
       COALESCE(NULLIF(b2.qty, 0), NULLIF(b1.qty, 0), NULLIF(mw.qty, 0), 0) AS branch_stock,
       COALESCE(bc.n, 0) AS batch_count, bc.next_expiry
FROM products p
LEFT JOIN (SELECT barcode, SUM(qty) AS total FROM stock_levels GROUP BY barcode) t ON t.barcode = p.barcode
LEFT JOIN stock_levels b2 ON b2.barcode = p.barcode AND b2.branch = 'B2'
LEFT JOIN stock_levels b1 ON b1.barcode = p.barcode AND b1.branch = 'B1'
LEFT JOIN stock_levels mw ON mw.barcode = p.barcode AND mw.branch = 'Main Warehouse'
LEFT JOIN (SELECT product_barcode, COUNT(*) AS n, MIN(expiry_date) AS next_expiry FROM batches
           WHERE status = 'Active' GROUP BY product_barcode) bc ON bc.product_barcode = p.barcode""")
def rpt21_inventory_list(spark, d):
    r = Retail(spark, d)
    return K.inventory_list(r.products(), r.batches(by_product=True), ALIASES)


NEG_SQL = """
SELECT p.id, p.name, p.barcode, p.category, v.stock, ABS(v.stock) AS units_owed, ABS(v.stock) * 10 AS debt_value
FROM products p JOIN (
  SELECT p2.barcode, COALESCE(b2.qty, b1.qty, mw.qty, 0) AS stock FROM products p2
  LEFT JOIN stock_levels b2 ON b2.barcode = p2.barcode AND b2.branch = 'B2'
  LEFT JOIN stock_levels b1 ON b1.barcode = p2.barcode AND b1.branch = 'B1'
  LEFT JOIN stock_levels mw ON mw.barcode = p2.barcode AND mw.branch = 'Main Warehouse') v ON v.barcode = p.barcode
WHERE v.stock < 0"""


@job("rpt25_negative_items", NEG_SQL)
def rpt25_negative_items(spark, d):
    return K.negative_items(Retail(spark, d).products(), ALIASES)


@job("agg31_negative_summary", f"""
SELECT COUNT(*) AS negative_items, CAST(COALESCE(SUM(units_owed), 0) AS BIGINT) AS total_units_owed,
       CAST(COALESCE(SUM(debt_value), 0) AS BIGINT) AS total_debt_value
FROM ({NEG_SQL})""")
def agg31_negative_summary(spark, d):
    return K.negative_summary(K.negative_items(Retail(spark, d).products(), ALIASES))


@job("rpt25_negative_global", """
SELECT id, name, barcode, category, COALESCE(stock, 0) AS stock, ABS(COALESCE(stock, 0)) AS units_owed,
       ABS(COALESCE(stock, 0)) * 10 AS debt_value
FROM products WHERE COALESCE(stock, 0) < 0""")
def rpt25_negative_global(spark, d):
    return K.negative_items(Retail(spark, d).products())


@job("rpt22_low_stock_report", """
SELECT barcode, name, category, stock, reorder_level, reorder_level - stock AS shortage,
       ROUND(CAST(stock AS DOUBLE) / CAST(NULLIF(reorder_level, 0) AS DOUBLE) * 100, 2) AS stock_percentage
FROM products WHERE stock < reorder_level""")
def rpt22_low_stock_report(spark, d):
    return K.low_stock_report(Retail(spark, d).products())


@job("agg15_stock_summary", """
SELECT COUNT(*) AS total_products, CAST(SUM(stock) AS BIGINT) AS total_units,
       CAST(SUM(stock * cost_price) AS DECIMAL(18,2)) AS total_cost_value,
       CAST(SUM(stock * price) AS DECIMAL(18,2)) AS total_retail_value,
       COUNT(CASE WHEN stock = 0 THEN 1 END) AS out_of_stock_count,
       COUNT(CASE WHEN stock <= reorder_level THEN 1 END) AS low_stock_count
FROM products""")
def agg15_stock_summary(spark, d):
    return K.stock_summary(Retail(spark, d).products())


@job("agg16_asset_value", """
SELECT k.branch, CAST(COALESCE(SUM(COALESCE(sl.qty, 0) * p.cost_price), 0) AS DECIMAL(18,2)) AS asset_value
FROM products p CROSS JOIN (VALUES ('Main Warehouse'), ('B1'), ('B2')) k(branch)
LEFT JOIN stock_levels sl ON sl.barcode = p.barcode AND sl.branch = k.branch
GROUP BY k.branch
UNION ALL
SELECT 'All Branches', CAST(COALESCE(SUM(stock * cost_price), 0) AS DECIMAL(18,2)) FROM products""")
def agg16_asset_value(spark, d):
    return K.asset_value(Retail(spark, d).products(), STOCK_KEYS)


@job("rpt23_expiry_report", f"""
SELECT b.product_barcode, b.batch_number, b.branch_id, b.expiry_date, p.name,
       CAST(datediff('day', DATE '{AS_OF}', b.expiry_date) AS INTEGER) AS days_to_expiry,
       CASE WHEN b.expiry_date IS NULL THEN 'OK'
            WHEN b.expiry_date < DATE '{AS_OF}' THEN 'Expired'
            WHEN b.expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 7 DAY THEN 'Expiring Soon'
            WHEN b.expiry_date BETWEEN DATE '{AS_OF}' + INTERVAL 7 DAY AND DATE '{AS_OF}' + INTERVAL 30 DAY
              THEN 'Near Expiry'
            ELSE 'OK' END AS status
FROM batches b JOIN products p ON b.product_barcode = p.barcode WHERE b.status = 'Active'""")
def rpt23_expiry_report(spark, d):
    r = Retail(spark, d)
    return K.expiry_report(r.batches(), r.products(), AS_OF)


@job("flt16_expiring_batches", f"""
SELECT b.product_barcode, b.batch_number, b.branch_id, b.expiry_date, p.name,
       CAST(datediff('day', DATE '{AS_OF}', b.expiry_date) AS INTEGER) AS days_to_expiry
FROM batches b JOIN products p ON b.product_barcode = p.barcode
WHERE b.status = 'Active' AND b.expiry_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 30 DAY""")
def flt16_expiring_batches(spark, d):
    r = Retail(spark, d)
    return K.expiring_batches(r.batches(), r.products(), AS_OF, 30)


@job("win05_next_batch", """
SELECT product_barcode, batch_number, branch_id, expiry_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_barcode
                               ORDER BY expiry_date ASC NULLS LAST, created_at, batch_number, branch_id) AS rn
  FROM batches WHERE status = 'Active' AND quantity_available > 0) WHERE rn = 1""")
def win05_next_batch(spark, d):
    return K.next_batch(Retail(spark, d).batches())


@job("win07_latest_batch", """
SELECT product_barcode, batch_number, branch_id, created_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_barcode
                               ORDER BY created_at DESC, batch_number DESC, branch_id DESC) AS rn
  FROM batches) WHERE rn = 1""")
def win07_latest_batch(spark, d):
    return K.latest_batch(Retail(spark, d).batches())


@job("rpt24_reorder_suggestions", """
SELECT id, barcode, name, stock, reorder_level FROM products WHERE stock < COALESCE(reorder_level, 10)""")
def rpt24_reorder_suggestions(spark, d):
    return K.reorder_suggestions(Retail(spark, d).products())


ALERTS = """found AS (
  SELECT barcode, name, stock AS current_stock, reorder_level, reorder_level * 2 AS suggested_quantity,
         CASE WHEN stock = 0 THEN 'Critical' WHEN stock <= reorder_level THEN 'High' ELSE 'Normal' END AS priority
  FROM products WHERE stock <= reorder_level)"""


@job("chg16_reorder_alerts", f"WITH {ALERTS} SELECT * FROM found")
def chg16_reorder_alerts(spark, d):
    return K.reorder_alerts(Retail(spark, d).products())


@job("chg16_alert_upsert", f"""
WITH {ALERTS},
old AS (SELECT barcode, name, 99 AS current_stock, 7 AS reorder_level, 14 AS suggested_quantity, 'Normal' AS priority
        FROM products WHERE id % 4 = 0)
SELECT COALESCE(o.barcode, f.barcode) AS barcode, COALESCE(o.name, f.name) AS name,
       COALESCE(f.current_stock, o.current_stock) AS current_stock,
       CASE WHEN o.barcode IS NULL THEN f.reorder_level ELSE o.reorder_level END AS reorder_level,
       CASE WHEN o.barcode IS NULL THEN f.suggested_quantity ELSE o.suggested_quantity END AS suggested_quantity,
       COALESCE(f.priority, o.priority) AS priority,
       CASE WHEN o.barcode IS NULL THEN 'insert' WHEN f.barcode IS NULL THEN 'keep' ELSE 'update' END AS action
FROM old o FULL OUTER JOIN found f ON o.barcode = f.barcode""")
def chg16_alert_upsert(spark, d):
    p = Retail(spark, d).products()
    old = p.filter("id % 4 = 0").selectExpr("barcode", "name", "99 AS current_stock", "7 AS reorder_level", "14 AS suggested_quantity", "'Normal' AS priority")
    return K.upsert_alerts(old, K.reorder_alerts(p)).withColumnRenamed("_action", "action")


@job("top07_alert_list", f"""
WITH {ALERTS}
SELECT f.barcode, p.name, p.price, f.current_stock, f.priority,
       CASE WHEN f.priority = 'Critical' THEN 1 WHEN f.priority = 'High' THEN 2 ELSE 3 END AS priority_rank
FROM found f JOIN products p ON p.barcode = f.barcode ORDER BY priority_rank, current_stock, f.barcode""")
def top07_alert_list(spark, d):
    p = Retail(spark, d).products()
    return K.alert_list(K.reorder_alerts(p), p)


@job("agg22_duplicate_products", """
SELECT barcode, name, COUNT(*) AS count FROM (
  SELECT barcode, name FROM products UNION ALL SELECT barcode, name FROM products WHERE id % 9 = 0)
GROUP BY barcode, name HAVING COUNT(*) > 1""")
def agg22_duplicate_products(spark, d):
    p = Retail(spark, d).products().select("id", "barcode", "name")
    return K.duplicates(p.unionByName(p.filter("id % 9 = 0")))


@job("chg19_stock_resync", """
WITH m AS (
  SELECT barcode, branch, qty FROM stock_levels
  UNION ALL
  SELECT p.barcode, 'Main Warehouse', p.stock FROM products p
  WHERE NOT EXISTS (SELECT 1 FROM stock_levels s WHERE s.barcode = p.barcode))
SELECT m.barcode, CAST(SUM(m.qty) OVER (PARTITION BY m.barcode) AS BIGINT) AS new_stock, m.branch, m.qty FROM m""")
def chg19_stock_resync(spark, d):
    return K.resync_map(Retail(spark, d).products())


@job("chg20_clean_negative", """
WITH neg AS (SELECT DISTINCT barcode FROM stock_levels WHERE qty < 0),
m AS (SELECT s.barcode, s.branch, GREATEST(s.qty, 0) AS qty FROM stock_levels s JOIN neg USING (barcode))
SELECT barcode, CAST(SUM(qty) OVER (PARTITION BY barcode) AS BIGINT) AS new_stock, branch, qty FROM m""")
def chg20_clean_negative(spark, d):
    return K.clean_negative(Retail(spark, d).products())


DELTAS = """given AS (SELECT given, arg_min(name, rank * 1000000 + id) AS name FROM (
           SELECT name AS given, name, 0 AS rank, id FROM branches UNION ALL SELECT location, name, 1, id FROM branches) GROUP BY given),
deltas AS (
  SELECT i.id, i.pos, i.barcode, i.qty, i.created_at, i.is_return, i.user_id,
         COALESCE(g.name, i.store_location, 'Main Warehouse') AS branch,
         CASE WHEN i.is_return THEN i.qty ELSE -i.qty END AS delta
  FROM sale_items i LEFT JOIN given g ON g.given = i.store_location WHERE i.barcode IN (SELECT barcode FROM products))"""


@job("chg01_stock_after_sales", f"""
WITH {DELTAS}
SELECT p.barcode, CAST(COALESCE(p.stock, 0) + COALESCE(t.d, 0) AS BIGINT) AS new_stock
FROM products p LEFT JOIN (SELECT barcode, SUM(delta) AS d FROM deltas GROUP BY barcode) t ON t.barcode = p.barcode""")
def chg01_stock_after_sales(spark, d):
    r = Retail(spark, d)
    p = r.products()
    return K.stock_after(p, K.sale_deltas(r.sale_items(), p, r.branches())).select("barcode", "new_stock")


@job("chg01_map_after_sales", f"""
WITH {DELTAS},
dm AS (SELECT barcode, branch, SUM(delta) AS d FROM deltas GROUP BY barcode, branch)
SELECT COALESCE(s.barcode, dm.barcode) AS barcode, COALESCE(s.branch, dm.branch) AS branch,
       CAST(COALESCE(s.qty, 0) + COALESCE(dm.d, 0) AS BIGINT) AS qty
FROM stock_levels s FULL OUTER JOIN dm ON s.barcode = dm.barcode AND s.branch = dm.branch""")
def chg01_map_after_sales(spark, d):
    from pyspark.sql import functions as F
    r = Retail(spark, d)
    p = r.products()
    snap = K.stock_after(p, K.sale_deltas(r.sale_items(), p, r.branches()))
    return snap.select("barcode", F.explode("stock_levels").alias("branch", "qty"))


@job("win09_sale_audit", f"""
WITH {DELTAS}
SELECT d.id AS reference_id, d.pos, d.barcode, CASE WHEN d.is_return THEN 'Return' ELSE 'Sale' END AS action_type,
       CAST(COALESCE(p.stock, 0) + SUM(d.delta) OVER w - d.delta AS BIGINT) AS quantity_before,
       CAST(COALESCE(p.stock, 0) + SUM(d.delta) OVER w AS BIGINT) AS quantity_after
FROM deltas d JOIN products p ON p.barcode = d.barcode
WINDOW w AS (PARTITION BY d.barcode ORDER BY d.created_at, d.id, d.pos, d.qty ROWS UNBOUNDED PRECEDING)""")
def win09_sale_audit(spark, d):
    r = Retail(spark, d)
    p = r.products()
    return K.audit_rows(K.sale_deltas(r.sale_items(), p, r.branches()), p)


@job("win02_fefo_single", f"""
WITH s AS (SELECT product_barcode, batch_number, branch_id, quantity,
                  COALESCE(SUM(quantity) OVER (PARTITION BY product_barcode ORDER BY {FEFO_ORDER}
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM batches WHERE quantity > 0)
SELECT product_barcode, batch_number, branch_id, CAST(GREATEST(0, LEAST(quantity, 40 - before)) AS BIGINT) AS take,
       CAST(quantity - GREATEST(0, LEAST(quantity, 40 - before)) AS BIGINT) AS remaining
FROM s JOIN products p ON p.barcode = s.product_barcode
WHERE GREATEST(0, LEAST(quantity, 40 - before)) > 0""")
def win02_fefo_single(spark, d):
    r = Retail(spark, d)
    return K.fefo_for_demand(r.batches(), r.products(), 40, heavy_keys(r.line_products("product_barcode"), ["product_barcode"]))


@job("win03_fefo_sales", f"""
WITH s AS (SELECT product_barcode, batch_number, branch_id, quantity,
                  SUM(quantity) OVER (PARTITION BY product_barcode ORDER BY {FEFO_ORDER} ROWS UNBOUNDED PRECEDING) AS s_hi
           FROM batches WHERE quantity > 0),
d AS (SELECT id AS sale_id, pos, barcode AS product_barcode, qty,
             SUM(qty) OVER (PARTITION BY barcode ORDER BY created_at, id, pos, qty ROWS UNBOUNDED PRECEDING) AS d_hi
      FROM sale_items WHERE LOWER(status) = 'completed' AND NOT is_return AND qty > 0)
SELECT d.sale_id, d.pos, d.product_barcode, s.batch_number, s.branch_id,
       CAST(LEAST(d.d_hi, s.s_hi) - GREATEST(d.d_hi - d.qty, s.s_hi - s.quantity) AS BIGINT) AS take
FROM d JOIN s ON d.product_barcode = s.product_barcode
 AND d.d_hi - d.qty < s.s_hi AND s.s_hi - s.quantity < d.d_hi""")
def win03_fefo_sales(spark, d):
    r = Retail(spark, d)
    return K.fefo_for_sales(r.batches(), r.sale_items(), heavy_keys(r.line_products("product_barcode"), ["product_barcode"]))


@job("win04_return_restock", f"""
WITH f AS (SELECT product_barcode, batch_number, branch_id, quantity,
                  ROW_NUMBER() OVER (PARTITION BY product_barcode ORDER BY {FEFO_ORDER}) AS rn FROM batches),
r AS (SELECT barcode AS product_barcode, SUM(qty) AS returned FROM sale_items WHERE is_return GROUP BY barcode)
SELECT f.product_barcode, f.batch_number, f.branch_id, CAST(r.returned AS BIGINT) AS returned,
       CAST(f.quantity + r.returned AS BIGINT) AS new_quantity
FROM f JOIN r ON r.product_barcode = f.product_barcode WHERE f.rn = 1""")
def win04_return_restock(spark, d):
    r = Retail(spark, d)
    return K.restock_returns(r.batches(), r.sale_items())


@job("agg18_count_variance", """
SELECT stock_take_id, CAST(COALESCE(SUM(variance), 0) AS BIGINT) AS total_variance FROM count_lines
GROUP BY stock_take_id""")
def agg18_count_variance(spark, d):
    return K.count_variance(Retail(spark, d).count_lines())


@job("chg13_quick_count", """
SELECT c.product_barcode, c.physical_count - COALESCE(sl.qty, 0) AS variance, c.physical_count AS new_branch_stock,
       COALESCE(p.stock, 0) + c.physical_count - COALESCE(sl.qty, 0) AS new_total
FROM count_lines c JOIN products p ON p.barcode = c.product_barcode
LEFT JOIN stock_levels sl ON sl.barcode = c.product_barcode AND sl.branch = 'B1'
WHERE c.physical_count - COALESCE(sl.qty, 0) <> 0""")
def chg13_quick_count(spark, d):
    r = Retail(spark, d)
    return K.quick_count(r.count_lines(), r.products(), "B1")
