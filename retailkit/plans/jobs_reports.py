"""Registered listings and per-day reports with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import Retail, job
from retailkit.functions import exprs as X
from retailkit.functions.parse import spreadsheet_serial
from retailkit.plans import listings as L
from retailkit.plans import sales as S
from retailkit.plans import stock as K
from retailkit.plans.jobs_stock import DELTAS


@job("rpt23_batches_expiry", """
WITH p AS (SELECT barcode, arg_min(name, id) AS name, CAST(SUM(stock) AS BIGINT) AS current_stock FROM products GROUP BY barcode)
SELECT b.product_barcode, b.batch_number, b.branch_id, b.expiry_date, b.quantity, p.name, p.current_stock
FROM batches b LEFT JOIN p ON p.barcode = b.product_barcode WHERE b.quantity > 0""")
def rpt23_batches_expiry(spark, d):
    r = Retail(spark, d)
    return L.batches_expiry(r.batches(), r.products())


@job("agg11_daily_profit", """
WITH c AS (SELECT sale_id, SUM(CASE WHEN COALESCE(qty, 0) = 0 THEN 1 ELSE qty END * COALESCE(cost_price, 0)) AS cost FROM sale_lines GROUP BY sale_id)
SELECT CAST(s.created_at AS DATE) AS day, CAST(SUM(s.total_amount) AS DECIMAL(18,2)) AS revenue,
       CAST(SUM(COALESCE(c.cost, 0)) AS DECIMAL(18,2)) AS cost,
       CAST(SUM(s.total_amount - COALESCE(c.cost, 0)) AS DECIMAL(18,2)) AS profit
FROM sales s LEFT JOIN c ON c.sale_id = s.id WHERE s.status = 'completed' GROUP BY 1""")
def agg11_daily_profit(spark, d):
    r = Retail(spark, d)
    return L.daily_profit(r.sale_headers(), r.sale_lines())


@job("rpt40_completed_all", """
SELECT s.id, s.receipt_number, s.created_at, s.store_location, s.total_amount, s.payment_method, s.is_return, u.name AS cashier_name
FROM sales s LEFT JOIN users u ON u.id = s.user_id WHERE s.status = 'completed'""")
def rpt40_completed_all(spark, d):
    r = Retail(spark, d)
    return L.completed_sales(r.sale_headers(), r.users())


@job("rpt11_approval_history", """
SELECT id, name, account_number, credit_limit, status FROM customers WHERE status IN ('Active', 'Rejected')""")
def rpt11_approval_history(spark, d):
    return L.approval_history(Retail(spark, d).customers())


@job("rpt33_movement_view", f"""
WITH {DELTAS},
a AS (SELECT d.id AS reference_id, d.pos, d.barcode, d.delta, d.created_at, d.user_id,
             COALESCE(p.stock, 0) + SUM(d.delta) OVER w AS quantity_after
      FROM deltas d JOIN products p ON p.barcode = d.barcode
      WINDOW w AS (PARTITION BY d.barcode ORDER BY d.created_at, d.id, d.pos, d.qty ROWS UNBOUNDED PRECEDING))
SELECT a.reference_id, a.pos, a.created_at, a.barcode, COALESCE(p.name, 'Unknown') AS product_name,
       COALESCE(u.name, 'System') AS user_name, CAST(a.quantity_after - a.delta AS BIGINT) AS quantity_before,
       CAST(a.quantity_after AS BIGINT) AS quantity_after,
       CASE WHEN a.delta > 0 THEN 'Qty Added' WHEN a.delta < 0 THEN 'Qty Removed' ELSE 'Change' END AS change_label
FROM a LEFT JOIN products p ON p.barcode = a.barcode LEFT JOIN users u ON u.id = a.user_id""")
def rpt33_movement_view(spark, d):
    r = Retail(spark, d)
    p = r.products()
    audit = K.audit_rows(K.sale_deltas(r.sale_items(), p, r.branches()), p)
    return L.movement_view(audit, r.sale_headers(), p, r.users())


@job("fn26_merge_aliases", """
WITH m AS (SELECT barcode, SUM(qty) AS q FROM stock_levels WHERE branch IN ('B1', 'B2') GROUP BY barcode)
SELECT barcode, branch, CAST(qty AS BIGINT) AS qty FROM stock_levels WHERE branch NOT IN ('B1', 'B2')
UNION ALL
SELECT p.barcode, 'B1', CAST(COALESCE(m.q, 0) AS BIGINT) FROM products p LEFT JOIN m ON m.barcode = p.barcode""")
def fn26_merge_aliases(spark, d):
    p = L.merge_aliases(Retail(spark, d).products(), F.lit("B1"), F.array(F.lit("B1"), F.lit("B2"), F.lit("Depot")))
    return p.select("barcode", F.explode("stock_levels").alias("branch", "qty"))


@job("agg19_debtors", """
SELECT COUNT(*) FILTER (WHERE current_balance > 0) AS active_debtors,
       CAST(COALESCE(SUM(current_balance), 0) AS DECIMAL(18,2)) AS total_owed,
       CAST(COALESCE(SUM(credit_limit), 0) AS DECIMAL(18,2)) AS total_limit FROM customers""")
def agg19_debtors(spark, d):
    c = Retail(spark, d).customers()
    return c.agg(F.count_if(F.col("current_balance") > 0).alias("active_debtors"),
                 X.money_sum("current_balance", zero=True).alias("total_owed"), X.money_sum("credit_limit", zero=True).alias("total_limit"))


@job("agg02_dashboard_in_row", """
SELECT COALESCE(s.store_location, 'Main Branch') AS branch, CAST(s.created_at AS DATE) AS day,
       CAST(COALESCE(SUM(CASE WHEN s.is_return THEN -1 ELSE 1 END * COALESCE(g.gross, 0)), 0) AS DECIMAL(18,2)) AS total_sales,
       COUNT(CASE WHEN NOT s.is_return THEN 1 END) AS total_transactions
FROM sales s LEFT JOIN (SELECT sale_id, SUM(qty * price) AS gross FROM sale_lines GROUP BY sale_id) g ON g.sale_id = s.id
WHERE LOWER(s.status) = 'completed' GROUP BY 1, 2""")
def agg02_dashboard_in_row(spark, d):
    return S.dashboard_daily(Retail(spark, d).sales())


@job("flt11_optional_filters", """
SELECT COALESCE(store_location, 'Main Branch') AS branch, COUNT(*) AS transactions, CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE status = 'completed' AND created_at >= TIMESTAMP '2000-01-01 00:00:00' AND created_at <= TIMESTAMP '2000-12-31 23:59:59'
  AND store_location IN (SELECT name FROM branches WHERE id % 2 = 0) GROUP BY 1""")
def flt11_optional_filters(spark, d):
    r = Retail(spark, d)
    names = r.branches().filter("id % 2 = 0").select(F.col("name").alias("store_location"))
    wanted = {"status": "completed", "since": "2000-01-01 00:00:00", "until": "2000-12-31 23:59:59", "payment_method": None}
    return L.filtered_totals(r.sale_headers().join(names, "store_location", "left_semi"), **wanted)


@job("fn09_serial_dates", """
SELECT p_partkey AS id, DATE '1900-01-01' + CAST(40000 + p_partkey % 9000 - 2 AS INTEGER) AS day FROM part""")
def fn09_serial_dates(spark, d):
    p = Retail(spark, d).raw("part")
    return p.select(F.col("p_partkey").alias("id"), spreadsheet_serial(40000 + F.col("p_partkey") % 9000).alias("day"))
