"""Registered sales jobs with their SQL oracle twins."""

from __future__ import annotations

from retailkit.catalog import job, Retail, SALES_AS_OF, STOCK_KEYS
from retailkit.plans import sales as S

AS_OF = SALES_AS_OF                # 2001-06-15
MONTH_START = "2001-06-01"
YEAR_START = "2001-01-01"
CI = "LOWER(status) = 'completed'"
EXACT = "status = 'completed'"


@job("rpt09_branch_matrix", f"""
SELECT COALESCE(store_location, 'Main Branch') AS branch,
       COUNT(CASE WHEN is_return = FALSE THEN 1 END) AS txn_count,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE {CI} GROUP BY store_location""")
def rpt09_branch_matrix(spark, d):
    return S.branch_matrix(Retail(spark, d).sale_headers())


@job("rpt09_branch_matrix_range", f"""
SELECT COALESCE(store_location, 'Main Branch') AS branch,
       COUNT(CASE WHEN is_return = FALSE THEN 1 END) AS txn_count,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE {CI} AND created_at >= TIMESTAMP '2000-01-01 00:00:00'
  AND created_at <= CAST(DATE '2000-12-31' AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND
GROUP BY store_location""")
def rpt09_branch_matrix_range(spark, d):
    h = Retail(spark, d).sale_headers(since="2000-01-01", until="2000-12-31 23:59:59")   # pruned at the scan
    return S.branch_matrix(h, start="2000-01-01", end="2000-12-31")


@job("rpt09_branch_performance", """
SELECT COALESCE(store_location, 'Main Branch') AS branch,
       COUNT(CASE WHEN is_return = FALSE THEN 1 END) AS txn_count,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE status = 'completed'
  AND created_at BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2000-06-30 12:00:00'
GROUP BY store_location ORDER BY revenue DESC NULLS FIRST, branch LIMIT 50""")
def rpt09_branch_performance(spark, d):
    h = Retail(spark, d).sale_headers(since="2000-01-01 00:00:00", until="2000-06-30 12:00:00")
    return S.branch_matrix(h, start="2000-01-01 00:00:00",
                           end="2000-06-30 12:00:00", exact_status=True, between=True, limit=50)


@job("rpt01_dashboard_daily", f"""
SELECT COALESCE(s.store_location, 'Main Branch') AS branch, CAST(s.created_at AS DATE) AS day,
       CAST(COALESCE(SUM(CASE WHEN s.is_return THEN -1 ELSE 1 END * COALESCE(g.gross, 0)), 0) AS DECIMAL(18,2))
         AS total_sales,
       COUNT(CASE WHEN NOT s.is_return THEN 1 END) AS total_transactions
FROM sales s LEFT JOIN (SELECT sale_id, SUM(qty * price) AS gross FROM sale_lines GROUP BY sale_id) g
  ON g.sale_id = s.id
WHERE LOWER(s.status) = 'completed'
GROUP BY 1, 2""")
def rpt01_dashboard_daily(spark, d):
    r = Retail(spark, d)
    return S.dashboard_daily_flat(r.sale_headers(), r.sale_lines())


@job("rpt01_low_stock_counts", """
SELECT k.branch, COUNT(*) FILTER (WHERE COALESCE(sl.qty, 0) <= COALESCE(p.reorder_level, 10)) AS low_stock
FROM products p CROSS JOIN (VALUES ('Main Warehouse'), ('B1'), ('B2')) k(branch)
LEFT JOIN stock_levels sl ON sl.barcode = p.barcode AND sl.branch = k.branch
GROUP BY k.branch
UNION ALL
SELECT 'All Branches', COUNT(*) FILTER (WHERE COALESCE(stock, 0) <= COALESCE(reorder_level, 10)) FROM products""")
def rpt01_low_stock_counts(spark, d):
    return S.low_stock_counts(Retail(spark, d).products(), STOCK_KEYS)


@job("rpt01_recent_sales", """
SELECT branch, id, receipt_number, created_at, CAST(COALESCE(g.gross, 0) AS DECIMAL(18,2)) AS amount, type, cashier_name FROM (
  SELECT COALESCE(s.store_location, 'Main Branch') AS branch, s.id, s.receipt_number, s.created_at,
         CASE WHEN s.is_return THEN 'RETURN' ELSE 'SALE' END AS type, u.name AS cashier_name,
         ROW_NUMBER() OVER (PARTITION BY COALESCE(s.store_location, 'Main Branch')
                            ORDER BY s.created_at DESC NULLS LAST, s.id DESC) AS rn
  FROM sales s LEFT JOIN users u ON s.user_id = u.id
  WHERE LOWER(s.status) = 'completed' AND NOT s.is_return) t
LEFT JOIN (SELECT sale_id, SUM(qty * price) AS gross FROM sale_lines GROUP BY sale_id) g ON g.sale_id = t.id
WHERE rn <= 5""")
def rpt01_recent_sales(spark, d):
    r = Retail(spark, d)
    return S.recent_sales(r.sale_headers(), r.sale_lines(), r.users())


@job("rpt01_cashier_stats", f"""
SELECT u.name AS cashier, COUNT(s.id) AS transaction_count,
       CAST(SUM(s.total_amount) AS DECIMAL(18,2)) AS total_sales
FROM sales s LEFT JOIN users u ON s.user_id = u.id
WHERE LOWER(s.status) = 'completed' AND s.created_at >= TIMESTAMP '{YEAR_START} 00:00:00'
GROUP BY u.name ORDER BY total_sales DESC NULLS FIRST, cashier NULLS LAST LIMIT 5""")
def rpt01_cashier_stats(spark, d):
    r = Retail(spark, d)
    return S.cashier_stats(r.sale_headers(since=YEAR_START), r.users(), since=YEAR_START)


@job("rpt12_sales_summary", """
SELECT COUNT(*) AS total_transactions,
       COUNT(CASE WHEN is_return = FALSE THEN 1 END) AS sales_transactions,
       COUNT(CASE WHEN is_return = TRUE THEN 1 END) AS return_transactions,
       CAST(COALESCE(SUM(CASE WHEN is_return = FALSE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS gross_sales,
       CAST(COALESCE(SUM(CASE WHEN is_return = TRUE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS returns_amount,
       CAST(COALESCE(SUM(CASE WHEN is_return = FALSE THEN total_amount ELSE 0 END), 0)
          + COALESCE(SUM(CASE WHEN is_return = TRUE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS net_sales,
       CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(18,2)) AS total_amount
FROM sales WHERE status = 'completed'""")
def rpt12_sales_summary(spark, d):
    return S.sales_summary(Retail(spark, d).sale_headers())


@job("rpt12_sales_summary_branch", """
SELECT COUNT(*) AS total_transactions,
       COUNT(CASE WHEN is_return = FALSE THEN 1 END) AS sales_transactions,
       COUNT(CASE WHEN is_return = TRUE THEN 1 END) AS return_transactions,
       CAST(COALESCE(SUM(CASE WHEN is_return = FALSE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS gross_sales,
       CAST(COALESCE(SUM(CASE WHEN is_return = TRUE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS returns_amount,
       CAST(COALESCE(SUM(CASE WHEN is_return = FALSE THEN total_amount ELSE 0 END), 0)
          + COALESCE(SUM(CASE WHEN is_return = TRUE THEN total_amount ELSE 0 END), 0) AS DECIMAL(18,2)) AS net_sales,
       CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(18,2)) AS total_amount
FROM sales WHERE status = 'completed' AND user_id IN (SELECT id FROM users WHERE branch_id = 2)""")
def rpt12_sales_summary_branch(spark, d):
    r = Retail(spark, d)
    return S.sales_summary(S.staff_scoped(r.sale_headers(), r.users(), 2))


@job("rpt12_top_products_net", """
SELECT p.name, CAST(SUM(CASE WHEN NOT i.is_return THEN i.qty ELSE 0 END) AS BIGINT) AS total_sold,
       CAST(SUM(CASE WHEN i.is_return THEN i.qty ELSE 0 END) AS BIGINT) AS total_returned,
       CAST(SUM(CASE WHEN NOT i.is_return THEN i.qty ELSE 0 END)
          - SUM(CASE WHEN i.is_return THEN i.qty ELSE 0 END) AS BIGINT) AS net_sold
FROM sale_items i JOIN products p ON p.barcode = i.barcode
WHERE i.status = 'completed'
GROUP BY p.name ORDER BY net_sold DESC, p.name LIMIT 10""")
def rpt12_top_products_net(spark, d):
    r = Retail(spark, d)
    return S.top_products_net(r.sale_items(), r.products())


PRODUCT_SALES = f"""ps AS (
  SELECT name, CAST(SUM(CASE WHEN is_return THEN -1 ELSE 1 END * qty) AS BIGINT) AS units,
         CAST(SUM(CASE WHEN is_return THEN -1 ELSE 1 END * qty * price) AS DECIMAL(18,2)) AS revenue
  FROM sale_items WHERE {CI} AND created_at >= TIMESTAMP '{MONTH_START} 00:00:00' GROUP BY name)"""


@job("top02_top_products", f"""
WITH {PRODUCT_SALES}
SELECT name, units, revenue FROM ps ORDER BY revenue DESC NULLS LAST, name LIMIT 5""")
def top02_top_products(spark, d):
    return S.top_products(Retail(spark, d).sale_items(since=MONTH_START), since=MONTH_START)


@job("top04_slow_movers", f"""
WITH {PRODUCT_SALES},
top AS (SELECT name FROM ps ORDER BY revenue DESC NULLS LAST, name LIMIT 5),
slow AS (SELECT * FROM ps ORDER BY units ASC NULLS LAST, name LIMIT 5),
dead AS (SELECT id, name, stock FROM products WHERE stock > 0 AND name NOT IN (SELECT name FROM top)
         ORDER BY stock DESC NULLS FIRST, name, id LIMIT 5),
flag AS (SELECT ((SELECT COUNT(*) FROM slow) = 0
                 OR (SELECT COUNT(*) FROM slow WHERE name NOT IN (SELECT name FROM top)) = 0)
                AND (SELECT COUNT(*) FROM dead) > 0 AS use_dead)
SELECT name, CAST(units AS BIGINT) AS units_sold, revenue, 'slow' AS source FROM slow, flag WHERE NOT use_dead
UNION ALL
SELECT name, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(18,2)), 'dead_stock' FROM dead, flag WHERE use_dead""")
def top04_slow_movers(spark, d):
    r = Retail(spark, d)
    return S.slow_movers(r.sale_items(), r.products(), since=MONTH_START)


@job("agg08_monthly_product_sales", f"""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, COALESCE(store_location, 'Main Branch') AS branch, name AS product_name,
       CAST(SUM(qty) AS BIGINT) AS total_qty, CAST(SUM(qty * price) AS DECIMAL(18,2)) AS total_revenue
FROM sale_items WHERE {EXACT} GROUP BY 1, 2, 3""")
def agg08_monthly_product_sales(spark, d):
    return S.monthly_product_sales(Retail(spark, d).sale_items())


@job("agg07_ytd_months", f"""
SELECT m.month, CAST(COALESCE(g.units, 0) AS BIGINT) AS units, CAST(COALESCE(g.revenue, 0) AS DECIMAL(18,2)) AS revenue
FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) m
LEFT JOIN (SELECT month(created_at) AS month, SUM(qty) AS units, SUM(qty * price) AS revenue
           FROM sale_items WHERE {EXACT} AND created_at >= TIMESTAMP '{YEAR_START} 00:00:00' GROUP BY 1) g
  ON g.month = m.month""")
def agg07_ytd_months(spark, d):
    return S.ytd(Retail(spark, d).sale_items(), AS_OF)[0]


@job("agg07_ytd_products", f"""
SELECT barcode, arg_min(name, created_at) AS name, CAST(SUM(qty) AS BIGINT) AS units,
       CAST(SUM(qty * price) AS DECIMAL(18,2)) AS revenue
FROM sale_items WHERE {EXACT} AND created_at >= TIMESTAMP '{YEAR_START} 00:00:00' GROUP BY barcode""")
def agg07_ytd_products(spark, d):
    return S.ytd(Retail(spark, d).sale_items(), AS_OF)[1]


@job("agg11_daily_revenue", f"""
SELECT CAST(created_at AS DATE) AS day, strftime(CAST(created_at AS DATE), '%a') AS dow,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE {CI} GROUP BY 1, 2""")
def agg11_daily_revenue(spark, d):
    return S.daily_revenue(Retail(spark, d).sale_headers())


@job("rpt07_trend_7d", f"""
SELECT day, strftime(day, '%a') AS dow, revenue,
       CAST(ROUND(revenue * 0.70, 2) AS DECIMAL(18,2)) AS costs,
       CAST(ROUND(revenue * 1.10, 2) AS DECIMAL(18,2)) AS forecast
FROM (SELECT CAST(created_at AS DATE) AS day, CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
      FROM sales WHERE {CI} AND created_at >= TIMESTAMP '{AS_OF} 12:00:00' - INTERVAL 7 DAY GROUP BY 1)""")
def rpt07_trend_7d(spark, d):
    return S.trend_7d(Retail(spark, d).sale_headers(), f"{AS_OF} 12:00:00")


@job("agg12_last7_zero_filled", f"""
SELECT c.day, CAST(COALESCE(SUM(s.total_amount), 0) AS DECIMAL(18,2)) AS revenue
FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '{AS_OF}' - INTERVAL 6 DAY, DATE '{AS_OF}' + INTERVAL 1 DAY,
                                                    INTERVAL 1 DAY)) c
LEFT JOIN sales s ON CAST(s.created_at AS DATE) = c.day AND s.status = 'completed'
GROUP BY c.day""")
def agg12_last7_zero_filled(spark, d):
    return S.last_days_zero_filled(Retail(spark, d).sale_headers(), AS_OF)


@job("agg13_peak_hours", f"""
SELECT CAST(EXTRACT(HOUR FROM created_at) AS INTEGER) AS hour, COUNT(*) AS count,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE status = 'completed' AND created_at >= TIMESTAMP '{MONTH_START} 00:00:00' GROUP BY 1""")
def agg13_peak_hours(spark, d):
    return S.peak_hours(Retail(spark, d).sale_headers(since=MONTH_START), AS_OF)


@job("top05_high_value", f"""
SELECT s.id, s.receipt_number, s.total_amount, s.created_at, u.name AS cashier_name
FROM sales s LEFT JOIN users u ON s.user_id = u.id
WHERE s.status = 'completed' AND s.created_at >= TIMESTAMP '{MONTH_START} 00:00:00'
ORDER BY s.total_amount DESC NULLS FIRST, s.id LIMIT 5""")
def top05_high_value(spark, d):
    r = Retail(spark, d)
    return S.high_value(r.sale_headers(since=MONTH_START), r.users(), AS_OF)


@job("agg14_staff_performance", f"""
SELECT u.name, COUNT(CASE WHEN s.is_return = FALSE THEN 1 END) AS transactions,
       CAST(SUM(s.total_amount) AS DECIMAL(18,2)) AS sales,
       CASE WHEN SUM(s.total_amount) > 5000 THEN 'High' ELSE 'Normal' END AS performance
FROM users u JOIN sales s ON u.id = s.user_id
WHERE s.status = 'completed' AND s.created_at >= TIMESTAMP '{MONTH_START} 00:00:00'
GROUP BY u.id, u.name ORDER BY sales DESC NULLS FIRST, u.name LIMIT 10""")
def agg14_staff_performance(spark, d):
    r = Retail(spark, d)
    return S.staff_performance(r.sale_headers(since=MONTH_START), r.users(), AS_OF)


@job("agg03_payment_totals", f"""
SELECT payment_method, COUNT(*) AS count, CAST(SUM(total_amount) AS DECIMAL(18,2)) AS total
FROM sales WHERE {CI} GROUP BY payment_method""")
def agg03_payment_totals(spark, d):
    return S.payment_totals(Retail(spark, d).sale_headers())


@job("agg05_payment_mix", f"""
SELECT b.bucket, COALESCE(g.count, 0) AS count
FROM (VALUES ('cash'), ('momo'), ('card'), ('credit')) b(bucket)
LEFT JOIN (SELECT CASE WHEN LOWER(payment_method) = 'momo' OR contains(LOWER(payment_method), 'mobile') THEN 'momo'
                       WHEN LOWER(payment_method) = 'card' THEN 'card'
                       WHEN LOWER(payment_method) = 'credit' THEN 'credit' ELSE 'cash' END AS bucket, COUNT(*) AS count
           FROM sales WHERE {EXACT} GROUP BY 1) g ON g.bucket = b.bucket""")
def agg05_payment_mix(spark, d):
    return S.payment_mix(Retail(spark, d).sale_headers())


@job("agg24_profitability", f"""
WITH c AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN COALESCE(qty, 0) = 0 THEN 1 ELSE qty END * COALESCE(cost_price, 0)), 0)
              AS DECIMAL(18,2)) AS cogs,
         COUNT(DISTINCT CASE WHEN COALESCE(cost_price, 0) = 0 THEN COALESCE(NULLIF(name, ''), NULLIF(barcode, ''), 'Unknown') END)
           AS products_without_cost
  FROM sale_items WHERE {EXACT}),
t AS (SELECT (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(18,2)) FROM sales WHERE {EXACT}) AS revenue, c.* FROM c)
SELECT revenue, cogs, CAST(revenue - cogs AS DECIMAL(18,2)) AS gross_profit,
       CASE WHEN revenue > 0 THEN ROUND(CAST(cogs AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 4) END AS cost_ratio_pct,
       CASE WHEN revenue > 0 THEN ROUND(CAST(revenue - cogs AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 4) END AS margin_pct,
       products_without_cost
FROM t""")
def agg24_profitability(spark, d):
    r = Retail(spark, d)
    return S.profitability(r.sale_headers(), r.sale_items())


@job("agg24_products_without_cost", f"""
SELECT DISTINCT COALESCE(NULLIF(name, ''), NULLIF(barcode, ''), 'Unknown') AS name
FROM sale_items WHERE {EXACT} AND COALESCE(cost_price, 0) = 0""")
def agg24_products_without_cost(spark, d):
    return S.products_without_cost(Retail(spark, d).sale_items())


@job("agg26_best_of", f"""
SELECT (SELECT name FROM (SELECT name, SUM(qty) AS v FROM sale_items WHERE {EXACT} GROUP BY name)
        ORDER BY v DESC, name DESC LIMIT 1) AS best_product,
       (SELECT name FROM (SELECT COALESCE(u.name, 'Unknown') AS name, SUM(s.total_amount) AS v
                          FROM sales s LEFT JOIN users u ON u.id = s.user_id WHERE s.{EXACT} GROUP BY 1)
        ORDER BY v DESC, name DESC LIMIT 1) AS best_cashier,
       (SELECT b FROM (SELECT COALESCE(store_location, 'Accra Main Branch') AS b, SUM(total_amount) AS v FROM sales
                       WHERE {EXACT} GROUP BY 1) ORDER BY v DESC, b DESC LIMIT 1) AS best_store""")
def agg26_best_of(spark, d):
    r = Retail(spark, d)
    return S.best_of(r.sale_headers(), r.sale_items(), r.users())


@job("agg25_scaled_item_revenue", f"""
WITH sub AS (SELECT s.id, s.total_amount, SUM(l.qty * l.price) AS sub
             FROM sales s JOIN sale_lines l ON l.sale_id = s.id WHERE s.{EXACT} GROUP BY s.id, s.total_amount),
r AS (SELECT id, CASE WHEN sub > 0 AND total_amount > 0 THEN CAST(total_amount AS DOUBLE) / CAST(sub AS DOUBLE) ELSE 1.0 END AS ratio
      FROM sub)
SELECT l.name, ROUND(SUM(CAST(l.qty * l.price AS DOUBLE) * r.ratio), 2) AS revenue
FROM r JOIN sale_lines l ON l.sale_id = r.id GROUP BY l.name ORDER BY revenue DESC, l.name LIMIT 5""")
def agg25_scaled_item_revenue(spark, d):
    return S.scaled_item_revenue(Retail(spark, d).sales())


@job("agg19_customer_activity", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE customer_id IS NULL) AS no_customer,
       COUNT(DISTINCT customer_id) AS customers_with_sales,
       CAST(COALESCE(SUM(total_amount) FILTER (WHERE payment_method = 'credit'), 0) AS DECIMAL(18,2)) AS credit_total
FROM sales""")
def agg19_customer_activity(spark, d):
    return S.customer_activity(Retail(spark, d).sale_headers())


@job("rpt40_completed_register", """
SELECT s.id, s.receipt_number, s.created_at, s.total_amount, c.name AS customer
FROM sales s LEFT JOIN customers c ON s.customer_id = c.id
WHERE s.status = 'completed' ORDER BY s.created_at DESC NULLS FIRST, s.id DESC LIMIT 20""")
def rpt40_completed_register(spark, d):
    r = Retail(spark, d)
    return S.completed_register(r.sale_headers(), r.customers())


@job("rpt13_returns_register", """
SELECT s.id, s.receipt_number, s.original_transaction_id, s.total_amount, s.created_at,
       u.name AS cashier_name, c.name AS customer
FROM sales s LEFT JOIN users u ON s.user_id = u.id LEFT JOIN customers c ON s.customer_id = c.id
WHERE s.is_return""")
def rpt13_returns_register(spark, d):
    r = Retail(spark, d)
    return S.returns_register(r.sale_headers(), r.users(), r.customers())
