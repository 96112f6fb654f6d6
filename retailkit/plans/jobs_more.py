"""Registered composite reports and change jobs (second batch) with their SQL oracle twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.operators.running import heavy_keys
from retailkit.plans import changes as CH
from retailkit.plans import credit as C
from retailkit.plans import reports as RP

START, END = "2000-01-01", "2024-12-31"        # a period covering both the sales and the events years


@job("rpt06_ceo_financials", f"""
WITH rev AS (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(18,2)) AS revenue FROM sales
             WHERE LOWER(status) = 'completed' AND created_at >= TIMESTAMP '{START} 00:00:00'
               AND created_at <= CAST(DATE '{END}' AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND),
ex AS (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS opex FROM expenses
       WHERE expense_date BETWEEN DATE '{START}' AND DATE '{END}'),
comp AS (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(18,2)) AS company_revenue FROM invoices
         WHERE kind = 'sales'),
a AS (SELECT CAST(COALESCE(SUM(stock * cost_price), 0) AS DECIMAL(18,2)) AS asset_value FROM products),
b AS (SELECT COUNT(*) AS branch_count FROM branches),
t AS (SELECT CAST(COALESCE(MAX(monthly_target), 50000) AS DECIMAL(18,2)) AS target FROM settings WHERE branch_id = 1)
SELECT revenue, company_revenue, ROUND(CAST(revenue AS DOUBLE) * 0.7, 2) AS cogs, opex,
       ROUND(CAST(revenue AS DOUBLE) - CAST(revenue AS DOUBLE) * 0.7, 2) AS gross_profit,
       ROUND(CAST(revenue AS DOUBLE) - CAST(revenue AS DOUBLE) * 0.7 - CAST(opex AS DOUBLE), 2) AS net_profit,
       asset_value, branch_count, target
FROM rev, ex, comp, a, b, t""")
def rpt06_ceo_financials(spark, d):
    r = Retail(spark, d)
    return RP.ceo_financials(r.sale_headers(), r.expenses(), r.invoices(), r.products(), r.branches(), r.settings(),
                             START, END)


@job("rpt08_risk_radar", """
SELECT 'Stockout Risk' AS type, CAST(n AS VARCHAR) || ' items are critically low on stock.' AS message,
       'high' AS severity
FROM (SELECT COUNT(*) FILTER (WHERE stock <= reorder_level) AS n FROM products) WHERE n > 0""")
def rpt08_risk_radar(spark, d):
    return RP.risk_radar(Retail(spark, d).products())


@job("rpt10_ceo_low_stock", """
SELECT id, name, stock, reorder_level FROM products WHERE stock <= reorder_level
ORDER BY stock ASC NULLS LAST, name, id LIMIT 10""")
def rpt10_ceo_low_stock(spark, d):
    return RP.ceo_low_stock(Retail(spark, d).products())


@job("rpt15_receipt_totals", """
WITH rate AS (SELECT sale_id, SUM(CAST(rate AS DOUBLE)) / 100 AS rate FROM sale_taxes GROUP BY sale_id),
l AS (SELECT l.sale_id AS id, CAST(l.price * l.qty - COALESCE(l.discount, 0) AS DOUBLE) AS final,
             CAST(l.price * l.qty - COALESCE(l.discount, 0) AS DOUBLE) / (1 + COALESCE(r.rate, 0.0)) AS net
      FROM sale_lines l JOIN sales s ON s.id = l.sale_id LEFT JOIN rate r ON r.sale_id = l.sale_id)
SELECT id, ROUND(SUM(final), 2) AS total, ROUND(SUM(net), 2) AS subtotal, ROUND(SUM(final) - SUM(net), 2) AS tax
FROM l GROUP BY id""")
def rpt15_receipt_totals(spark, d):
    return RP.receipt_totals(Retail(spark, d).sales())


@job("rpt17_company_transactions", """
WITH ct AS (SELECT id * 10 AS id, company_id, total_amount AS amount, issue_date AS created_at, CASE WHEN id % 8 <> 0 THEN id END AS invoice_id
            FROM invoices WHERE kind = 'sales')
SELECT ct.id, ct.company_id, ct.invoice_id, i.invoice_number, ct.amount, ct.created_at
FROM ct LEFT JOIN invoices i ON i.id = ct.invoice_id WHERE ct.company_id = (SELECT MIN(company_id) FROM ct)""")
def rpt17_company_transactions(spark, d):
    i = Retail(spark, d).invoices()
    ct = i.filter("kind = 'sales'").selectExpr("id * 10 AS id", "company_id", "total_amount AS amount", "issue_date AS created_at",
                                               "CASE WHEN id % 8 <> 0 THEN id END AS invoice_id")     # some without an invoice
    return RP.company_transactions(ct, i)


@job("rpt26_product_performance", """
WITH g AS (SELECT barcode, SUM(qty) AS q, SUM(qty * price) AS r FROM sale_items
           WHERE LOWER(status) = 'completed' AND store_location = 'NATION_1'
             AND created_at >= TIMESTAMP '2001-05-01 00:00:00' AND created_at < TIMESTAMP '2001-06-01 00:00:00'
           GROUP BY barcode)
SELECT p.barcode, p.name, p.category, CAST(COALESCE(g.q, 0) AS BIGINT) AS quantity_sold,
       CAST(COALESCE(g.r, 0) AS DECIMAL(18,2)) AS revenue,
       ROUND(CAST(COALESCE(g.q, 0) AS DOUBLE) / 31, 4) AS avg_daily_sales,
       CASE WHEN CAST(COALESCE(g.q, 0) AS DOUBLE) / 31 >= 1.0 THEN 'Fast Moving'
            WHEN COALESCE(g.q, 0) > 0 THEN 'Slow Moving' ELSE 'Dead Stock' END AS classification,
       p.stock AS current_stock
FROM products p LEFT JOIN g ON g.barcode = p.barcode""")
def rpt26_product_performance(spark, d):
    r = Retail(spark, d)
    return RP.product_performance(r.sale_items(), r.products(), "NATION_1", 2001, 5)


@job("rpt41_batches_by_product", """
SELECT b.product_barcode, p.name, b.batch_number, b.branch_id, b.expiry_date, b.quantity_available,
       ROW_NUMBER() OVER (PARTITION BY b.product_barcode
                          ORDER BY b.expiry_date ASC NULLS LAST, b.batch_number, b.branch_id) AS fefo_rank
FROM batches b JOIN products p ON p.barcode = b.product_barcode WHERE b.quantity_available > 0""")
def rpt41_batches_by_product(spark, d):
    r = Retail(spark, d)
    return RP.batches_by_product(r.batches(), r.products(), heavy_keys(r.line_products("product_barcode"), ["product_barcode"]))


# -- changes -----------------------------------------------------------------------------
@job("chg03_post_returns", """
SELECT s.id, TRUE AS has_returns, r.refunds, CAST(s.total_amount - r.refunded AS DECIMAL(18,2)) AS current_total
FROM sales s JOIN (SELECT original_transaction_id AS id, SUM(total_amount) AS refunded, COUNT(*) AS refunds
                   FROM sales WHERE is_return AND original_transaction_id IS NOT NULL GROUP BY 1) r ON r.id = s.id""")
def chg03_post_returns(spark, d):
    return CH.post_returns(Retail(spark, d).sale_headers())


POSTED = """posted AS (
  SELECT customer_id, created_at AS date,
         CASE WHEN is_return THEN 'Credit Return - ' ELSE 'Credit Sale - ' END || receipt_number AS description,
         CASE WHEN is_return THEN 'RETURN' ELSE 'SALE' END AS type,
         CAST(CASE WHEN is_return THEN 0 ELSE total_amount END AS DECIMAL(18,2)) AS debit,
         CAST(CASE WHEN is_return THEN total_amount ELSE 0 END AS DECIMAL(18,2)) AS credit, id AS transaction_id, id AS ref_id
  FROM sales WHERE status = 'completed' AND customer_id IS NOT NULL AND payment_method = 'credit'
  UNION ALL SELECT customer_id, payment_date, 'Payment Received', 'PAYMENT', CAST(0 AS DECIMAL(18,2)),
                   CAST(amount AS DECIMAL(18,2)), NULL, id FROM payments)"""


@job("chg06_credit_balances", f"""
WITH {POSTED}
SELECT c.id AS customer_id, CAST(c.current_balance AS DECIMAL(18,2)) AS old_balance,
       CAST(c.current_balance + g.d - g.c AS DECIMAL(18,2)) AS new_balance
FROM customers c JOIN (SELECT customer_id, SUM(debit) AS d, SUM(credit) AS c FROM posted GROUP BY 1) g
  ON g.customer_id = c.id""")
def chg06_credit_balances(spark, d):
    r = Retail(spark, d)
    return CH.credit_balances(r.customers(), C.posted_ledger(r.sale_headers(), r.payments()))


@job("chg06_ledger_rows", f"""
WITH {POSTED}
SELECT p.customer_id, p.date, p.description, p.type, p.debit, p.credit, p.transaction_id,
       CAST(c.current_balance + SUM(p.debit - p.credit) OVER (PARTITION BY p.customer_id ORDER BY p.date, p.type, p.ref_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
FROM posted p JOIN customers c ON c.id = p.customer_id""")
def chg06_ledger_rows(spark, d):
    r = Retail(spark, d)
    return CH.ledger_rows(r.customers(), C.running_balance(C.posted_ledger(r.sale_headers(), r.payments())))


@job("chg26_credit_decisions", """
WITH last AS (SELECT customer_id, arg_max(decision, decided_at) AS decision FROM credit_decisions GROUP BY 1)
SELECT c.id,
       CASE WHEN l.decision = 'approve' AND c.pending_credit_limit IS NOT NULL THEN c.pending_credit_limit
            ELSE c.credit_limit END AS credit_limit,
       CAST(NULL AS DECIMAL(12,2)) AS pending_credit_limit,
       CASE WHEN c.status = 'Pending' THEN CASE WHEN l.decision = 'approve' THEN 'Active' ELSE 'Rejected' END
            ELSE c.status END AS status
FROM customers c JOIN last l ON l.customer_id = c.id""")
def chg26_credit_decisions(spark, d):
    r = Retail(spark, d)
    return CH.apply_credit_decisions(r.customers(), r.credit_decisions())


@job("chg32_delete_customers", """
WITH d AS (SELECT id AS customer_id FROM customers WHERE status = 'Pending')
SELECT 'customers' AS "table", COUNT(*) AS rows FROM customers WHERE id NOT IN (SELECT customer_id FROM d)
UNION ALL SELECT 'payments', COUNT(*) FROM payments WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM d)
UNION ALL SELECT 'ledger', COUNT(*) FROM ledger WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM d)
UNION ALL SELECT 'sales', COUNT(*) FROM sales WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM d)""")
def chg32_delete_customers(spark, d):
    r = Retail(spark, d)
    c = r.customers()
    return CH.delete_customers(c, r.sale_headers(), r.payments(), C.build_ledger(r.sale_headers(), r.payments()),
                               c.filter(F.col("status") == "Pending"))


def _approve_sql(expr: str, agg: str) -> str:
    return f"""
WITH g AS (SELECT product_barcode AS barcode, {agg} AS v FROM count_lines WHERE stock_take_id % 2 = 0 GROUP BY 1)
SELECT p.barcode, p.stock AS old_stock, CAST({expr} AS BIGINT) AS new_stock FROM products p JOIN g USING (barcode)"""


@job("chg14_approve_counts_delta", _approve_sql("COALESCE(p.stock, 0) + g.v", "SUM(variance)"))
def chg14_approve_counts_delta(spark, d):
    r = Retail(spark, d)
    lines = r.count_lines()
    approved = lines.select("stock_take_id").distinct().filter(F.col("stock_take_id") % 2 == 0)
    return CH.approve_counts(lines, r.products(), approved, "delta")


@job("chg14_approve_counts_absolute", _approve_sql("g.v", "arg_max(physical_count, stock_take_id)"))
def chg14_approve_counts_absolute(spark, d):
    r = Retail(spark, d)
    lines = r.count_lines()
    approved = lines.select("stock_take_id").distinct().filter(F.col("stock_take_id") % 2 == 0)
    return CH.approve_counts(lines, r.products(), approved, "absolute")


@job("chg15_adjustments", """
WITH a AS (SELECT product_barcode AS barcode, SUM(variance) AS qty FROM count_lines WHERE variance <> 0 GROUP BY 1)
SELECT p.barcode, CASE WHEN a.qty > 0 THEN 'Found' ELSE 'Damaged' END AS reason, CAST(a.qty AS BIGINT) AS quantity,
       CAST(COALESCE(p.stock, 0) AS BIGINT) AS quantity_before, CAST(COALESCE(p.stock, 0) + a.qty AS BIGINT) AS quantity_after
FROM products p JOIN a USING (barcode)""")
def chg15_adjustments(spark, d):
    r = Retail(spark, d)
    return CH.adjustments_from_counts(r.count_lines(), r.products())


@job("chg22_batch_backfill", """
SELECT product_barcode, batch_number, COALESCE(branch_id, 1) AS branch_id,
       CASE WHEN COALESCE(quantity_available, 0) = 0 THEN quantity ELSE quantity_available END AS quantity_available
FROM batches""")
def chg22_batch_backfill(spark, d):
    return CH.backfill_batches(Retail(spark, d).batches())


@job("chg29_sell_from_batches", """
WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS product_barcode, CAST(l_orderkey AS VARCHAR) AS batch_number,
                  CAST(l_suppkey AS INTEGER) AS branch_id, SUM(CAST(l_quantity AS INTEGER)) AS q
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F'
           GROUP BY 1, 2, 3)
SELECT b.product_barcode, b.batch_number, b.branch_id, CAST(b.quantity_available - g.q AS BIGINT) AS quantity_available,
       CAST(COALESCE(b.quantity_sold, 0) + g.q AS BIGINT) AS quantity_sold
FROM batches b JOIN g USING (product_barcode, batch_number, branch_id)""")
def chg29_sell_from_batches(spark, d):
    r = Retail(spark, d)
    l = r.raw("lineitem")
    o = r.raw("orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    picks = l.join(o, l.l_orderkey == o.o_orderkey, "inner").select(
        F.col("l_partkey").cast("string").alias("product_barcode"), F.col("l_orderkey").cast("string").alias("batch_number"),
        F.col("l_suppkey").cast("int").alias("branch_id"), F.col("l_quantity").cast("int").alias("qty"))
    return CH.sell_from_batches(r.batches(), picks)


@job("chg28_shelf_moves", """
SELECT t.barcode, CAST(SUM(t.qty) AS BIGINT) AS on_shelf, COUNT(*) AS moves
FROM transfers t JOIN products p ON p.barcode = t.barcode WHERE COALESCE(p.stock, 0) >= t.qty GROUP BY 1""")
def chg28_shelf_moves(spark, d):
    r = Retail(spark, d)
    return CH.shelf_moves(r.transfers().select("barcode", "qty"), r.products())


@job("chg12_confirm_transfers", """
SELECT transfer_id, to_location, barcode, qty AS sent, received_qty AS received, 'Confirmed' AS status
FROM transfers WHERE status = 'In Transit'""")
def chg12_confirm_transfers(spark, d):
    return CH.confirm_transfers(Retail(spark, d).transfers())


@job("chg23_quick_sale_stock", """
WITH g AS (SELECT barcode, SUM(qty) AS q FROM sale_lines GROUP BY barcode),
k AS (SELECT barcode, MIN(branch) AS key FROM stock_levels WHERE UPPER(branch) = UPPER('main warehouse') GROUP BY 1)
SELECT p.barcode, k.key AS matched_key, CAST(COALESCE(p.stock, 0) - g.q AS BIGINT) AS new_stock,
       CAST(CASE WHEN k.key IS NOT NULL THEN sl.qty - g.q END AS BIGINT) AS new_branch_stock
FROM products p JOIN g ON g.barcode = p.barcode LEFT JOIN k ON k.barcode = p.barcode
LEFT JOIN stock_levels sl ON sl.barcode = p.barcode AND sl.branch = k.key""")
def chg23_quick_sale_stock(spark, d):
    r = Retail(spark, d)
    return CH.quick_sale_stock(r.sale_lines(), r.products(), "main warehouse")


@job("chg25_invoice_payments", """
SELECT i.id, CAST(i.paid_amount + g.p AS DECIMAL(18,2)) AS paid_amount,
       CASE WHEN i.paid_amount + g.p >= i.total_amount THEN 'Paid' ELSE 'Partially Paid' END AS status
FROM invoices i JOIN (SELECT invoice_id, SUM(amount) AS p FROM invoice_payments GROUP BY 1) g ON g.invoice_id = i.id""")
def chg25_invoice_payments(spark, d):
    r = Retail(spark, d)
    return CH.apply_invoice_payments(r.invoices(), r.invoice_payments())


@job("chg31_promo_rekey", """
SELECT code, branch_id, discount_percentage FROM promotions WHERE code <> 'PROMO-23'
UNION ALL
SELECT DISTINCT 'PROMO-23', branch_id, CAST(5.00 AS DECIMAL(5,2)) FROM users WHERE LOWER(status) = 'active' AND branch_id IS NOT NULL""")
def chg31_promo_rekey(spark, d):
    r = Retail(spark, d)
    return CH.rekey_promotions(r.promotions(), r.users(), "PROMO-23", "5.00")


@job("chg35_shift_pairing", """
SELECT user_id, start_time, end_time FROM (
  SELECT user_id, ts AS start_time, kind,
         MIN(CASE WHEN kind = 'close' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts DESC, kind ASC
                                                         ROWS UNBOUNDED PRECEDING) AS end_time
  FROM shift_events) WHERE kind = 'open'""")
def chg35_shift_pairing(spark, d):
    return CH.pair_shift_events(Retail(spark, d).shift_events())
