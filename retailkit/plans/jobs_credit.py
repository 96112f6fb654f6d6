"""Registered shift and credit jobs with their SQL oracle twins."""

from __future__ import annotations

from retailkit.catalog import job, Retail
from retailkit.plans import credit as C
from retailkit.plans import shifts as H

BUCKET = """CASE WHEN LOWER(payment_method) = 'cash' THEN 'cash'
                 WHEN LOWER(payment_method) = 'momo' OR contains(LOWER(payment_method), 'mobile') THEN 'momo'
                 WHEN LOWER(payment_method) = 'card' THEN 'card' END"""


# -- shifts ----------------------------------------------------------------------
@job("jn05_shift_sales", "SELECT shift_id, sale_id FROM shift_pairs")
def jn05_shift_sales(spark, d):
    r = Retail(spark, d)
    return H.shift_sales(r.shifts(), r.event_sales()).select("shift_id", "sale_id")


@job("rpt04_shift_history", """
SELECT s.id, s.user_id, s.start_time, s.end_time, u.name AS user_name, u.store_location AS branch,
       CAST(COALESCE(SUM(t.total_amount), 0) AS DECIMAL(18,2)) AS total_sales
FROM shifts s LEFT JOIN users u ON s.user_id = u.id
LEFT JOIN event_sales t ON t.user_id = s.user_id AND t.created_at >= s.start_time
 AND (s.end_time IS NULL OR t.created_at <= s.end_time)
GROUP BY s.id, s.user_id, s.start_time, s.end_time, u.name, u.store_location""")
def rpt04_shift_history(spark, d):
    r = Retail(spark, d)
    return H.shift_history(r.shifts(), r.event_sales(), r.users())


@job("rpt02_shift_cashup", f"""
WITH b AS (SELECT shift_id,
                  CAST(COALESCE(SUM(CASE WHEN {BUCKET} = 'cash' THEN total_amount END), 0) AS DECIMAL(18,2)) AS cash,
                  CAST(COALESCE(SUM(CASE WHEN {BUCKET} = 'momo' THEN total_amount END), 0) AS DECIMAL(18,2)) AS momo,
                  CAST(COALESCE(SUM(CASE WHEN {BUCKET} = 'card' THEN total_amount END), 0) AS DECIMAL(18,2)) AS card
           FROM shift_pairs GROUP BY shift_id),
x AS (SELECT s.id AS shift_id, s.user_id, CAST(s.start_cash AS DECIMAL(18,2)) AS start_cash,
             COALESCE(b.cash, 0) AS cash_sales, COALESCE(b.momo, 0) AS momo_sales, COALESCE(b.card, 0) AS card_sales,
             CAST(COALESCE(s.start_cash, 0) + COALESCE(b.cash, 0) AS DECIMAL(18,2)) AS expected_cash, s.end_cash
      FROM shifts s LEFT JOIN b ON b.shift_id = s.id)
SELECT shift_id, user_id, start_cash, CAST(cash_sales AS DECIMAL(18,2)) AS cash_sales,
       CAST(momo_sales AS DECIMAL(18,2)) AS momo_sales, CAST(card_sales AS DECIMAL(18,2)) AS card_sales, expected_cash,
       CAST(end_cash - expected_cash AS DECIMAL(18,2)) AS difference,
       CASE WHEN end_cash IS NULL THEN NULL WHEN end_cash - expected_cash = 0 THEN 'balanced'
            WHEN end_cash - expected_cash > 0 THEN 'over' ELSE 'short' END AS result
FROM x""")
def rpt02_shift_cashup(spark, d):
    r = Retail(spark, d)
    return H.shift_cashup(r.shifts(), r.event_sales())


@job("rpt43_active_shifts", """
SELECT s.id, s.user_id, s.start_time, u.name, u.store_location
FROM shifts s LEFT JOIN users u ON u.id = s.user_id WHERE s.end_time IS NULL""")
def rpt43_active_shifts(spark, d):
    r = Retail(spark, d)
    return H.active_shifts(r.shifts(), r.users())


@job("rpt05_sales_in_open_shift", """
SELECT e.id, e.user_id, e.created_at, e.total_amount
FROM event_sales e LEFT JOIN (SELECT user_id, MAX(start_time) AS open_start FROM shifts WHERE end_time IS NULL
                              GROUP BY user_id) o ON o.user_id = e.user_id
WHERE o.open_start IS NULL OR e.created_at >= o.open_start""")
def rpt05_sales_in_open_shift(spark, d):
    r = Retail(spark, d)
    return H.sales_in_open_shift(r.event_sales(), r.shifts())


# -- credit ----------------------------------------------------------------------
def _ledger(r: Retail):
    return C.build_ledger(r.sale_headers(), r.payments())


@job("set02_ledger", "SELECT * FROM ledger")
def set02_ledger(spark, d):
    return _ledger(Retail(spark, d))


@job("win01_running_balance", """
SELECT customer_id, date, description, type, debit, credit, transaction_id, ref_id,
       CAST(SUM(debit - credit) OVER (PARTITION BY customer_id ORDER BY date, type, ref_id
                                      ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
FROM ledger""")
def win01_running_balance(spark, d):
    return C.running_balance(_ledger(Retail(spark, d)))


@job("rpt18_monthly_statements", """
WITH g AS (SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month, SUM(debit) AS debits,
                  SUM(credit) AS credits FROM ledger GROUP BY 1, 2)
SELECT customer_id, month,
       CAST(COALESCE(SUM(debits - credits) OVER (PARTITION BY customer_id ORDER BY month
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS opening_balance,
       CAST(debits AS DECIMAL(18,2)) AS total_debit, CAST(credits AS DECIMAL(18,2)) AS total_credit,
       CAST(COALESCE(SUM(debits - credits) OVER (PARTITION BY customer_id ORDER BY month
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + debits - credits AS DECIMAL(18,2))
         AS closing_balance
FROM g""")
def rpt18_monthly_statements(spark, d):
    return C.monthly_statements(_ledger(Retail(spark, d)))


@job("chg18_missing_ledger_rows", """
WITH kept AS (SELECT * FROM ledger WHERE NOT (type = 'PAYMENT' AND ref_id % 3 = 0))
SELECT customer_id, CAST(created_at AS DATE) AS date, 'Sale - ' || receipt_number AS description, 'sale' AS type,
       CAST(total_amount AS DECIMAL(18,2)) AS debit, CAST(0 AS DECIMAL(18,2)) AS credit
FROM sales s WHERE status = 'completed' AND customer_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM kept l WHERE l.transaction_id = s.id)
UNION ALL
SELECT customer_id, CAST(payment_date AS DATE), 'Payment Received', 'payment', CAST(0 AS DECIMAL(18,2)),
       CAST(amount AS DECIMAL(18,2))
FROM payments p WHERE NOT EXISTS (
  SELECT 1 FROM kept l WHERE l.customer_id = p.customer_id AND CAST(l.date AS DATE) = CAST(p.payment_date AS DATE)
   AND l.description = 'Payment Received' AND l.credit = CAST(p.amount AS DECIMAL(18,2)))""")
def chg18_missing_ledger_rows(spark, d):
    r = Retail(spark, d)
    kept = _ledger(r).filter("NOT (type = 'PAYMENT' AND ref_id % 3 = 0)")       # a ledger that lacks payments
    return C.missing_ledger_rows(kept, r.sale_headers(), r.payments())


@job("win11_credit_decisions", """
WITH RECURSIVE ev AS (
  SELECT s.customer_id, s.id AS sale_id, CASE WHEN s.is_return THEN -s.total_amount ELSE s.total_amount END AS amount,
         s.is_return, c.current_balance AS start, c.credit_limit AS lim,
         ROW_NUMBER() OVER (PARTITION BY s.customer_id ORDER BY s.created_at, s.id) AS rn
  FROM sales s JOIN customers c ON c.id = s.customer_id
  WHERE s.status = 'completed' AND s.customer_id IS NOT NULL AND s.payment_method = 'credit'),
f AS (
  SELECT customer_id, rn, sale_id, is_return OR start + amount <= COALESCE(lim, 0) AS accepted,
         CAST(CASE WHEN is_return OR start + amount <= COALESCE(lim, 0) THEN start + amount ELSE start END AS DECIMAL(18,2)) AS bal
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.customer_id, e.rn, e.sale_id, e.is_return OR f.bal + e.amount <= COALESCE(e.lim, 0),
         CAST(CASE WHEN e.is_return OR f.bal + e.amount <= COALESCE(e.lim, 0) THEN f.bal + e.amount ELSE f.bal END AS DECIMAL(18,2))
  FROM f JOIN ev e ON e.customer_id = f.customer_id AND e.rn = f.rn + 1)
SELECT customer_id, sale_id, accepted, bal AS balance_after FROM f""")
def win11_credit_decisions(spark, d):
    r = Retail(spark, d)
    return C.credit_decisions(r.sale_headers(), r.customers())


@job("rpt11_approvals_queue", """
SELECT c.id, c.name, c.credit_limit, c.pending_credit_limit, c.status, u.name AS requested_by,
       CASE WHEN c.pending_credit_limit IS NOT NULL THEN 'Limit Increase' ELSE 'New Account' END AS request_type
FROM customers c LEFT JOIN users u ON u.id = c.created_by
WHERE c.status = 'Pending' OR c.pending_credit_limit IS NOT NULL""")
def rpt11_approvals_queue(spark, d):
    r = Retail(spark, d)
    return C.approvals_queue(r.customers(), r.users())


@job("agg23_next_account", """
SELECT COALESCE(MAX(CAST(account_number AS BIGINT)), 0) + 1 AS next_account FROM customers
WHERE regexp_full_match(account_number, '[0-9]+')""")
def agg23_next_account(spark, d):
    return C.next_account_number(Retail(spark, d).customers())


@job("win08_renumber_accounts", """
WITH s AS (SELECT COALESCE(MAX(CAST(account_number AS BIGINT)), 0) + 1 AS next_account FROM customers
           WHERE regexp_full_match(account_number, '[0-9]+'))
SELECT c.id, c.account_number AS old_number,
       CAST(s.next_account + ROW_NUMBER() OVER (ORDER BY c.id) - 1 AS VARCHAR) AS new_number
FROM customers c, s WHERE NOT regexp_full_match(c.account_number, '[0-9]+')""")
def win08_renumber_accounts(spark, d):
    return C.renumber_accounts(Retail(spark, d).customers())
