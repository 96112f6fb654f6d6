"""Registered statement jobs (RPT-18, RPT-19, RPT-20) over all customers and months, with their SQL oracle twins."""

from __future__ import annotations

from retailkit.catalog import job, Retail, SALES_AS_OF
from retailkit.plans import credit as C
from retailkit.plans import statements as ST

MONTHS = "(SELECT CAST(unnest(generate_series(DATE '1980-01-01', DATE '2040-01-01', INTERVAL 1 MONTH)) AS DATE) AS month)"


def _ledger(r: Retail):
    return C.build_ledger(r.sale_headers(), r.payments())


def _lines_sql(before: str) -> str:
    return f"""
WITH m AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM ledger),
k AS (SELECT DISTINCT customer_id, month FROM m),
o AS (SELECT k.customer_id, k.month, COALESCE(SUM(l.debit - l.credit), 0) AS opening
      FROM k LEFT JOIN ledger l ON l.customer_id = k.customer_id AND {before} GROUP BY 1, 2)
SELECT m.customer_id, m.month, m.date, m.description, m.debit, m.credit, CAST(o.opening AS DECIMAL(18,2)) AS opening_balance,
       CAST(o.opening + SUM(m.debit - m.credit) OVER (PARTITION BY m.customer_id, m.month ORDER BY m.date, m.type, m.ref_id
            ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance,
       CAST(o.opening + SUM(m.debit - m.credit) OVER (PARTITION BY m.customer_id, m.month) AS DECIMAL(18,2)) AS closing_balance
FROM m JOIN o ON o.customer_id = m.customer_id AND o.month = m.month"""


@job("rpt18_statement_lines", _lines_sql("l.date < CAST(k.month AS TIMESTAMP)"))
def rpt18_statement_lines(spark, d):
    return ST.statement_lines(_ledger(Retail(spark, d)))


@job("rpt18_statement_lines_legacy", _lines_sql("l.date <= CAST(k.month AS TIMESTAMP) - INTERVAL 1 DAY"))
def rpt18_statement_lines_legacy(spark, d):
    return ST.statement_lines(_ledger(Retail(spark, d)), legacy_gap=True)


@job("rpt18_statement_calendar", f"""
WITH c AS (SELECT customer_id, CAST(date_trunc('month', MIN(date)) AS DATE) AS lo,
                  GREATEST(CAST(date_trunc('month', MAX(date)) AS DATE), CAST(date_trunc('month', DATE '{SALES_AS_OF}') AS DATE)) AS hi
           FROM ledger GROUP BY customer_id),
k AS (SELECT c.customer_id, x.month FROM c JOIN {MONTHS} x ON x.month BETWEEN c.lo AND c.hi),
t AS (SELECT k.customer_id, k.month, COUNT(l.customer_id) AS lines, COALESCE(SUM(l.debit), 0) AS debits, COALESCE(SUM(l.credit), 0) AS credits
      FROM k LEFT JOIN ledger l ON l.customer_id = k.customer_id AND l.date >= CAST(k.month AS TIMESTAMP)
       AND l.date < CAST(k.month AS TIMESTAMP) + INTERVAL 1 MONTH GROUP BY 1, 2),
b AS (SELECT *, COALESCE(SUM(debits - credits) OVER (PARTITION BY customer_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS opening FROM t)
SELECT customer_id, month, lines, CAST(opening AS DECIMAL(18,2)) AS opening_balance, CAST(debits AS DECIMAL(18,2)) AS total_debit,
       CAST(credits AS DECIMAL(18,2)) AS total_credit, CAST(opening + debits - credits AS DECIMAL(18,2)) AS closing_balance FROM b""")
def rpt18_statement_calendar(spark, d):
    return ST.statement_calendar(_ledger(Retail(spark, d)), SALES_AS_OF)


@job("rpt19_statement_source", f"""
WITH r AS (
  SELECT customer_id, created_at AS date, 'purchase' AS kind, receipt_number AS reference, CAST(total_amount AS DECIMAL(18,2)) AS amount
  FROM sales WHERE payment_method = 'credit' AND customer_id IS NOT NULL
  UNION ALL
  SELECT customer_id, payment_date, 'payment', CAST(id AS VARCHAR), CAST(-amount AS DECIMAL(18,2)) FROM payments)
SELECT r.*, x.month FROM r JOIN {MONTHS} x ON r.date >= CAST(x.month AS TIMESTAMP) AND r.date <= CAST(x.month AS TIMESTAMP) + INTERVAL 1 MONTH""")
def rpt19_statement_source(spark, d):
    r = Retail(spark, d)
    return ST.statement_source(r.sale_headers(), r.payments())


@job("rpt20_itemised_statement", f"""
WITH vat AS (SELECT COALESCE(MAX(vat_rate), CAST(15.00 AS DECIMAL(5,2))) AS vat FROM settings WHERE branch_id = 1),
p AS (SELECT l.*, x.month FROM ledger l JOIN {MONTHS} x ON l.date >= CAST(x.month AS TIMESTAMP)
       AND l.date <= CAST(x.month AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 SECOND),
k AS (SELECT DISTINCT customer_id, month FROM p),
o AS (SELECT k.customer_id, k.month, SUM(l.debit - l.credit) AS total FROM k JOIN ledger l ON l.customer_id = k.customer_id
       AND l.date < CAST(k.month AS TIMESTAMP) GROUP BY 1, 2),
rows AS (
  SELECT customer_id, month, CAST(NULL AS TIMESTAMP) AS date, '{ST.OPENING}' AS name, CAST(NULL AS BIGINT) AS qty, CAST(NULL AS DECIMAL(10,2)) AS price,
         CAST(NULL AS DECIMAL(24,6)) AS subtotal, CAST(NULL AS DECIMAL(24,6)) AS tax, CAST(total AS DECIMAL(24,6)) AS total FROM o WHERE ABS(total) > 0.01
  UNION ALL
  SELECT customer_id, month, date, '{ST.PAID}', NULL, NULL, NULL, NULL, -credit FROM p WHERE type = 'PAYMENT'
  UNION ALL
  SELECT p.customer_id, p.month, p.date, l.name, CAST(l.qty AS BIGINT), l.price, l.qty * l.price, l.qty * l.price * vat.vat * 0.01,
         l.qty * l.price + l.qty * l.price * vat.vat * 0.01
  FROM p JOIN sale_lines l ON l.sale_id = p.transaction_id CROSS JOIN vat WHERE p.type = 'SALE'
  UNION ALL
  SELECT customer_id, month, date, COALESCE(description, '{ST.BARE}'), NULL, NULL, NULL, NULL, debit
  FROM p WHERE type = 'SALE' AND NOT EXISTS (SELECT 1 FROM sale_lines l WHERE l.sale_id = p.transaction_id)),
every AS (SELECT * FROM rows UNION ALL
          SELECT customer_id, month, NULL, '{ST.CLOSING}', NULL, NULL, NULL, NULL, SUM(total) FROM rows GROUP BY customer_id, month)
SELECT customer_id, month, date, name, qty, price, CAST(ROUND(subtotal, 2) AS DECIMAL(18,2)) AS subtotal,
       CAST(ROUND(tax, 2) AS DECIMAL(18,2)) AS tax, CAST(ROUND(total, 2) AS DECIMAL(18,2)) AS total FROM every""")
def rpt20_itemised_statement(spark, d):
    r = Retail(spark, d)
    return ST.itemised_statement(_ledger(r), r.sale_items(), r.settings())
