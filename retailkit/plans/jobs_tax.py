"""Registered tax jobs with their SQL oracle twins."""

from __future__ import annotations

from retailkit.catalog import job, Retail
from retailkit.plans import tax as TX

PERIOD = dict(start="2000-01-01", end="2000-12-31")
S_PERIOD = """status = 'completed' AND created_at >= TIMESTAMP '2000-01-01 00:00:00'
  AND created_at <= CAST(DATE '2000-12-31' AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND"""
AMOUNTS = f"""s AS (SELECT COALESCE(store_location, 'Main Branch') AS branch, total_amount, id FROM sales
       WHERE {S_PERIOD}),
vat AS (SELECT COALESCE(MAX(CAST(vat_rate AS DOUBLE)), 15.0) AS vat FROM settings WHERE branch_id = 1),
legacy AS (SELECT branch, 'VAT' AS tax_name,
                  CAST(SUM(total_amount) AS DOUBLE) - CAST(SUM(total_amount) AS DOUBLE) / (1 + vat.vat / 100) AS amount
           FROM s, vat WHERE s.id % 3 = 0 GROUP BY branch, vat.vat),
stored AS (SELECT s.branch, t.name AS tax_name, CAST(SUM(t.amount) AS DOUBLE) AS amount
           FROM s JOIN sale_taxes t ON t.sale_id = s.id GROUP BY s.branch, t.name),
amounts AS (SELECT branch, tax_name, SUM(amount) AS amount
            FROM (SELECT * FROM legacy UNION ALL SELECT * FROM stored) GROUP BY branch, tax_name)"""


@job("rpt16_tax_report", f"""
WITH {AMOUNTS},
g AS (SELECT branch, SUM(total_amount) AS gross FROM s GROUP BY branch),
t AS (SELECT branch, SUM(amount) AS tax FROM amounts GROUP BY branch)
SELECT g.branch, CAST(g.gross AS DECIMAL(18,2)) AS gross_revenue, ROUND(COALESCE(t.tax, 0.0), 2) AS total_tax,
       ROUND(CAST(g.gross AS DOUBLE) - COALESCE(t.tax, 0.0), 2) AS net_revenue
FROM g LEFT JOIN t ON t.branch = g.branch""")
def rpt16_tax_report(spark, d):
    r = Retail(spark, d)
    return TX.tax_report(r.sales(since=PERIOD["start"], until=PERIOD["end"] + " 23:59:59"), r.settings(), **PERIOD)


@job("agg28_tax_by_rule", f"""
WITH {AMOUNTS},
rules AS (SELECT 'VAT' AS tax_name, vat AS rate FROM vat
          UNION SELECT name, CAST(rate AS DOUBLE) FROM tax_rules WHERE status = 'Active' AND branch_id IN (1, 1))
SELECT b.branch, r.tax_name, r.rate, ROUND(COALESCE(a.amount, 0.0), 2) AS amount
FROM (SELECT DISTINCT branch FROM amounts) b CROSS JOIN rules r
LEFT JOIN amounts a ON a.branch = b.branch AND a.tax_name = r.tax_name""")
def agg28_tax_by_rule(spark, d):
    r = Retail(spark, d)
    return TX.tax_by_rule(r.sales(since=PERIOD["start"], until=PERIOD["end"] + " 23:59:59"), r.settings(),
                          r.tax_rules(), **PERIOD)


@job("agg27_tax_rollup", f"""
WITH s AS (SELECT COALESCE(store_location, 'Main Branch') AS branch, total_amount, id FROM sales WHERE {S_PERIOD}),
tx AS (SELECT sale_id, SUM(amount) AS tx FROM sale_taxes GROUP BY sale_id)
SELECT CASE WHEN GROUPING(branch) = 1 THEN 'TOTAL' ELSE branch END AS branch,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS gross, CAST(SUM(COALESCE(tx.tx, 0)) AS DECIMAL(18,2)) AS stored_tax
FROM s LEFT JOIN tx ON tx.sale_id = s.id GROUP BY ROLLUP (branch)""")
def agg27_tax_rollup(spark, d):
    return TX.tax_rollup(Retail(spark, d).sales(since=PERIOD["start"], until=PERIOD["end"] + " 23:59:59"), **PERIOD)


@job("agg27_tax_totals", f"""
WITH {AMOUNTS},
rules AS (SELECT 'VAT' AS name UNION SELECT name FROM tax_rules WHERE status = 'Active' AND branch_id = 1),
g AS (SELECT branch, CAST(SUM(total_amount) AS DOUBLE) AS gross FROM s GROUP BY branch),
t AS (SELECT g.branch, g.gross, COALESCE((SELECT SUM(amount) FROM amounts a WHERE a.branch = g.branch), 0.0) AS tax FROM g),
l AS (SELECT branch, 'gross' AS line, NULL AS name, gross AS amount FROM t UNION ALL SELECT branch, 'net', NULL, gross - tax FROM t
      UNION ALL SELECT branch, 'tax', NULL, tax FROM t
      UNION ALL SELECT g.branch, 'rule', r.name, COALESCE(a.amount, 0.0) FROM g CROSS JOIN rules r LEFT JOIN amounts a ON a.branch = g.branch AND a.tax_name = r.name)
SELECT branch, line, name, ROUND(amount, 2) AS amount FROM l
UNION ALL SELECT 'TOTAL', line, name, ROUND(SUM(amount), 2) FROM l GROUP BY line, name""")
def agg27_tax_totals(spark, d):
    r = Retail(spark, d)
    return TX.tax_totals(r.sales(since=PERIOD["start"], until=PERIOD["end"] + " 23:59:59"), r.settings(), r.tax_rules(), **PERIOD)


@job("rpt14_transaction_tax", """
WITH one AS (SELECT MAX(CAST(vat_rate AS DOUBLE)) AS v FROM settings WHERE branch_id = 1),
tx AS (SELECT sale_id, SUM(CAST(amount AS DOUBLE)) AS t FROM sale_taxes GROUP BY sale_id),
r AS (SELECT s.id, s.total_amount, COALESCE(CAST(st.vat_rate AS DOUBLE), one.v, 15.0) AS vat
      FROM sales s CROSS JOIN one LEFT JOIN users u ON u.id = s.user_id
      LEFT JOIN settings st ON st.branch_id = COALESCE(u.branch_id, 1)),
x AS (SELECT r.*, CASE WHEN r.id % 3 = 0 THEN CAST(r.total_amount AS DOUBLE) - CAST(r.total_amount AS DOUBLE) / (1 + r.vat / 100)
                       ELSE COALESCE(tx.t, 0.0) END AS tax
      FROM r LEFT JOIN tx ON tx.sale_id = r.id)
SELECT id, total_amount, ROUND(tax, 2) AS total_tax, ROUND(CAST(total_amount AS DOUBLE) - tax, 2) AS subtotal,
       CASE WHEN id % 3 = 0 THEN 'VAT (' || CAST(vat AS VARCHAR) || '%)' ELSE 'stored' END AS source
FROM x""")
def rpt14_transaction_tax(spark, d):
    r = Retail(spark, d)
    return TX.transaction_tax(r.sales(), r.settings(), r.users())


@job("agg29_company_tax_report", """
WITH ct AS (SELECT company_id, total_amount AS amount, issue_date AS transaction_date, CASE WHEN id % 8 <> 0 THEN id END AS invoice_id
            FROM invoices WHERE kind = 'sales')
SELECT CAST(COALESCE(SUM(ct.amount), 0) AS DECIMAL(18,2)) AS gross_sales,
       CAST(COALESCE(SUM(COALESCE(si.tax_amount, 0)), 0) AS DECIMAL(18,2)) AS total_tax,
       CAST(COALESCE(SUM(ct.amount - COALESCE(si.tax_amount, 0)), 0) AS DECIMAL(18,2)) AS net_sales, COUNT(*) AS transactions
FROM ct LEFT JOIN invoices si ON si.id = ct.invoice_id
WHERE ct.company_id = (SELECT MIN(company_id) FROM ct) AND ct.transaction_date >= TIMESTAMP '2000-01-01 00:00:00'
  AND ct.transaction_date <= CAST(DATE '2000-12-31' AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND""")
def agg29_company_tax_report(spark, d):
    i = Retail(spark, d).invoices()
    ct = i.filter("kind = 'sales'").selectExpr("company_id", "total_amount AS amount", "issue_date AS transaction_date",
                                               "CASE WHEN id % 8 <> 0 THEN id END AS invoice_id")     # some without an invoice
    return TX.company_tax_report(ct, i, **PERIOD)


@job("rpt35_active_taxes", """
WITH b AS (SELECT CAST(id AS INTEGER) AS branch_id FROM branches),
rules AS (SELECT branch_id AS rb, name, CAST(rate AS DOUBLE) AS rate FROM tax_rules WHERE status = 'Active'),
own AS (SELECT b.branch_id, r.name, r.rate FROM b JOIN rules r ON r.rb = b.branch_id OR r.rb = 1),
vat AS (SELECT b.branch_id, 'VAT' AS name,
               CASE WHEN st.branch_id IS NOT NULL THEN CAST(st.vat_rate AS DOUBLE)
                    ELSE (SELECT MAX(CAST(vat_rate AS DOUBLE)) FROM settings WHERE branch_id = 1) END AS rate
        FROM b LEFT JOIN settings st ON st.branch_id = b.branch_id
        WHERE b.branch_id NOT IN (SELECT branch_id FROM own WHERE UPPER(name) = 'VAT'))
SELECT * FROM vat WHERE rate > 0 UNION ALL SELECT * FROM own""")
def rpt35_active_taxes(spark, d):
    r = Retail(spark, d)
    return TX.active_taxes(r.tax_rules(), r.branches(), r.settings())
