"""The test-data mapping written once more, in plain SQL, for the oracle.

Every retail view of ``retailkit.sources.adapter`` has a SQL twin here,
runnable by DuckDB over the supplied tables.  ``with_views(sql)`` prefixes
a query with exactly the views it (transitively) names, so each oracle
query in ``retailkit.catalog`` is one self-contained statement.

Nested columns are given in flat form: ``sale_items`` holds one row per
line with the sale header, ``sale_taxes`` one row per tax entry,
``stock_levels`` one row per (barcode, branch) map entry.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["branches"] = """
SELECT CAST(n.n_nationkey AS BIGINT) AS id, n.n_name AS name, r.r_name AS location
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

VIEWS["users"] = """
SELECT CAST(i AS BIGINT) AS id, 'staff' || lpad(CAST(i AS VARCHAR), 2, '0') AS name,
       CASE WHEN i = 0 THEN 'admin' WHEN i = 1 THEN 'ceo' ELSE 'cashier' END AS role,
       CAST(i % 5 AS INTEGER) AS branch_id, 'NATION_' || CAST(i % 5 AS VARCHAR) AS store_location,
       CASE WHEN i = 19 THEN 'inactive' ELSE 'active' END AS status
FROM range(20) t(i)"""

VIEWS["tax_rules"] = """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'VAT', CAST(15.0 AS DECIMAL(5,2)), CAST(NULL AS INTEGER), 'Active'),
                      (2, 'LEVY', 2.5, 1, 'Active'),
                      (3, 'TOURISM', 1.0, NULL, 'Inactive')) t(id, name, rate, branch_id, status)"""

VIEWS["settings"] = """
SELECT * FROM (VALUES (1, CAST(12.5 AS DECIMAL(5,2)), CAST(500000 AS DECIMAL(12,2))),
                      (2, 15.0, 750000), (3, 17.5, NULL)) t(branch_id, vat_rate, monthly_target)"""

VIEWS["customers"] = """
SELECT c_custkey AS id, c_name AS name,
       CASE WHEN c_custkey % 10 = 0 THEN 'ACC-' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END
         AS account_number,
       CAST(CAST(GREATEST(c_acctbal, 0.0) AS DECIMAL(12,2)) * 100 AS DECIMAL(12,2)) AS credit_limit,
       CAST(ROUND(CAST(ABS(c_acctbal) AS DECIMAL(12,2)) * 0.1, 2) AS DECIMAL(12,2)) AS current_balance,
       CASE WHEN c_custkey % 9 = 0 THEN CAST(CAST(GREATEST(c_acctbal, 0.0) AS DECIMAL(12,2)) * 200 AS DECIMAL(12,2))
       END AS pending_credit_limit,
       CASE WHEN c_custkey % 7 = 0 THEN 'Pending' ELSE 'Active' END AS status,
       c_custkey % 20 AS created_by, c_nationkey AS branch_id
FROM customer"""

VIEWS["products"] = """
SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS barcode, p_name AS name, p_type AS category,
       p_brand AS brand, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice * 0.7 AS DECIMAL(10,2)) END AS cost_price,
       p_size - 5 AS stock, CAST(1 + p_size % 12 AS DECIMAL(10,2)) AS conversion_rate,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 10 END AS reorder_level,
       p_partkey % 3 <> 0 AS track_batch, p_partkey % 4 <> 0 AS track_expiry
FROM part"""

VIEWS["stock_levels"] = """
SELECT barcode, branch, qty FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS barcode, 'Main Warehouse' AS branch, p_size % 7 - 2 AS qty, p_partkey FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'B1', p_size % 5, p_partkey FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'B2', p_size % 3 - 1, p_partkey FROM part WHERE p_partkey % 2 = 0
) WHERE p_partkey % 19 <> 0"""

VIEWS["sales"] = """
SELECT o.o_orderkey AS id, o.o_orderkey % 20 AS user_id,
       CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
       CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE c.c_name END AS customer_name,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE n.n_name END AS store_location,
       CAST(o.o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'cash' WHEN '2-HIGH' THEN 'momo' WHEN '3-MEDIUM' THEN 'card'
            WHEN '4-NOT SPECIFIED' THEN 'credit' WHEN '5-LOW' THEN 'Mobile Money' END AS payment_method,
       CASE WHEN o.o_orderkey % 10 = 3 THEN 'REF-' ELSE 'RCP-' END || CAST(o.o_orderkey AS VARCHAR) AS receipt_number,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'Completed' WHEN 'P' THEN 'pending' END AS status,
       o.o_orderkey % 10 = 3 AS is_return,
       CASE WHEN o.o_orderkey % 10 = 3 THEN o.o_orderkey - 3 END AS original_transaction_id,
       o.o_orderdate + CAST(o.o_orderkey % 1440 AS INTEGER) * INTERVAL '1' MINUTE AS created_at,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'PROMO-' || CAST(o.o_custkey % 25 + 1 AS VARCHAR) END AS promo_code
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""

VIEWS["sale_lines"] = """
SELECT l.l_orderkey AS sale_id, l.l_linenumber AS line_no, p.id, p.barcode, p.name,
       CAST(l.l_quantity AS INTEGER) AS qty, p.price, p.cost_price,
       CAST(ROUND(CAST(l.l_quantity AS INTEGER) * p.price * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(10,2))
         AS discount,
       ROUND(CAST(l.l_quantity AS INTEGER) * p.price * CAST(l.l_tax AS DECIMAL(4,2)), 2) AS vat_part
FROM lineitem l JOIN products p ON l.l_partkey = p.id"""

VIEWS["sale_items"] = """
SELECT s.*, i.line_no, i.id AS item_id, i.barcode, i.name, i.qty, i.price, i.cost_price, i.discount,
       ROW_NUMBER() OVER (PARTITION BY i.sale_id ORDER BY i.line_no, i.id, i.qty, i.discount) - 1 AS pos
FROM sales s JOIN sale_lines i ON i.sale_id = s.id"""

VIEWS["sale_vat"] = """
SELECT s.id AS sale_id, CAST(COALESCE(SUM(i.vat_part), 0) AS DECIMAL(12,2)) AS vat
FROM sales s LEFT JOIN sale_lines i ON i.sale_id = s.id GROUP BY s.id"""

VIEWS["sale_taxes"] = """
SELECT sale_id, 'VAT' AS name, CAST(15.00 AS DECIMAL(5,2)) AS rate, vat AS amount FROM sale_vat
WHERE sale_id % 3 = 2 OR (sale_id % 3 = 1 AND sale_id % 5 <> 0)
UNION ALL
SELECT sale_id, 'LEVY', CAST(2.50 AS DECIMAL(5,2)), CAST(ROUND(vat * 0.5, 2) AS DECIMAL(12,2)) FROM sale_vat
WHERE (sale_id % 3 = 2 OR (sale_id % 3 = 1 AND sale_id % 5 <> 0)) AND sale_id % 2 = 0"""

VIEWS["refunds"] = """
SELECT id AS transaction_id, 'RCP-' || CAST(original_transaction_id AS VARCHAR) AS original_receipt_number,
       receipt_number AS refund_receipt_number, CAST(total_amount AS DECIMAL(10,2)) AS refund_amount,
       payment_method, user_id AS processed_by, created_at
FROM sales WHERE is_return"""

VIEWS["batches"] = """
SELECT CAST(l_partkey AS VARCHAR) AS product_barcode, CAST(l_orderkey AS VARCHAR) AS batch_number,
       CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(MAX(l_shipdate) AS DATE) END AS expiry_date,
       CAST(SUM(l_quantity) AS INTEGER) AS quantity,
       CAST(SUM(l_quantity) AS INTEGER) AS quantity_received,
       CAST(SUM(l_quantity) AS INTEGER) AS quantity_available,
       0 AS quantity_sold, CAST(l_suppkey AS INTEGER) AS branch_id, 'Active' AS status,
       MIN(l_shipdate) AS created_at
FROM lineitem GROUP BY l_partkey, l_orderkey, l_suppkey"""

VIEWS["count_lines"] = """
SELECT p_partkey % 10 AS stock_take_id, CAST(p_partkey AS VARCHAR) AS product_barcode,
       CAST(p_size - 5 + (p_partkey % 5 - 2) AS INTEGER) AS physical_count, p_size - 5 AS system_count,
       CAST(p_size - 5 + (p_partkey % 5 - 2) AS INTEGER) - (p_size - 5) AS variance
FROM part"""

VIEWS["transfers"] = """
SELECT l.l_orderkey AS transfer_id,
       CASE l.l_suppkey % 3 WHEN 0 THEN 'Main Warehouse' WHEN 1 THEN 'B1' ELSE 'B2' END AS from_location,
       nt.n_name AS to_location,
       CASE WHEN l.l_linestatus = 'O' THEN 'In Transit' ELSE 'Completed' END AS status,
       CAST(l.l_partkey AS VARCHAR) AS barcode, CAST(l.l_quantity AS INTEGER) AS qty,
       CAST(CAST(l.l_quantity AS INTEGER) - l.l_partkey % 3 AS INTEGER) AS received_qty, l.l_shipdate AS created_at
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation nt ON c.c_nationkey = nt.n_nationkey"""

VIEWS["purchase_order_lines"] = """
SELECT l_orderkey AS po_id, l_suppkey AS supplier_id, CAST(l_partkey AS VARCHAR) AS barcode,
       CAST(SUM(l_quantity) AS INTEGER) AS quantity, MIN(l_shipdate) AS order_date
FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey"""

VIEWS["company_users"] = """
SELECT s_suppkey AS id, s_name AS company_name FROM supplier"""

VIEWS["suppliers"] = """
SELECT s_suppkey AS id, s_name AS name, s_nationkey AS branch_id, CAST(s_acctbal AS DECIMAL(12,2)) AS balance
FROM supplier"""

VIEWS["promotions"] = """
SELECT 'PROMO-' || replace(p_brand, 'Brand#', '') AS code, CAST(MIN(p_size) AS DECIMAL(5,2)) AS discount_percentage,
       CASE WHEN COUNT(*) % 2 = 0 THEN NULL ELSE CAST(COUNT(*) % 5 AS INTEGER) END AS branch_id
FROM part GROUP BY p_brand"""

VIEWS["shifts"] = """
SELECT user_id * 100 + dayofmonth(day) AS id, user_id, start_time,
       CASE WHEN user_id % 5 = 0 AND day = DATE '2024-01-30' THEN NULL ELSE last_ts END AS end_time,
       CAST(100 + user_id % 50 AS DECIMAL(10,2)) AS start_cash,
       CASE WHEN user_id % 5 = 0 AND day = DATE '2024-01-30' THEN NULL
            ELSE CAST(100 + user_id % 50 + (user_id * 37) % 200 AS DECIMAL(10,2)) END AS end_cash,
       CASE WHEN user_id % 5 = 0 AND day = DATE '2024-01-30' THEN 'open' ELSE 'closed' END AS status
FROM (SELECT user_id, CAST(ts AS DATE) AS day, MIN(ts) AS start_time, MAX(ts) AS last_ts
      FROM events GROUP BY user_id, CAST(ts AS DATE))"""

VIEWS["event_sales"] = """
SELECT event_id AS id, user_id, ts AS created_at, CAST(value AS DECIMAL(10,2)) AS total_amount,
       CASE event_id % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'momo' WHEN 2 THEN 'card' ELSE 'Mobile Money' END
         AS payment_method
FROM events WHERE event_type = 'purchase'"""

VIEWS["payments"] = """
SELECT event_id AS id, user_id AS customer_id, CAST(value AS DECIMAL(10,2)) AS amount, ts - INTERVAL 8280 DAY AS payment_date
FROM events WHERE event_type = 'purchase'"""

VIEWS["expenses"] = """
SELECT 'Ops' AS category, CAST(value AS DECIMAL(10,2)) AS amount, CAST(ts AS DATE) AS expense_date,
       CAST(user_id % 25 AS INTEGER) AS branch_id
FROM events WHERE event_type = 'error'"""

VIEWS["activity_logs"] = """
SELECT event_id AS id, user_id, event_type AS action, props AS details, ts AS created_at FROM events"""

VIEWS["invoices"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'proforma' ELSE 'sales' END AS kind,
       CASE WHEN o_orderstatus = 'P' THEN 'PRO-' ELSE 'INV-' END || CAST(o_orderkey AS VARCHAR) AS invoice_number,
       o_custkey % 10 AS company_id, o_orderdate AS issue_date,
       CAST(o_orderdate AS DATE) + 30 AS due_date,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) - CAST(ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * 0.13, 2)
            AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS subtotal,
       CAST(0 AS DECIMAL(12,2)) AS discount_amount,
       CAST(ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * 0.13, 2) AS DECIMAL(12,2)) AS tax_amount,
       CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(12,2))
                 WHEN o_orderstatus = 'O' THEN ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * 0.5, 2)
                 ELSE 0 END AS DECIMAL(12,2)) AS paid_amount,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE WHEN o_orderstatus = 'F' THEN 'Paid' WHEN o_orderstatus = 'O' THEN 'Partially Paid' ELSE 'Draft' END
         AS status,
       o_custkey % 20 AS created_by
FROM orders"""

VIEWS["ledger"] = """
SELECT customer_id, created_at AS date, COALESCE(receipt_number, 'TRX') || ' (Sale)' AS description, 'SALE' AS type,
       CAST(total_amount AS DECIMAL(18,2)) AS debit, CAST(0 AS DECIMAL(18,2)) AS credit, id AS transaction_id,
       id AS ref_id
FROM sales WHERE status = 'completed' AND customer_id IS NOT NULL AND payment_method = 'credit'
UNION ALL
SELECT customer_id, payment_date, 'Payment Received', 'PAYMENT', CAST(0 AS DECIMAL(18,2)),
       CAST(amount AS DECIMAL(18,2)), NULL, id
FROM payments"""

VIEWS["shift_pairs"] = """
SELECT sh.id AS shift_id, e.id AS sale_id, e.user_id, e.created_at, e.total_amount, e.payment_method
FROM event_sales e JOIN shifts sh ON e.user_id = sh.user_id AND e.created_at >= sh.start_time
 AND (sh.end_time IS NULL OR e.created_at <= sh.end_time)"""

VIEWS["credit_decisions"] = """
SELECT c_custkey AS customer_id, TIMESTAMP '2024-01-10 00:00:00' + CAST(c_custkey AS INTEGER) * INTERVAL '1' MINUTE
         AS decided_at, CASE WHEN c_custkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision
FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 7 = 0
UNION ALL
SELECT c_custkey, TIMESTAMP '2024-01-05 00:00:00', CASE WHEN c_custkey % 2 = 0 THEN 'reject' ELSE 'approve' END
FROM customer WHERE (c_custkey % 9 = 0 OR c_custkey % 7 = 0) AND c_custkey % 4 = 0"""

VIEWS["invoice_payments"] = """
SELECT l.l_orderkey AS invoice_id, CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2)) * 0.1, 2) AS DECIMAL(12,2))
         AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O'"""

VIEWS["shift_events"] = """
SELECT user_id, start_time AS ts, 'open' AS kind FROM shifts
UNION ALL SELECT user_id, end_time, 'close' FROM shifts WHERE end_time IS NOT NULL"""

_NAME = re.compile(r"\b([a-z_]+)\b")


def _deps(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(_NAME.findall(sql)) if w in VIEWS]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    body = sql.strip()
    for d in _deps(body):
        visit(d)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
