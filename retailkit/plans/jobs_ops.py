"""Registered operations jobs with their SQL oracle twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail, SALES_AS_OF
from retailkit.plans import ops as O
from retailkit.plans import stock as K
from retailkit.plans.jobs_stock import DELTAS

AS_OF = SALES_AS_OF

LABEL_SQL = "array_to_string(list_transform(string_split(replace(a.action, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _j(k):
    return f"json_extract_string(a.details, '$.{k}')"


DETAILS_SQL = f"""CASE WHEN a.details IS NULL THEN ''
  WHEN {_j('total')} IS NOT NULL AND {_j('receiptNumber')} IS NOT NULL AND {_j('originalTransactionId')} IS NOT NULL
    THEN 'Return Receipt #' || {_j('receiptNumber')} || ', Total: -' || {_j('total')} || ', Items: ' || {_j('itemCount')}
         || ', Original Transaction: ' || {_j('originalTransactionId')}
  WHEN {_j('receiptNumber')} IS NOT NULL AND {_j('total')} IS NOT NULL AND {_j('originalTransactionId')} IS NULL
    THEN 'Receipt #' || {_j('receiptNumber')} || ', Total: ' || {_j('total')} || ', Items: ' || {_j('itemCount')}
  WHEN {_j('name')} IS NOT NULL AND {_j('barcode')} IS NOT NULL AND {_j('stock')} IS NOT NULL
    THEN 'Product: ' || {_j('name')} || ' (' || {_j('barcode')} || '), Stock Level: ' || {_j('stock')}
  WHEN {_j('name')} IS NOT NULL AND {_j('barcode')} IS NOT NULL
    THEN 'Product: ' || {_j('name')} || ' (' || {_j('barcode')} || ')'
  WHEN {_j('role')} IS NOT NULL AND {_j('email')} IS NOT NULL THEN 'Role: ' || {_j('role')}
  ELSE COALESCE(array_to_string(list_transform(json_keys(a.details),
         lambda k: upper(k[1]) || k[2:] || ': ' || json_extract_string(a.details, '$.' || k)), ', '), a.details) END"""

FEED = f"""
SELECT a.id, a.created_at, a.action, {LABEL_SQL} AS action_label, COALESCE(u.name, cu.company_name) AS user_name,
       CASE WHEN u.role IS NOT NULL THEN u.role WHEN cu.id IS NOT NULL THEN 'Company' ELSE 'System' END AS user_role,
       {DETAILS_SQL} AS details_text
FROM activity_logs a LEFT JOIN users u ON a.user_id = u.id LEFT JOIN company_users cu ON a.user_id = cu.id"""


@job("rpt33_activity_feed", FEED + " ORDER BY a.created_at DESC NULLS FIRST, a.id DESC LIMIT 200")
def rpt33_activity_feed(spark, d):
    r = Retail(spark, d)
    return O.activity_feed(r.activity_logs(), r.users(), r.company_users())


@job("rpt33_activity_all", FEED)
def rpt33_activity_all(spark, d):
    r = Retail(spark, d)
    return O.activity_feed(r.activity_logs(), r.users(), r.company_users(), k=None)


@job("win10_movement_deltas", f"""
WITH {DELTAS},
a AS (SELECT d.id AS reference_id, d.pos, d.barcode, CASE WHEN d.is_return THEN 'Return' ELSE 'Sale' END AS action_type,
             -d.delta + 0 AS neg, d.delta
      FROM deltas d JOIN products p ON p.barcode = d.barcode)
SELECT reference_id, pos, barcode, action_type, delta,
       CASE WHEN delta > 0 THEN 'Qty Added' WHEN delta < 0 THEN 'Qty Removed' ELSE 'Change' END AS change
FROM a""")
def win10_movement_deltas(spark, d):
    r = Retail(spark, d)
    p = r.products()
    return O.movement_deltas(K.audit_rows(K.sale_deltas(r.sale_items(), p), p))


@job("rpt34_branch_list", """
SELECT b.id, b.name, b.location, COALESCE(s.vat_rate, CAST(15.00 AS DECIMAL(5,2))) AS vat_rate, s.monthly_target
FROM branches b LEFT JOIN settings s ON CAST(s.branch_id AS BIGINT) = b.id""")
def rpt34_branch_list(spark, d):
    r = Retail(spark, d)
    return O.branch_list(r.branches(), r.settings())


RESOLVE = """best AS (SELECT input, arg_min(id, id) AS id, arg_min(name, id) AS name, arg_min(location, id) AS location
          FROM (SELECT i.input, b.id, b.name, b.location FROM i JOIN branches b
                ON i.input = b.name OR i.input = b.location) GROUP BY input)"""


@job("flt06_resolve_branch", f"""
WITH i AS (SELECT DISTINCT input FROM (SELECT store_location AS input FROM sales
                                       UNION ALL SELECT LOWER(store_location) FROM sales
                                       UNION ALL SELECT location FROM branches)),
{RESOLVE}
SELECT i.input, best.id AS branch_id, COALESCE(best.name, i.input) AS branch_name
FROM i LEFT JOIN best ON best.input = i.input""")
def flt06_resolve_branch(spark, d):
    r = Retail(spark, d)
    h = r.sale_headers()
    inputs = (h.select(F.col("store_location").alias("input"))
              .unionByName(h.select(F.lower("store_location").alias("input")))
              .unionByName(r.branches().select(F.col("location").alias("input"))))
    return O.resolve_branch(inputs, r.branches())


@job("flt20_receipt_lookup", """
WITH r AS (SELECT DISTINCT request FROM (
             SELECT original_receipt_number AS request FROM refunds
             UNION ALL SELECT CAST(transaction_id AS VARCHAR) FROM refunds
             UNION ALL SELECT 'INV-' || CAST(transaction_id - 3 AS VARCHAR) FROM refunds)),
f AS (SELECT r.request, s.id, s.total_amount FROM r LEFT JOIN sales s
      ON s.status = 'completed' AND ((regexp_full_match(r.request, '[0-9]+') AND CAST(s.id AS VARCHAR) = r.request)
      OR (NOT regexp_full_match(r.request, '[0-9]+') AND s.receipt_number = r.request))),
i AS (SELECT request, MIN(id) AS id, arg_min(total_amount, id) AS total_amount FROM (
        SELECT invoice_number AS request, id, total_amount FROM invoices
        UNION ALL SELECT CAST(id AS VARCHAR), id, total_amount FROM invoices) GROUP BY request)
SELECT f.request, CASE WHEN f.id IS NOT NULL THEN 'transaction' WHEN i.id IS NOT NULL THEN 'invoice' ELSE 'none' END
         AS source,
       COALESCE(f.id, i.id) AS found_id, CAST(COALESCE(f.total_amount, i.total_amount) AS DECIMAL(18,2)) AS total_amount
FROM f LEFT JOIN i ON i.request = f.request""")
def flt20_receipt_lookup(spark, d):
    r = Retail(spark, d)
    rf = r.refunds()
    req = (rf.select(F.col("original_receipt_number").alias("request"))
           .unionByName(rf.select(F.col("transaction_id").cast("string").alias("request")))
           .unionByName(rf.select(F.concat(F.lit("INV-"), (F.col("transaction_id") - 3).cast("string")).alias("request"))))
    return O.receipt_lookup(req, r.sale_headers(), r.invoices())


@job("rpt39_barcode_lookup", """
SELECT q.barcode, q.branch, CASE WHEN sl.barcode IS NOT NULL THEN sl.qty ELSE p.stock END AS stock,
       CASE WHEN sl.barcode IS NOT NULL THEN 'branch' ELSE 'total' END AS source
FROM (SELECT DISTINCT barcode, 'B2' AS branch FROM sale_lines) q JOIN products p ON p.barcode = q.barcode
LEFT JOIN stock_levels sl ON sl.barcode = q.barcode AND sl.branch = q.branch""")
def rpt39_barcode_lookup(spark, d):
    r = Retail(spark, d)
    req = r.sale_lines().select("barcode").distinct().withColumn("branch", F.lit("B2"))
    return O.barcode_lookup(req, r.products())


@job("set01_recent_invoices", """
SELECT * FROM (
  SELECT id, invoice_number, 'Proforma' AS type, total_amount, issue_date AS date FROM invoices WHERE kind = 'proforma'
  UNION ALL
  SELECT id, invoice_number, 'Sales Invoice', total_amount, issue_date FROM invoices WHERE kind = 'sales')
ORDER BY date DESC NULLS FIRST, id DESC LIMIT 10""")
def set01_recent_invoices(spark, d):
    return O.recent_invoices(Retail(spark, d).invoices())


@job("agg30_company_dashboard", """
WITH a AS (SELECT company_id, COUNT(*) FILTER (WHERE kind = 'proforma') AS proformas,
                  COUNT(*) FILTER (WHERE kind = 'sales') AS sales_invoices,
                  CAST(COALESCE(SUM(total_amount) FILTER (WHERE kind = 'sales'), 0) AS DECIMAL(18,2)) AS total_revenue,
                  CAST(COALESCE(SUM(total_amount - paid_amount) FILTER (WHERE kind = 'sales' AND status <> 'Paid'), 0)
                       AS DECIMAL(18,2)) AS outstanding,
                  COUNT(*) FILTER (WHERE kind = 'proforma' AND status ILIKE 'Draft') AS pending_payments
           FROM invoices GROUP BY company_id),
c AS (SELECT COALESCE(SUM(current_balance), 0) AS owed, COALESCE(SUM(credit_limit), 0) AS lim,
             COUNT(*) FILTER (WHERE current_balance > 0) AS active_debtors FROM customers)
SELECT a.*, CAST(c.owed AS DECIMAL(18,2)) AS total_credit_owed,
       ROUND(CASE WHEN c.lim > 0 THEN CAST(c.owed AS DOUBLE) * 100 / CAST(c.lim AS DOUBLE) ELSE 0.0 END, 1) AS credit_usage_pct,
       c.active_debtors
FROM a CROSS JOIN c""")
def agg30_company_dashboard(spark, d):
    r = Retail(spark, d)
    return O.company_dashboard(r.invoices(), r.customers())


@job("chg24_convert_proformas", f"""
SELECT id, invoice_number AS proforma_number, 'INV-' || CAST(id AS VARCHAR) AS invoice_number,
       DATE '{AS_OF}' AS issue_date, DATE '{AS_OF}' + 30 AS due_date, subtotal, tax_amount, total_amount,
       'Unpaid' AS status
FROM invoices WHERE kind = 'proforma' AND status = 'Draft'""")
def chg24_convert_proformas(spark, d):
    return O.convert_proformas(Retail(spark, d).invoices(), AS_OF)


@job("rpt38_invoice_documents", """
SELECT i.id, i.invoice_number, i.kind, COUNT(l.sale_id) AS n_lines,
       CAST(COALESCE(SUM(l.qty * l.price), 0) AS DECIMAL(18,2)) AS items_total
FROM invoices i LEFT JOIN sale_lines l ON l.sale_id = i.id GROUP BY i.id, i.invoice_number, i.kind""")
def rpt38_invoice_documents(spark, d):
    r = Retail(spark, d)
    return O.invoice_documents(r.invoices(), r.sale_lines())


USAGE = """given AS (SELECT sale_id, SUM(discount) AS discount FROM sale_lines GROUP BY sale_id),
ch AS (SELECT s.promo_code AS code, CAST(COALESCE(b.id, 1) AS INTEGER) AS branch_id,
              CASE WHEN s.is_return THEN -g.discount ELSE g.discount END AS change
       FROM sales s JOIN given g ON g.sale_id = s.id LEFT JOIN branches b ON b.name = s.store_location
       WHERE s.promo_code IS NOT NULL AND g.discount > 0),
usage AS (SELECT code, branch_id, CAST(SUM(change) AS DECIMAL(18,2)) AS total_discounted FROM ch GROUP BY 1, 2)"""


def _discount_changes(r):
    return O.discount_changes(r.sale_headers(), r.sale_lines(), r.branches())


@job("chg04_promo_usage", f"WITH {USAGE} SELECT * FROM usage")
def chg04_promo_usage(spark, d):
    return O.promo_usage(_discount_changes(Retail(spark, d)))


@job("chg04_promo_totals", f"""
WITH {USAGE}
SELECT p.code, p.discount_percentage, p.branch_id,
       CAST(COALESCE((SELECT SUM(change) FROM ch WHERE ch.code = p.code), 0) AS DECIMAL(18,2)) AS total_discounted
FROM promotions p""")
def chg04_promo_totals(spark, d):
    r = Retail(spark, d)
    return O.promo_totals(r.promotions(), _discount_changes(r))


@job("rpt31_promotions_branch", f"""
WITH {USAGE}
SELECT p.code, p.discount_percentage, p.branch_id, CAST(COALESCE(u.total_discounted, 0) AS DECIMAL(18,2)) AS total_discounted
FROM promotions p LEFT JOIN usage u ON u.code = p.code AND u.branch_id = 1
WHERE p.branch_id = 1 OR p.branch_id IS NULL""")
def rpt31_promotions_branch(spark, d):
    r = Retail(spark, d)
    return O.promotions_for_branch(r.promotions(), O.promo_usage(_discount_changes(r)), 1)


@job("rpt37_promo_validity", """
SELECT s.id, s.promo_code,
       COALESCE(p.code IS NOT NULL AND (p.branch_id IS NULL OR p.branch_id = CAST(b.id AS INTEGER)), FALSE) AS valid
FROM sales s LEFT JOIN branches b ON b.name = s.store_location LEFT JOIN promotions p ON p.code = s.promo_code
WHERE s.promo_code IS NOT NULL""")
def rpt37_promo_validity(spark, d):
    r = Retail(spark, d)
    return O.promo_validity(r.sale_headers(), r.promotions(), r.branches())


@job("agg33_users_per_branch", """
SELECT b.id, b.name, COUNT(u.id) AS active_users
FROM branches b LEFT JOIN users u ON u.store_location = b.name AND u.status = 'active' GROUP BY b.id, b.name""")
def agg33_users_per_branch(spark, d):
    r = Retail(spark, d)
    return O.users_per_branch(r.branches(), r.users())


@job("chg10_transfer_decisions", f"""
WITH i AS (SELECT DISTINCT from_location AS input FROM transfers),
{RESOLVE},
k AS (SELECT DISTINCT from_location, key FROM (
        SELECT i.input AS from_location, UNNEST([COALESCE(best.name, i.input), i.input, best.location]) AS key
        FROM i LEFT JOIN best ON best.input = i.input) WHERE key IS NOT NULL),
av AS (SELECT t.transfer_id, t.qty, p.barcode IS NOT NULL AS known,
              COALESCE((SELECT SUM(sl.qty) FROM k JOIN stock_levels sl ON sl.branch = k.key
                        WHERE k.from_location = t.from_location AND sl.barcode = t.barcode), 0) AS available
       FROM transfers t LEFT JOIN products p ON p.barcode = t.barcode)
SELECT transfer_id, bool_and(known AND available >= qty) AS dispatched, COUNT(*) AS n_items,
       COUNT(*) FILTER (WHERE NOT known OR available < qty) AS short_items
FROM av GROUP BY transfer_id""")
def chg10_transfer_decisions(spark, d):
    r = Retail(spark, d)
    return O.transfer_decisions(r.transfers(), r.products(), r.branches())


@job("chg11_transfer_receipts", """
SELECT barcode, to_location, CAST(SUM(qty) AS BIGINT) AS received FROM transfers WHERE status = 'In Transit'
GROUP BY barcode, to_location""")
def chg11_transfer_receipts(spark, d):
    return O.transfer_receipts(Retail(spark, d).transfers())


@job("win12_pos_stock_decisions", """
WITH RECURSIVE ev AS (
  SELECT i.id AS sale_id, i.pos, i.barcode, CAST(i.qty AS DECIMAL(18,2)) AS qty,
         CAST(GREATEST(COALESCE(p.stock, 0), 0) AS DECIMAL(18,2)) AS avail,
         ROW_NUMBER() OVER (PARTITION BY i.barcode ORDER BY i.created_at, i.id, i.pos, i.qty) AS rn
  FROM sale_items i JOIN products p ON p.barcode = i.barcode WHERE LOWER(i.status) = 'completed'),
f AS (
  SELECT barcode, rn, sale_id, pos, qty <= avail AS accepted,
         CAST(CASE WHEN qty <= avail THEN qty ELSE 0 END AS DECIMAL(18,2)) AS used
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.barcode, e.rn, e.sale_id, e.pos, f.used + e.qty <= e.avail,
         CAST(CASE WHEN f.used + e.qty <= e.avail THEN f.used + e.qty ELSE f.used END AS DECIMAL(18,2))
  FROM f JOIN ev e ON e.barcode = f.barcode AND e.rn = f.rn + 1)
SELECT sale_id, pos, barcode, accepted, used AS used_after FROM f""")
def win12_pos_stock_decisions(spark, d):
    r = Retail(spark, d)
    return O.pos_stock_decisions(r.sale_items(), r.products())


@job("rpt32_po_listing", """
SELECT h.po_id, h.supplier_id, s.name AS supplier_name, b.name AS branch_name, h.n_items, h.total_qty, h.order_date
FROM (SELECT po_id, supplier_id, COUNT(*) AS n_items, CAST(SUM(quantity) AS BIGINT) AS total_qty,
             MIN(order_date) AS order_date FROM purchase_order_lines GROUP BY po_id, supplier_id) h
LEFT JOIN suppliers s ON s.id = h.supplier_id LEFT JOIN branches b ON CAST(b.id AS INTEGER) = s.branch_id""")
def rpt32_po_listing(spark, d):
    r = Retail(spark, d)
    return O.po_listing(r.purchase_order_lines(), r.suppliers(), r.branches())


@job("chg08_po_batches", """
WITH j AS (SELECT l.po_id, l.supplier_id, l.barcode, l.quantity, CAST(l.order_date AS DATE) + 365 AS expiry_date,
                  concat_ws('-', upper(substring(s.name, 1, 3)), strftime(l.order_date, '%y%m%d'),
                            upper(substring(p.name, 1, 3)), strftime(CAST(l.order_date AS DATE) + 365, '%y%m%d')) AS code
           FROM purchase_order_lines l LEFT JOIN suppliers s ON s.id = l.supplier_id
           JOIN products p ON p.barcode = l.barcode),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY barcode, code ORDER BY expiry_date, po_id, supplier_id) AS n FROM j)
SELECT po_id, supplier_id, barcode, quantity, expiry_date,
       CASE WHEN n = 1 THEN code ELSE code || '-' || CAST(n AS VARCHAR) END AS batch_code
FROM n""")
def chg08_po_batches(spark, d):
    r = Retail(spark, d)
    return O.po_batches(r.purchase_order_lines(), r.suppliers(), r.products())


@job("chg09_goods_received", """
SELECT l.po_id, l.barcode, l.quantity AS packages,
       CAST(l.quantity * COALESCE(p.conversion_rate, 1.00) AS DECIMAL(18,2)) AS units,
       COALESCE(p.track_batch, FALSE) AS creates_batch
FROM purchase_order_lines l JOIN products p ON p.barcode = l.barcode""")
def chg09_goods_received(spark, d):
    r = Retail(spark, d)
    return O.goods_received(r.purchase_order_lines(), r.products())


@job("chg27_price_list", """
SELECT barcode, cost_price, CAST(10 + id % 4 * 5 AS DECIMAL(5,2)) AS markup_percentage,
       CAST(ROUND(COALESCE(cost_price, 0) * CAST(1 + (10 + id % 4 * 5) / 100.0 AS DECIMAL(8,4)), 2) AS DECIMAL(18,2)) AS selling_price
FROM products""")
def chg27_price_list(spark, d):
    p = Retail(spark, d).products()
    return O.price_list(p, p.selectExpr("barcode", "CAST(10 + id % 4 * 5 AS DECIMAL(5,2)) AS markup_percentage"))


@job("chg33_batch_upsert", """
WITH ch AS (SELECT barcode AS product_barcode, CASE WHEN po_id % 5 = 0 THEN 'N-' ELSE '' END || CAST(po_id AS VARCHAR) AS batch_number,
                   CAST(supplier_id AS INTEGER) AS branch_id, CAST(SUM(quantity) + 1 AS INTEGER) AS quantity
            FROM purchase_order_lines WHERE po_id % 3 <> 0 GROUP BY barcode, po_id, supplier_id)
SELECT COALESCE(t.product_barcode, ch.product_barcode) AS product_barcode, COALESCE(t.batch_number, ch.batch_number) AS batch_number,
       COALESCE(t.branch_id, ch.branch_id) AS branch_id, COALESCE(ch.quantity, t.quantity) AS quantity,
       COALESCE(ch.quantity, t.quantity_available) AS quantity_available,
       CASE WHEN t.product_barcode IS NULL THEN 'insert' WHEN ch.product_barcode IS NULL THEN 'keep' ELSE 'update' END AS action
FROM batches t FULL OUTER JOIN ch ON t.product_barcode = ch.product_barcode
 AND t.batch_number = ch.batch_number AND t.branch_id = ch.branch_id""")
def chg33_batch_upsert(spark, d):
    r = Retail(spark, d)
    number = F.concat(F.when(F.col("po_id") % 5 == 0, "N-").otherwise(""), F.col("po_id").cast("string"))
    po = r.purchase_order_lines().filter("po_id % 3 <> 0").groupBy("barcode", "po_id", "supplier_id").agg(F.sum("quantity").alias("q"))
    ch = po.select(F.col("barcode").alias("product_barcode"), number.alias("batch_number"), F.col("supplier_id").cast("int").alias("branch_id"),
                   (F.col("q") + 1).cast("int").alias("quantity"))
    return O.batch_upsert(r.batches(), ch)


@job("chg34_settings_upsert", """
WITH ch AS (SELECT CAST(id AS INTEGER) AS branch_id,
                   CASE WHEN id % 2 = 0 THEN CAST(15.00 AS DECIMAL(5,2)) END AS vat_rate,
                   CAST(NULL AS DECIMAL(12,2)) AS monthly_target FROM branches)
SELECT COALESCE(s.branch_id, ch.branch_id) AS branch_id, COALESCE(ch.vat_rate, s.vat_rate) AS vat_rate,
       COALESCE(ch.monthly_target, s.monthly_target) AS monthly_target
FROM settings s FULL OUTER JOIN ch ON s.branch_id = ch.branch_id""")
def chg34_settings_upsert(spark, d):
    r = Retail(spark, d)
    return O.settings_upsert(r.settings(), r.branches())


@job("src05_export_rows", """
WITH g AS (SELECT 'OU' || CAST(b.id AS VARCHAR) AS orgUnit, strftime(s.created_at, '%Y%m') AS period,
                  CAST(CAST(SUM(s.total_amount) AS DECIMAL(18,2)) AS VARCHAR) AS revenue,
                  CAST(COUNT(*) AS VARCHAR) AS transactions
           FROM sales s JOIN branches b ON b.name = s.store_location WHERE LOWER(s.status) = 'completed'
           GROUP BY 1, 2)
SELECT 'DE_REVENUE' AS dataElement, period, orgUnit, revenue AS value FROM g
UNION ALL SELECT 'DE_TXN_COUNT', period, orgUnit, transactions FROM g""")
def src05_export_rows(spark, d):
    r = Retail(spark, d)
    return O.export_rows(r.sale_headers(), r.branches())


@job("chg10_transfer_fold", """
WITH RECURSIVE i AS (SELECT DISTINCT from_location AS input FROM transfers),
best AS (SELECT input, arg_min(name, id) AS name, arg_min(location, id) AS location
         FROM (SELECT i.input, b.id, b.name, b.location FROM i JOIN branches b
               ON i.input = b.name OR i.input = b.location) GROUP BY input),
k AS (SELECT DISTINCT from_location, key FROM (
        SELECT i.input AS from_location, UNNEST([COALESCE(best.name, i.input), i.input, best.location]) AS key
        FROM i LEFT JOIN best ON best.input = i.input) WHERE key IS NOT NULL),
t AS (
  SELECT tr.from_location, tr.transfer_id, tr.barcode, tr.qty, tr.created_at,
         CASE WHEN p.barcode IS NULL THEN NULL
              ELSE COALESCE((SELECT SUM(sl.qty) FROM k JOIN stock_levels sl ON sl.branch = k.key
                             WHERE k.from_location = tr.from_location AND sl.barcode = tr.barcode), 0) END AS available
  FROM transfers tr LEFT JOIN products p ON p.barcode = tr.barcode),
b AS (SELECT from_location, transfer_id, MIN(created_at) AS t_time, CAST(SUM(n) AS BIGINT) AS lines,
             list({'item': barcode, 'q': q, 'av': av}) AS need
      FROM (SELECT from_location, transfer_id, barcode, MIN(created_at) AS created_at, CAST(SUM(qty) AS BIGINT) AS q, COUNT(*) AS n,
                   CAST(MAX(available) AS BIGINT) AS av FROM t GROUP BY 1, 2, 3)
      GROUP BY 1, 2),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_location ORDER BY t_time, transfer_id) AS rn FROM b),
f(from_location, rn, transfer_id, accepted, lines, used) AS (
  SELECT from_location, 0, NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT, MAP {}::MAP(VARCHAR, BIGINT)
  FROM (SELECT DISTINCT from_location FROM o)
  UNION ALL
  SELECT o.from_location, o.rn, o.transfer_id,
         list_bool_and(list_transform(o.need, lambda x: COALESCE(f.used[x.item], 0) + x.q <= COALESCE(x.av, 0))),
         o.lines,
         CASE WHEN list_bool_and(list_transform(o.need, lambda x: COALESCE(f.used[x.item], 0) + x.q <= COALESCE(x.av, 0)))
              THEN map_concat(f.used, map_from_entries(list_transform(o.need,
                     lambda x: {'k': x.item, 'v': COALESCE(f.used[x.item], 0) + x.q})))
              ELSE f.used END
  FROM f JOIN o ON o.from_location = f.from_location AND o.rn = f.rn + 1)
SELECT from_location, transfer_id, accepted, lines FROM f WHERE rn > 0""")
def chg10_transfer_fold(spark, d):
    r = Retail(spark, d)
    return O.transfer_fold(r.transfers(), r.products(), r.branches())
