"""Registered bulk upload (CHG-17 / SRC-2): an upload file derived from ``part`` is written as CSV
to the shared checkpoint folder, read back as text and applied; the SQL twin computes the same
outcome directly from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.plans import ingest as I
from retailkit.streaming.jobs import run_dir

UPLOAD_SQL = """upload AS (
  SELECT p_partkey AS line, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' NEW' WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name,
         p_type AS category,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS cost,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 5 AS DOUBLE) AS price,
         p_size AS stock,
         CASE WHEN p_partkey % 3 = 0 THEN 'LOT-' || CAST(p_partkey AS VARCHAR) ELSE '' END AS batch_number,
         DATE '2025-01-01' + p_size AS expiry_date,
         CASE WHEN p_partkey % 22 = 0 THEN 'NB-' || CAST(p_partkey AS VARCHAR)
              WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS barcode_provided,
         CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE 0 END AS physical_count
  FROM part),
byname AS (SELECT LOWER(name) AS ln, LOWER(category) AS lc, MIN(barcode) AS b2 FROM products GROUP BY 1, 2),
matched AS (
  SELECT u.*, COALESCE(p.barcode, bn.b2, NULLIF(u.barcode_provided, ''),
                   regexp_replace(upper(substr(u.name, 1, 3)), '[^A-Z]', 'X', 'g') || '-' ||
                   md5(LOWER(u.name) || chr(31) || LOWER(u.category))) AS barcode
  FROM upload u LEFT JOIN products p ON p.barcode = u.barcode_provided
  LEFT JOIN byname bn ON p.barcode IS NULL AND bn.ln = LOWER(u.name) AND bn.lc = LOWER(u.category)),
last AS (SELECT barcode, arg_max(name, line) AS name, arg_max(category, line) AS category,
                arg_max(price, line) AS price, arg_max(cost, line) AS cost, SUM(stock) AS added
         FROM matched GROUP BY barcode),
after AS (
  SELECT l.barcode, l.name, l.category, CAST(ROUND(l.price, 2) AS DECIMAL(10,2)) AS price,
         CAST(ROUND(l.cost, 2) AS DECIMAL(10,2)) AS cost_price,
         CAST(COALESCE(p.stock, 0) + l.added AS BIGINT) AS stock,
         CAST(COALESCE((SELECT sl.qty FROM stock_levels sl WHERE sl.barcode = p.barcode AND sl.branch = 'B1'), 0)
              + l.added AS BIGINT) AS b1_stock
  FROM last l LEFT JOIN products p ON l.barcode = p.barcode)"""


def _upload_frame(r: Retail):
    p = r.raw("part")
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return p.select(
        k.cast("string").alias("Line"),
        F.when(k % 11 == 0, F.concat("p_name", F.lit(" NEW"))).when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("Product Name"),
        F.col("p_type").alias("Category"),
        F.concat(F.lit("GHS "), F.format_number(price, 2)).alias("Cost"),
        F.concat(F.lit("₵"), (price + 5).cast("string")).alias("Selling Price"),
        F.col("p_size").cast("string").alias("Current Stock"),
        F.when(k % 3 == 0, F.concat(F.lit("LOT-"), k.cast("string"))).otherwise(F.lit("")).alias("Batch Number"),
        F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), F.col("p_size")), "dd/MM/yyyy").alias("Expiry Date"),
        F.when(k % 22 == 0, F.concat(F.lit("NB-"), k.cast("string"))).when(k % 2 == 0, k.cast("string")).otherwise(F.lit("")).alias("Barcode"),
        F.when(k % 7 == 0, (F.col("p_size") + 1).cast("string")).otherwise(F.lit("")).alias("Physical Count"))


def _apply(spark, d):
    r = Retail(spark, d)
    path = run_dir(spark, "upload") + "/upload_csv"
    _upload_frame(r).write.mode("overwrite").option("header", True).csv(path)
    rows = I.parse_upload(I.read_upload(spark, path, order_col="Line"))
    products = r.products()
    after, new_batches, counts, _ = I.bulk_apply(rows, products, r.batches(), "B1", 1)
    touched = I.match_products(rows, products).select("barcode").distinct()
    return after, new_batches, counts, touched


@job("chg17_upload_products", f"WITH {UPLOAD_SQL} SELECT * FROM after")
def chg17_upload_products(spark, d):
    after, _, _, touched = _apply(spark, d)
    return after.join(touched, "barcode", "left_semi").select(
        "barcode", "name", "category", F.col("price").cast("decimal(10,2)").alias("price"),
        F.col("cost_price").cast("decimal(10,2)").alias("cost_price"), F.col("stock").cast("long").alias("stock"),
        F.coalesce(F.try_element_at("stock_levels", F.lit("B1")), F.lit(0)).cast("long").alias("b1_stock"))


@job("chg17_upload_batches", f"""
WITH {UPLOAD_SQL}
SELECT barcode AS product_barcode, batch_number, 1 AS branch_id, arg_min(expiry_date, line) AS expiry_date,
       arg_min(stock, line) AS quantity
FROM matched WHERE batch_number <> '' GROUP BY barcode, batch_number""")
def chg17_upload_batches(spark, d):
    _, new_batches, _, _ = _apply(spark, d)
    return new_batches.select("product_barcode", "batch_number", F.col("branch_id").cast("int").alias("branch_id"),
                              "expiry_date", F.col("quantity").cast("int").alias("quantity"))


@job("chg17_upload_counts", f"""
WITH {UPLOAD_SQL}
SELECT m.barcode AS product_barcode, m.physical_count, a.stock AS system_count, m.physical_count - a.stock AS variance
FROM matched m JOIN after a ON a.barcode = m.barcode WHERE m.physical_count > 0""")
def chg17_upload_counts(spark, d):
    _, _, counts, _ = _apply(spark, d)
    return counts.select("product_barcode", F.col("physical_count").cast("int").alias("physical_count"),
                         F.col("system_count").cast("long").alias("system_count"),
                         F.col("variance").cast("long").alias("variance"))
