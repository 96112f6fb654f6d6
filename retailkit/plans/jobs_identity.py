"""Registered bulk upload in the order of its rows (CHG-17, JN-23), with its SQL oracle twins.

The file is made from ``part``: rows that rename stored products, share new barcodes under different names, come without a barcode, repeat, or
have a stock that is no number.  It is written as CSV to the shared folder and read back as text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.plans import identity as ID
from retailkit.plans import ingest as I
from retailkit.streaming.jobs import run_dir

FILE_SQL = """RECURSIVE sheet AS (
  SELECT p_partkey AS line, CASE WHEN p_partkey % 11 = 0 THEN 'Shared ' || CAST(p_partkey % 7 AS VARCHAR) WHEN p_partkey % 5 = 0 THEN 'Fresh ' || CAST(p_partkey // 40 AS VARCHAR) ELSE p_name END AS name,
         CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 0 THEN 'C' ELSE p_type END AS category,
         CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 1 AND p_partkey % 5 = 0 THEN 'NB-' || CAST(p_partkey // 60 AS VARCHAR) ELSE '' END AS b,
         p_size AS stock, p_partkey % 29 <> 0 AS ok FROM part
  UNION ALL SELECT p_partkey + 10000000, 'SHARED ' || CAST(p_partkey % 7 AS VARCHAR), 'C', '', p_size, TRUE FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey + 20000000, p_name, p_type, 'NB-' || CAST(p_partkey // 60 AS VARCHAR), p_size, TRUE FROM part WHERE p_partkey % 9 = 0),
u AS (SELECT *, LOWER(name) || chr(31) || LOWER(category) AS k, ROW_NUMBER() OVER (ORDER BY line) AS rn,
             regexp_replace(upper(substr(name, 1, 3)), '[^A-Z]', 'X', 'g') || '-' || md5(LOWER(name) || chr(31) || LOWER(category)) AS made FROM sheet),
stored AS (SELECT LOWER(name) || chr(31) || LOWER(category) AS k, list(barcode) AS codes FROM products WHERE name IS NOT NULL AND category IS NOT NULL GROUP BY 1),
x AS (SELECT u.*, p.barcode IS NOT NULL AS known, COALESCE(s.codes, CAST([] AS VARCHAR[])) AS codes FROM u LEFT JOIN products p ON p.barcode = u.b LEFT JOIN stored s ON s.k = u.k),
f(rn, line, barcode, matched, held) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), MAP {}::MAP(VARCHAR, VARCHAR)
  UNION ALL
  SELECT rn, line, code, by_code OR len(found) > 0, CASE WHEN ok AND (by_code OR len(found) = 0) THEN map_concat(held, MAP {code: k}) ELSE held END
  FROM (SELECT *, CASE WHEN by_code THEN b WHEN len(found) > 0 THEN list_min(found) WHEN b <> '' THEN b ELSE made END AS code
        FROM (SELECT x.*, f.held, x.known OR (x.b <> '' AND map_contains(f.held, x.b)) AS by_code,
                     list_concat(list_filter(x.codes, lambda c: NOT map_contains(f.held, c)),
                                 list_transform(list_filter(map_entries(f.held), lambda e: e.value = x.k), lambda e: e.key)) AS found
              FROM f JOIN x ON x.rn = f.rn + 1))),
meant AS (SELECT f.line, f.barcode, f.matched, x.name, x.category, x.stock, x.ok FROM f JOIN x ON x.rn = f.rn)"""


def _file(r: Retail):
    p = r.raw("part")
    k = F.col("p_partkey")
    text = k.cast("string")
    new = F.concat(F.lit("NB-"), F.floor(k / 60).cast("string"))
    shared = (k % 7).cast("string")
    size = F.col("p_size").cast("string")

    def rows(keep, line, name, category, barcode, stock):
        return p.filter(keep).select((k + line).cast("string").alias("Line"), name.alias("Product Name"), category.alias("Category"), stock.alias("Current Stock"), barcode.alias("Barcode"))
    first = rows(F.lit(True), 0,
                 F.when(k % 11 == 0, F.concat(F.lit("Shared "), shared)).when(k % 5 == 0, F.concat(F.lit("Fresh "), F.floor(k / 40).cast("string"))).otherwise(F.col("p_name")),
                 F.when((k % 11 == 0) | (k % 5 == 0), "C").otherwise(F.col("p_type")),
                 F.when(k % 3 == 0, text).when((k % 3 == 1) & (k % 5 == 0), new).otherwise(""), F.when(k % 29 == 0, "many").otherwise(size))
    again = rows(k % 4 == 0, 10000000, F.concat(F.lit("SHARED "), shared), F.lit("C"), F.lit(""), size)
    return first.unionByName(again).unionByName(rows(k % 9 == 0, 20000000, F.col("p_name"), F.col("p_type"), new, size))


def _applied(spark, d) -> dict:
    r = Retail(spark, d)
    path = run_dir(spark, "upload") + "/ordered_csv"
    _file(r).write.mode("overwrite").option("header", True).csv(path)
    rows = I.parse_upload(I.read_upload(spark, path, order_col="Line"))
    return ID.apply_in_order(rows, r.products(), r.batches(), "B1", 1)


@job("chg17_ordered_rows", f"WITH {FILE_SQL} SELECT line, name, category, barcode, matched FROM meant")
def chg17_ordered_rows(spark, d):
    return _applied(spark, d)["rows"].select(F.col("_row").alias("line"), "name", "category", "barcode", "matched")


@job("chg17_ordered_products", f"""
WITH {FILE_SQL},
g AS (SELECT barcode, arg_max(name, line) AS name, arg_max(category, line) AS category, SUM(stock) AS added FROM meant WHERE ok GROUP BY barcode)
SELECT COALESCE(p.barcode, g.barcode) AS barcode, COALESCE(g.name, p.name) AS name, COALESCE(g.category, p.category) AS category,
       CAST(COALESCE(p.stock, 0) + COALESCE(g.added, 0) AS BIGINT) AS stock
FROM products p FULL OUTER JOIN g ON g.barcode = p.barcode""")
def chg17_ordered_products(spark, d):
    return _applied(spark, d)["products"].select("barcode", "name", "category", F.col("stock").cast("long").alias("stock"))


@job("chg17_ordered_errors", f"WITH {FILE_SQL} SELECT line, name, 'stock is no number' AS problem FROM sheet WHERE NOT ok")
def chg17_ordered_errors(spark, d):
    return _applied(spark, d)["errors"].select(F.col("_row").alias("line"), "name", "problem")


@job("chg17_ordered_categories", f"WITH {FILE_SQL} SELECT DISTINCT category FROM sheet")
def chg17_ordered_categories(spark, d):
    return _applied(spark, d)["categories"]
