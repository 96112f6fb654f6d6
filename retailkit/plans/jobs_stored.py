"""Registered jobs over stored tables with JSON text: the reader must give the rows of the flat path (same SQL twins).

The sales and products of the test data are written as the store keeps them, items, taxes and stock maps as JSON text,
every second row as a JSON string that holds the text, and read back with ``read_tables``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailkit.catalog import REGISTRY, STOCK_KEYS, Retail, job
from retailkit.plans import sales as S
from retailkit.plans import stock as K
from retailkit.plans import jobs_reports, jobs_stock  # noqa: F401  (their SQL twins are used here)
from retailkit.sources import tables as T
from retailkit.streaming.jobs import run_dir


def _stored(c: str) -> Column:
    text = F.to_json(c)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.col("id") % 2 == 0, quoted).otherwise(text)


def _write_and_read(spark, d, *names):
    r, folder = Retail(spark, d), run_dir(spark, "stored")
    if "transactions" in names:
        s = r.sales().withColumns({"items": _stored("items"), "tax_breakdown": _stored("tax_breakdown")})
        s.drop("promo_code").write.parquet(f"{folder}/transactions")
    if "products" in names:
        r.products().withColumn("stock_levels", _stored("stock_levels")).write.parquet(f"{folder}/products")
    return T.read_tables(spark, folder)


def src03_dashboard_json(spark, d):
    return S.dashboard_daily(_write_and_read(spark, d, "transactions")["transactions"])


def src03_asset_value_json(spark, d):
    return K.asset_value(_write_and_read(spark, d, "products")["products"], STOCK_KEYS)


for _name, _twin, _fn in (("src03_dashboard_json", "agg02_dashboard_in_row", src03_dashboard_json), ("src03_asset_value_json", "agg16_asset_value", src03_asset_value_json)):
    if _name not in REGISTRY:
        REGISTRY[_name] = (_fn, REGISTRY[_twin][1])


@job("src03_items_json", """
SELECT id AS sale_id, pos, item_id, barcode, name, qty, price FROM sale_items""")
def src03_items_json(spark, d):
    t = T.sale_lines(_write_and_read(spark, d, "transactions")["transactions"])
    return t.select("sale_id", "pos", F.col("id").alias("item_id"), "barcode", "name", "qty", "price")


@job("src03_taxes_json", "SELECT sale_id, name, rate, amount FROM sale_taxes")
def src03_taxes_json(spark, d):
    return T.sale_taxes(_write_and_read(spark, d, "transactions")["transactions"]).select("sale_id", "name", "rate", "amount")
