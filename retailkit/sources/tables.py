"""Typed reader of stored retail tables (SRC-1, SRC-3): one Parquet, JSON or CSV table per name under a folder.

Nested columns are kept as JSON text in the store: an array or object, or (older rows) a JSON string that holds the
text of one.  ``read_tables`` decodes both to typed arrays and maps; text that is no JSON of the type gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the stored tables.
SCHEMAS = {
    "branches": "id BIGINT, name STRING, location STRING, created_at TIMESTAMP_NTZ",
    "system_settings": "id INT, branch_id INT, store_name STRING, currency_symbol STRING, vat_rate DECIMAL(5,2), "
                       "receipt_footer STRING, monthly_target DECIMAL(12,2), updated_at TIMESTAMP_NTZ",
    "users": "id BIGINT, username STRING, name STRING, email STRING, role STRING, phone STRING, employee_id STRING, "
             "status STRING, store_location STRING, store_id INT, created_at TIMESTAMP_NTZ",
    "products": "barcode STRING, id BIGINT, name STRING, category STRING, price DECIMAL(10,2), cost_price DECIMAL(10,2), "
                "stock INT, stock_levels STRING, selling_unit STRING, packaging_unit STRING, conversion_rate DECIMAL(10,2), "
                "reorder_level INT, track_batch BOOLEAN, track_expiry BOOLEAN, branch_id INT, created_at TIMESTAMP_NTZ, "
                "updated_at TIMESTAMP_NTZ",
    "product_batches": "id BIGINT, product_barcode STRING, batch_number STRING, expiry_date DATE, manufactured_date DATE, "
                       "quantity INT, quantity_received INT, quantity_available INT, quantity_sold INT, "
                       "cost_price DECIMAL(10,2), unit_cost DECIMAL(10,2), branch_id INT, status STRING, "
                       "created_at TIMESTAMP_NTZ",
    "customers": "id BIGINT, name STRING, phone STRING, email STRING, account_number STRING, credit_limit DECIMAL(10,2), "
                 "current_balance DECIMAL(10,2), pending_credit_limit DECIMAL(12,2), status STRING, created_by BIGINT, "
                 "created_at TIMESTAMP_NTZ",
    "transactions": "id BIGINT, user_id BIGINT, customer_id BIGINT, customer_name STRING, store_location STRING, "
                    "total_amount DECIMAL(12,2), original_total DECIMAL(12,2), current_total DECIMAL(12,2), "
                    "payment_method STRING, receipt_number STRING, items STRING, tax_breakdown STRING, status STRING, "
                    "is_return BOOLEAN, original_transaction_id BIGINT, return_items STRING, has_returns BOOLEAN, "
                    "created_at TIMESTAMP_NTZ",
    "customer_payments": "id BIGINT, customer_id BIGINT, amount DECIMAL(10,2), payment_date TIMESTAMP_NTZ, recorded_by BIGINT",
}
ITEMS = ("array<struct<id:bigint,barcode:string,name:string,qty:int,price:decimal(10,2),cost_price:decimal(10,2),"
         "discount:decimal(10,2)>>")
TAXES = "array<struct<name:string,rate:decimal(5,2),amount:decimal(12,2)>>"
NESTED = {"transactions": {"items": ITEMS, "return_items": ITEMS, "tax_breakdown": TAXES}, "products": {"stock_levels": "map<string,bigint>"}}


def decode_json(c: Column, kind: str) -> Column:
    """JSON text, or a JSON string that holds JSON text, as ``kind``."""
    inner = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v STRING")["v"]
    return F.from_json(F.when(F.startswith(F.ltrim(c), F.lit('"')), inner).otherwise(c), kind)


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One stored table with its nested columns decoded.  Parquet and JSON are read by name, columns they lack are NULL; CSV
    needs the columns in this order."""
    reader = spark.read.schema(SCHEMAS[name])
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    df = reader.format(fmt).load(f"{folder.rstrip('/')}/{name}")
    return df.withColumns({c: decode_json(F.col(c), kind) for c, kind in NESTED.get(name, {}).items()})


def read_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All stored tables by name (lazy: a table is listed when it is used)."""
    class Tables(dict):
        def __missing__(self, name):
            self[name] = read_table(spark, folder, name, fmt)
            return self[name]
    return Tables()


def sale_lines(transactions: DataFrame) -> DataFrame:
    """JN-8: flat item rows (sale_id, pos, id, barcode, name, qty, price, cost_price, discount) of decoded transactions."""
    return transactions.select(F.col("id").alias("sale_id"), F.posexplode("items").alias("pos", "i")).select("sale_id", "pos", "i.*")


def sale_taxes(transactions: DataFrame) -> DataFrame:
    """JN-9: (sale_id, name, rate, amount) of decoded transactions."""
    return transactions.select(F.col("id").alias("sale_id"), F.explode("tax_breakdown").alias("t")).select("sale_id", "t.*")
