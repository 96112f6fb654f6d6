"""Bulk product file (SRC-2, CHG-17, JN-23) as one set-based job.

The reference walks the uploaded sheet row by row (two lookups, an insert
or update and a batch insert per row).  Here the whole file is one
DataFrame:

1. ``read_upload``: CSV with header, every value kept as text, blanks as '',
   malformed lines kept in ``_bad`` (PERMISSIVE), plus the file row order;
2. ``parse_upload``: the header mapping is resolved once on the driver from
   the column names (FN-8); numbers, dates, units and the markup price are
   Column expressions (FN-7, FN-9, FN-10); rows without a name are skipped;
3. ``bulk_apply``: rows are matched to products by barcode, else by
   lower(name)+lower(category) (two-stage match, JN-23: a left join, then
   the unmatched remainder joined on the second key); rows of the same
   product are folded in file order (stock summed, last row's attributes
   win); new products get a deterministic barcode (prefix + MD5 of name and category, FN-11);
   batch rows are insert-if-new on (barcode, batch, branch); physical counts
   become count lines against the updated system stock.

``match_products`` groups unmatched rows as new products by their provided barcode, else by (lower(name), lower(category));
``identity.resolve_in_order`` resolves them as the row loop does, each row seeing what earlier rows made and renamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.functions.parse import clean_num, find_column, flexible_date, js_parse_int
from retailkit.operators.upsert import upsert

# Header fragments, in priority order (fixed values of the reference's column matcher).
PATTERNS = {
    "name": ["product name", "name"],
    "category": ["category", "type"],
    "cost": ["cost", "costprice"],
    "price": ["price", "sellingprice"],
    "markup": ["markup", "margin"],
    "stock": ["currentstock", "stock", "quantity"],
    "selling_unit": ["sellingunit", "unit"],
    "packaging_unit": ["packagingunit", "box", "pack"],
    "conversion_rate": ["itemsperpackage", "conversion", "perpackage"],
    "reorder_level": ["reorderlevel", "reorder", "threshold"],
    "batch_number": ["batchnumber", "batch", "lot"],
    "expiry_date": ["expirydate", "expiry", "expirationdate", "expires"],
    "barcode": ["barcode", "sku", "productcode"],
    "physical_count": ["physicalcount", "stocktake", "count", "physical"],
}


def read_upload(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    """Text-only CSV read.  Row order: ``order_col`` when the file carries a line number, else the
    file order (``monotonically_increasing_id``: partition index, then position)."""
    data_cols = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*data_cols, "_bad"]])
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
          .option("columnNameOfCorruptRecord", "_bad").csv(path))
    df = df.na.fill("", subset=data_cols)
    row = F.col(f"`{order_col}`").cast("long") if order_col else F.monotonically_increasing_id()
    return df.withColumn("_row", row)


def rejected_lines(raw: DataFrame) -> DataFrame:
    """(_row, line, fields) of lines whose fields don't fit the header, too many or too few, and what was read of them."""
    fields = [F.col(f"`{c}`") for c in raw.columns if c not in ("_bad", "_row")]
    return raw.filter(F.col("_bad").isNotNull()).select("_row", F.col("_bad").alias("line"), F.array(*fields).alias("fields"))


def column_mapping(columns: list[str]) -> dict[str, str | None]:
    cols = [c for c in columns if c not in ("_bad", "_row")]
    # (header names only: resolved once on the driver from the schema)
    return {field: find_column(cols, pats) for field, pats in PATTERNS.items()}


def parse_upload(raw: DataFrame) -> DataFrame:
    m = column_mapping(raw.columns)

    def txt(field):
        c = m[field]
        return F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c else F.lit("")

    cost, price, markup = clean_num(txt("cost")), clean_num(txt("price")), clean_num(txt("markup"))
    price = F.when((price == 0) & (cost > 0) & (markup > 0), cost * (1 + markup / 100)).otherwise(price)
    stock_read = js_parse_int(F.when(txt("stock") == "", "0").otherwise(txt("stock")))
    reorder_read = js_parse_int(F.when(txt("reorder_level") == "", "10").otherwise(txt("reorder_level")))
    stock, reorder = F.coalesce(stock_read, F.lit(0)), F.coalesce(reorder_read, F.lit(10))
    problem = F.when(stock_read.isNull(), "stock is no number").when(reorder_read.isNull(), "reorder level is no number")
    conv = clean_num(F.when(txt("conversion_rate") == "", "1").otherwise(txt("conversion_rate")))
    rows = raw.select(
        "_row", txt("name").alias("name"),
        F.when(txt("category") == "", "General").otherwise(txt("category")).alias("category"),
        F.round(cost, 2).alias("cost"), F.round(price, 2).alias("price"), stock.alias("stock"),
        F.when(txt("selling_unit") == "", "Unit").otherwise(txt("selling_unit")).alias("selling_unit"),
        F.when(txt("packaging_unit") == "", "Box").otherwise(txt("packaging_unit")).alias("packaging_unit"),
        conv.alias("conversion_rate"), reorder.alias("reorder_level"),
        txt("batch_number").alias("batch_number"), flexible_date(txt("expiry_date")).alias("expiry_date"),
        txt("barcode").alias("barcode_provided"),
        F.coalesce(js_parse_int(txt("physical_count")), F.lit(0)).alias("physical_count"),
        problem.alias("problem"))
    return rows.filter(F.col("name") != "")                    # rows without a name are skipped


def generated_barcode():
    """A new product's code: 128 bits of (name, category), so different products don't share one and equal ones are one product."""
    prefix = F.regexp_replace(F.upper(F.substring("name", 1, 3)), "[^A-Z]", "X")
    return F.concat_ws("-", prefix, F.md5(F.concat_ws("\x1f", F.lower("name"), F.lower("category"))))


def match_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """JN-23: barcode first, else lower(name)+lower(category); adds ``barcode`` and ``matched``."""
    p1 = products.select(F.col("barcode").alias("barcode_provided"), F.lit(True).alias("_m1"))
    s1 = rows.join(p1, "barcode_provided", "left")
    hit = s1.filter(F.col("_m1").isNotNull()).select(*rows.columns, F.col("barcode_provided").alias("barcode"))
    rest = s1.filter(F.col("_m1").isNull()).drop("_m1")
    by_name = products.groupBy(F.lower("name").alias("_ln"), F.lower("category").alias("_lc")).agg(
        F.min("barcode").alias("_b2"))                     # duplicates by name: lowest barcode (T7 deterministic)
    s2 = rest.join(by_name, (F.lower(rest["name"]) == F.col("_ln")) & (F.lower(rest["category"]) == F.col("_lc")),
                   "left")
    new_bc = F.when(F.col("barcode_provided") != "", F.col("barcode_provided")).otherwise(generated_barcode())
    s2 = s2.select(*rows.columns, F.coalesce(F.col("_b2"), new_bc).alias("barcode"),
                   F.col("_b2").isNotNull().alias("_m2"))
    return (hit.withColumn("matched", F.lit(True))
            .unionByName(s2.withColumn("matched", F.col("_m2")).drop("_m2")))


def bulk_apply(rows: DataFrame, products: DataFrame, batches: DataFrame, branch: str, branch_id: int, matched: DataFrame | None = None):
    """Returns (products_after, new_batches, count_lines, categories).

    ``matched``: all rows of the file with the products that they mean, of which those without a problem are applied; else ``match_products`` of ``rows``.
    """
    m = match_products(rows, products) if matched is None else matched.filter("problem IS NULL")
    counted = m if matched is None else matched
    w = Window.partitionBy("barcode").orderBy(F.col("_row").desc())
    last = m.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")   # last row's attributes
    sums = m.groupBy("barcode").agg(F.sum("stock").alias("added"))
    per = last.join(sums, "barcode")
    changes = per.select(
        "barcode", "name", "category", F.col("price").cast("decimal(10,2)").alias("price"),
        F.col("cost").cast("decimal(10,2)").alias("cost_price"), "added",
        F.col("conversion_rate").cast("decimal(10,2)").alias("conversion_rate"), "reorder_level")
    cur = products.select("barcode", "name", "category", "price", "cost_price", "stock", "stock_levels",
                          "conversion_rate", "reorder_level")
    j = cur.join(changes.withColumnRenamed("name", "_n").withColumnRenamed("category", "_c")
                 .withColumnRenamed("price", "_p").withColumnRenamed("cost_price", "_cp")
                 .withColumnRenamed("conversion_rate", "_cr").withColumnRenamed("reorder_level", "_rl"),
                 "barcode", "full_outer")
    has_c = F.col("added").isNotNull()
    delta = F.create_map(F.lit(branch), F.coalesce("added", F.lit(0)))
    after = j.select(
        "barcode",
        F.when(has_c, F.col("_n")).otherwise(F.col("name")).alias("name"),
        F.when(has_c, F.col("_c")).otherwise(F.col("category")).alias("category"),
        F.when(has_c, F.col("_p")).otherwise(F.col("price")).alias("price"),
        F.when(has_c, F.col("_cp")).otherwise(F.col("cost_price")).alias("cost_price"),
        (F.coalesce("stock", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("stock"),
        F.when(has_c, F.map_zip_with(F.coalesce("stock_levels", F.create_map().cast("map<string,int>")), delta,
                                     lambda k, a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long")))
         .otherwise(F.col("stock_levels").cast("map<string,bigint>")).alias("stock_levels"),
        F.when(has_c, F.col("_cr")).otherwise(F.col("conversion_rate")).alias("conversion_rate"),
        F.when(has_c, F.col("_rl")).otherwise(F.col("reorder_level")).alias("reorder_level"))
    nb = (m.filter(F.col("batch_number") != "")
          .groupBy("barcode", "batch_number").agg(F.min_by(F.struct("expiry_date", "stock"), "_row").alias("f"))
          .select(F.col("barcode").alias("product_barcode"), "batch_number", F.lit(branch_id).alias("branch_id"),
                  F.col("f.expiry_date").alias("expiry_date"), F.col("f.stock").alias("quantity")))
    existing = batches.select("product_barcode", "batch_number", "branch_id", "expiry_date", "quantity")
    new_batches = upsert(existing, nb, ["product_barcode", "batch_number", "branch_id"], "ignore") \
        .filter(F.col("_action") == "insert").drop("_action")
    counts = (counted.filter(F.col("physical_count") > 0)
              .join(after.select("barcode", F.col("stock").alias("system_count")), "barcode", "left")
              .select(F.col("barcode").alias("product_barcode"), "physical_count",
                      F.coalesce("system_count", F.lit(0)).alias("system_count"))
              .withColumn("variance", F.col("physical_count") - F.col("system_count")))
    categories = m.select("category").distinct()
    return after, new_batches, counts, categories
