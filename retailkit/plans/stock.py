"""Stock reads and stock-changing jobs: inventory list, low stock, expiry,
FEFO allocation, audit before/after, stock posting and map maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailkit.functions import exprs as X
from retailkit.operators.fefo import fefo_many, fefo_single, return_restock
from retailkit.operators.running import day_bucket, running_sum
from retailkit.operators.topk import first_per_group
from retailkit.operators.upsert import upsert
from retailkit.plans.sales import items_of


def batch_stats(batches: DataFrame) -> DataFrame:
    """JN-19: correlated COUNT / MIN per product as one pre-aggregate."""
    return (batches.filter(F.col("status") == "Active").groupBy("product_barcode")
            .agg(F.count(F.lit(1)).alias("batch_count"), F.min("expiry_date").alias("next_expiry")))


def inventory_list(products: DataFrame, batches: DataFrame, branch_keys) -> DataFrame:
    """RPT-21: total from the map, branch stock by alias list (0 treated as missing, T12), batch stats."""
    st = batch_stats(batches).withColumnRenamed("product_barcode", "barcode")
    p = products.select("id", "barcode", "name", "stock", "stock_levels")
    j = p.join(st, "barcode", "left")
    return j.select("id", "barcode", "name", "stock",
                    X.map_total("stock_levels").alias("calculated_total"),
                    X.map_lookup_alias("stock_levels", branch_keys, zero_is_missing=True).alias("branch_stock"),
                    F.coalesce("batch_count", F.lit(0)).alias("batch_count"), "next_expiry")


def negative_items(products: DataFrame, branch_keys=None, debt_per_unit: int = 10) -> DataFrame:
    """RPT-25: stock below zero (global stock, or branch stock by alias list with a NULL test)."""
    check = (X.map_lookup_alias("stock_levels", branch_keys, zero_is_missing=False)
             if branch_keys else F.coalesce("stock", F.lit(0)))
    p = products.select("id", "name", "barcode", "category", check.alias("stock"))
    p = p.filter(F.col("stock") < 0)
    return p.select("id", "name", "barcode", "category", "stock", F.abs("stock").alias("units_owed"),
                    (F.abs("stock") * debt_per_unit).alias("debt_value"))


def negative_summary(items: DataFrame) -> DataFrame:
    """AGG-31."""
    return items.agg(F.count(F.lit(1)).alias("negative_items"),
                     F.coalesce(F.sum("units_owed"), F.lit(0)).cast("long").alias("total_units_owed"),
                     F.coalesce(F.sum("debt_value"), F.lit(0)).cast("long").alias("total_debt_value"))


def low_stock_report(products: DataFrame) -> DataFrame:
    """RPT-22: strict test without default (NULL level drops), shortage and percent (T18)."""
    p = products.filter(X.low_stock_lt(default_level=False))
    pct = F.round(F.col("stock").cast("double") / F.nullif(F.col("reorder_level"), F.lit(0)).cast("double") * 100, 2)
    return p.select("barcode", "name", "category", "stock", "reorder_level",
                    (F.col("reorder_level") - F.col("stock")).alias("shortage"), pct.alias("stock_percentage"))


def stock_summary(products: DataFrame) -> DataFrame:
    """AGG-15 (the branch argument is ignored, as in the reference)."""
    return products.agg(
        F.count(F.lit(1)).alias("total_products"), F.sum("stock").cast("long").alias("total_units"),
        X.money_sum(F.col("stock") * F.col("cost_price")).alias("total_cost_value"),
        X.money_sum(F.col("stock") * F.col("price")).alias("total_retail_value"),
        F.count(F.when(F.col("stock") == 0, 1)).alias("out_of_stock_count"),
        F.count(F.when(F.col("stock") <= F.col("reorder_level"), 1)).alias("low_stock_count"))


def asset_value(products: DataFrame, branch_keys) -> DataFrame:
    """AGG-16: Σ qty x cost per map key, plus the global Σ stock x cost."""
    keys = F.array(*[F.lit(k) for k in branch_keys])
    per = (products.select("stock_levels", "cost_price", F.explode(keys).alias("branch"))
           .groupBy("branch").agg(X.money_sum(X.map_get0("stock_levels", F.col("branch")) * F.col("cost_price"),
                                              zero=True).alias("asset_value")))
    tot = products.agg(X.money_sum(F.col("stock") * F.col("cost_price"), zero=True).alias("asset_value")) \
                  .select(F.lit("All Branches").alias("branch"), "asset_value")
    return per.unionByName(tot)


def expiry_report(batches: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """RPT-23 for all branches at once: JN-3 inner join on barcode, FN-14/15."""
    b = batches.filter(F.col("status") == "Active")
    j = b.join(products.select(F.col("barcode").alias("product_barcode"), "name"), "product_barcode", "inner")
    return j.select("product_barcode", "batch_number", "branch_id", "expiry_date", "name",
                    X.days_to("expiry_date", as_of).alias("days_to_expiry"),
                    X.expiry_status("expiry_date", as_of).alias("status"))


def expiring_batches(batches: DataFrame, products: DataFrame, as_of, days: int) -> DataFrame:
    """FLT-16: expiry BETWEEN as_of AND as_of + days."""
    d = X.lit_date(as_of)
    b = batches.filter((F.col("status") == "Active") & F.col("expiry_date").between(d, F.date_add(d, days)))
    j = b.join(products.select(F.col("barcode").alias("product_barcode"), "name"), "product_barcode", "inner")
    return j.select("product_barcode", "batch_number", "branch_id", "expiry_date", "name",
                    X.days_to("expiry_date", as_of).alias("days_to_expiry"))


def next_batch(batches: DataFrame) -> DataFrame:
    """WIN-5: next batch to sell per product (expiry NULLS LAST, then created)."""
    b = batches.filter((F.col("status") == "Active") & (F.col("quantity_available") > 0))
    order = F.struct(F.col("expiry_date").isNull(), "expiry_date", "created_at", "batch_number", "branch_id")
    return first_per_group(b, ["product_barcode"], order, ["batch_number", "branch_id", "expiry_date"])


def latest_batch(batches: DataFrame) -> DataFrame:
    """WIN-7: newest batch per product."""
    g = batches.groupBy("product_barcode").agg(F.max_by(F.struct("batch_number", "branch_id", "created_at"),
                                                        F.struct("created_at", "batch_number", "branch_id")).alias("b"))
    return g.select("product_barcode", "b.batch_number", "b.branch_id", "b.created_at")


def reorder_suggestions(products: DataFrame) -> DataFrame:
    """RPT-24 (global form): stock < COALESCE(level, 10)."""
    return products.filter(X.low_stock_lt(default_level=True)).select(
        "id", "barcode", "name", "stock", "reorder_level")


def reorder_alerts(products: DataFrame) -> DataFrame:
    """CHG-16: products at or under their level (a product without a level never alerts); suggested order = 2 x level."""
    p = products.filter(F.col("stock") <= F.col("reorder_level"))
    pr = F.when(F.col("stock") == 0, "Critical").when(F.col("stock") <= F.col("reorder_level"), "High").otherwise("Normal")
    return p.select("barcode", "name", F.col("stock").alias("current_stock"), "reorder_level",
                    (F.col("reorder_level") * 2).alias("suggested_quantity"), pr.alias("priority"))


def upsert_alerts(alerts: DataFrame, found: DataFrame) -> DataFrame:
    """The alert table after a check: known products get stock and priority, new ones a whole row, others stay."""
    return upsert(alerts, found, ["barcode"], "partial", set_cols=("current_stock", "priority"))


def alert_list(alerts: DataFrame, products: DataFrame) -> DataFrame:
    """TOP-7: active alerts with their product, worst first: the rank orders by priority, then stock."""
    rank = F.when(F.col("priority") == "Critical", 1).when(F.col("priority") == "High", 2).otherwise(3)
    j = alerts.drop("name").join(products.select("barcode", "name", "price"), "barcode")
    return j.select("barcode", "name", "price", "current_stock", "priority", rank.alias("priority_rank")).orderBy("priority_rank", "current_stock", "barcode")


def duplicates(products: DataFrame, keys=("barcode", "name")) -> DataFrame:
    """AGG-22: GROUP BY key HAVING count > 1."""
    return products.groupBy(*keys).count().filter(F.col("count") > 1)


def resync_map(products: DataFrame, default_key: str = "Main Warehouse") -> DataFrame:
    """CHG-19: NULL or empty map -> {default_key: stock}; stock = Σ map.  Flattened entries."""
    m = F.when(F.col("stock_levels").isNull() | (F.size("stock_levels") == 0), F.create_map(F.lit(default_key), F.col("stock"))) \
         .otherwise(F.col("stock_levels"))
    p = products.select("barcode", m.alias("m"))
    p = p.withColumn("new_stock", X.map_total("m"))
    return p.select("barcode", "new_stock", F.explode("m").alias("branch", "qty"))


def clean_negative(products: DataFrame) -> DataFrame:
    """CHG-20: products with a negative entry (FLT-17): clamp entries to 0 and recompute totals."""
    p = products.filter(X.map_has_negative("stock_levels"))
    p = p.select("barcode", X.map_clamp_negative("stock_levels").alias("m"))
    p = p.withColumn("new_stock", X.map_total("m"))
    return p.select("barcode", "new_stock", F.explode("m").alias("branch", "qty"))


# -- posting of sales (CHG-1..5) -------------------------------------------------
def stock_key(sales: DataFrame, branches: DataFrame | None) -> DataFrame:
    """Adds ``branch``, the key of the stock map that a sale posts to: the branch whose name or location the sale carries
    (by name first), else what it carries, else the main warehouse."""
    label = F.coalesce("store_location", F.lit("Main Warehouse"))
    if branches is None:
        return sales.withColumn("branch", label)
    names = branches.select(F.col("name").alias("_given"), F.col("name").alias("_name"), F.lit(0).alias("_rank"), "id")
    places = branches.select(F.col("location").alias("_given"), F.col("name").alias("_name"), F.lit(1).alias("_rank"), "id")
    known = names.unionByName(places).groupBy("_given").agg(F.min_by("_name", F.struct("_rank", "id")).alias("_name"))
    return sales.join(known, F.col("store_location") == F.col("_given"), "left").withColumn("branch", F.coalesce("_name", label)).drop("_given", "_name")


def sale_deltas(sales: DataFrame, products: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """CHG-1/3: signed stock delta per sale line with the product's opening stock; a sale with any unknown barcode is
    rejected whole (a test inside the sale, after one join with the products)."""
    it = stock_key(items_of(sales), branches).select("id", "is_return", "created_at", "branch", "pos", "barcode", "qty")
    known = products.groupBy("barcode").agg(F.min_by(F.coalesce("stock", F.lit(0)), "id").alias("opening"))
    j = it.join(known, "barcode", "left")
    whole = F.min(F.col("opening").isNotNull()).over(Window.partitionBy("id"))
    ok = j.withColumn("_ok", whole).filter("_ok").drop("_ok")
    return ok.withColumn("delta", F.when(F.col("is_return"), F.col("qty")).otherwise(-F.col("qty")))


def stock_after(products: DataFrame, deltas: DataFrame) -> DataFrame:
    """New product snapshot: stock + Σ delta and map[branch] + Σ delta (FN-21), one shuffle per target."""
    tot = deltas.groupBy("barcode").agg(F.sum("delta").alias("d"))
    per = deltas.groupBy("barcode", "branch").agg(F.sum("delta").cast("long").alias("d"))
    mp = per.groupBy("barcode").agg(F.map_from_entries(F.collect_list(F.struct("branch", "d"))).alias("dm"))
    j = products.select("barcode", "stock", "stock_levels").join(tot, "barcode", "left").join(mp, "barcode", "left")
    return j.select("barcode", (F.coalesce("stock", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("new_stock"),
                    X.map_add("stock_levels", "dm").alias("stock_levels"))


def audit_rows(deltas: DataFrame, products: DataFrame) -> DataFrame:
    """WIN-9 / CHG-5: quantity before and after each posting, per product in time order."""
    d = deltas if "opening" in deltas.columns else deltas.join(products.select("barcode", F.coalesce("stock", F.lit(0)).alias("opening")), "barcode")
    order = [F.col("created_at"), F.col("id"), F.col("pos"), F.col("qty")]
    d = running_sum(d, ["barcode"], order, "delta", "run", bucket=day_bucket("created_at"))
    return d.select(F.col("id").alias("reference_id"), "pos", "barcode",
                    F.when(F.col("is_return"), "Return").otherwise("Sale").alias("action_type"),
                    (F.col("opening") + F.col("run") - F.col("delta")).alias("quantity_before"),
                    (F.col("opening") + F.col("run")).alias("quantity_after"))


def fefo_for_demand(batches: DataFrame, products: DataFrame, demand: int, heavy: DataFrame | None | str = "all") -> DataFrame:
    dm = products.select(F.col("barcode").alias("product_barcode"), F.lit(demand).alias("demand"))
    return fefo_single(batches, dm, heavy).select("product_barcode", "batch_number", "branch_id", "take", "remaining")


def fefo_for_sales(batches: DataFrame, sales: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """CHG-2 / WIN-3: completed non-return sale lines consume batches in time order."""
    s = sales.filter((F.lower("status") == "completed") & ~F.col("is_return"))
    d = items_of(s).select(F.col("id").alias("sale_id"), "created_at", "pos",
                           F.col("barcode").alias("product_barcode"), "qty")
    order = [F.col("created_at"), F.col("sale_id"), F.col("pos"), F.col("qty")]
    b = batches.select("product_barcode", "batch_number", "branch_id", "expiry_date", "quantity")
    r = fefo_many(b, d, order, heavy=heavy, keep=("sale_id", "pos", "batch_number", "branch_id"))
    return r.select("sale_id", "pos", "product_barcode", "batch_number", "branch_id", F.col("take").cast("long"))


def restock_returns(batches: DataFrame, sales: DataFrame) -> DataFrame:
    it = items_of(sales.filter(F.col("is_return"))).select(F.col("barcode").alias("product_barcode"), "qty")
    return return_restock(batches, it)


def count_variance(lines: DataFrame) -> DataFrame:
    """AGG-18."""
    return lines.groupBy("stock_take_id").agg(F.coalesce(F.sum("variance"), F.lit(0)).cast("long").alias("total_variance"))


def quick_count(lines: DataFrame, products: DataFrame, branch: str) -> DataFrame:
    """CHG-13: variance = physical - branch stock; branch := physical, total += variance; rows with variance != 0."""
    p = products.select(F.col("barcode").alias("product_barcode"), "stock",
                        X.map_get0("stock_levels", branch).alias("branch_stock"))
    j = lines.join(p, "product_barcode", "inner")
    v = F.col("physical_count") - F.col("branch_stock")
    return j.select("product_barcode", v.alias("variance"), F.col("physical_count").alias("new_branch_stock"),
                    (F.coalesce("stock", F.lit(0)) + v).alias("new_total")).filter(F.col("variance") != 0)
