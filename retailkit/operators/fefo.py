"""First-expiry-first-out batch allocation (WIN-2, WIN-3, WIN-4).

Batches of a product are consumed in the order expiry date (NULL last),
batch number, branch -- a total order, so results are deterministic.  As in
the reference, branch, status and ``quantity_available`` do not restrict
the choice (T15); batches with no quantity are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailkit.operators.running import day_bucket, mark_heavy, month_bucket, running_sum


def fefo_order():
    return [F.col("expiry_date").asc_nulls_last(), F.col("batch_number").asc(), F.col("branch_id").asc()]


def fefo_single(batches: DataFrame, demand: DataFrame, heavy: DataFrame | None | str = "all") -> DataFrame:
    """One demand per product (``demand``: product_barcode, demand): take from the earliest batches.

    take = greatest(0, least(qty, demand - supply_before)); rows with take > 0.  ``heavy``: see ``running``.
    """
    b = batches.filter(F.col("quantity") > 0)
    b = running_sum(b, ["product_barcode"], fefo_order(), "quantity", "supply_before",
                    bucket=month_bucket("expiry_date"), inclusive=False, heavy=heavy)
    j = b.join(demand, "product_barcode", "inner")
    take = F.greatest(F.lit(0), F.least(F.col("quantity"), F.col("demand") - F.col("supply_before")))
    return (j.withColumn("take", take.cast("long")).filter(F.col("take") > 0)
            .withColumn("remaining", (F.col("quantity") - F.col("take")).cast("long")))


AXIS = 4096       # units of the cumulative axis in one bucket; a bucket holds at most one batch end and one demand end per unit


def fefo_many(batches: DataFrame, demands: DataFrame, demand_order: list, demand_ts: str = "created_at",
              heavy: DataFrame | None | str = "all", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Many demands per product in time order (``demands``: product_barcode, qty, ... ).

    Each demand is the interval [D_before, D_before + qty) on the product's
    cumulative-demand axis, each batch [S_before, S_before + quantity) on the
    cumulative-supply axis; the amount a demand takes from a batch is the
    length of their overlap.  Equal to the sequential per-sale loop.  ``heavy``: see ``running``; ``keep``:
    the columns of both sides that are put out (None: all), since the others needn't be sorted along the axis.
    """
    s = batches.filter(F.col("quantity") > 0)
    s = running_sum(s, ["product_barcode"], fefo_order(), "quantity", "s_hi", bucket=month_bucket("expiry_date"), heavy=heavy)
    d = demands.filter(F.col("qty") > 0)
    d = running_sum(d, ["product_barcode"], demand_order, "qty", "d_hi", bucket=day_bucket(demand_ts), heavy=heavy)
    if keep is not None:
        d, s = [x.select("product_barcode", hi, *[c for c in keep if c in x.columns]) for x, hi in ((d, "d_hi"), (s, "s_hi"))]
    return merged_axis(d, s, "product_barcode", "d_hi", "s_hi", heavy).withColumnRenamed("length", "take")


def merged_axis(left: DataFrame, right: DataFrame, key: str, left_hi: str, right_hi: str, heavy: DataFrame | None | str = "all") -> DataFrame:
    """Overlaps of two sets of intervals that each cover a key's axis from 0 without gaps, given by their upper ends.

    The ends of both sides cut the axis into steps; a step belongs to the interval of either side that ends next at or after
    it.  One shuffle of the ends on (key, bucket of the axis), a pass from high to low inside each bucket that carries the
    next interval of either side, and one row per bucket that hands the carried intervals on to lower buckets.  Ends are
    distinct whole numbers on each side, so a bucket is bounded whatever a key's share of the rows.
    Returns key, the other columns of both sides, and ``length``.  ``heavy``: the keys whose axis is cut into buckets (None: no key's is,
    "all": every key's); another key's axis is one bucket.
    """
    lc, rc = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    l_type, r_type = F.struct(left_hi, *[c for c in lc if c != left_hi]), F.struct(right_hi, *[c for c in rc if c != right_hi])      # ordered by the end
    a = left.select(key, F.col(left_hi).cast("long").alias("_p"), l_type.alias("_l"))
    b = right.select(key, F.col(right_hi).cast("long").alias("_p"), r_type.alias("_r"))
    ends = a.unionByName(b, allowMissingColumns=True).filter(F.col(key).isNotNull())
    if heavy is None:
        ends = ends.withColumn("_b", F.lit(0).cast("long"))
    elif isinstance(heavy, str):
        ends = ends.withColumn("_b", F.floor(F.col("_p") / AXIS)).repartition(key, "_b")
    else:
        many = heavy.toDF(key)
        ends = mark_heavy(ends, [key], many, "_h").withColumn("_b", F.when(F.col("_h"), F.floor(F.col("_p") / AXIS)).otherwise(0)).drop("_h").repartition(key, "_b")
    down = Window.partitionBy(key, "_b").orderBy(F.col("_p").desc(), F.col("_l").isNull())
    carried = down.rowsBetween(Window.unboundedPreceding, 0)
    steps = (ends.withColumn("_nl", F.last("_l", ignorenulls=True).over(carried)).withColumn("_nr", F.last("_r", ignorenulls=True).over(carried))
             .withColumn("_q", F.lead("_p").over(down)))
    if heavy is None:
        hand = None
    else:
        hand = _handed(_bucket_ends(ends if isinstance(heavy, str) else mark_heavy(ends, [key], many, "_h").filter("_h").drop("_h"), key), key)
    if hand is None:
        out = steps.select(key, F.col("_nl").alias("_l"), F.col("_nr").alias("_r"), (F.col("_p") - F.coalesce("_q", F.lit(0))).alias("length"))
    else:
        j = steps.join(hand, [key, "_b"], "inner" if isinstance(heavy, str) else "left")
        out = j.select(key, F.coalesce("_nl", "_al").alias("_l"), F.coalesce("_nr", "_ar").alias("_r"),
                       (F.col("_p") - F.coalesce("_q", "_below", F.lit(0))).alias("length"))
    out = out.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("length") > 0))
    return out.select(key, *[F.col(f"_l.{c}").alias(c) for c in lc], *[F.col(f"_r.{c}").alias(c) for c in rc], "length")


def _handed(ends_of: DataFrame, key: str) -> DataFrame:
    """What a bucket gets from the buckets around it: the next interval of either side above it, and the highest end below."""
    up = Window.partitionBy(key).orderBy(F.col("_b").desc())
    above = up.rowsBetween(Window.unboundedPreceding, -1)
    return ends_of.select(key, "_b", F.last("_fl", ignorenulls=True).over(above).alias("_al"), F.last("_fr", ignorenulls=True).over(above).alias("_ar"),
                          F.lead("_top").over(up).alias("_below"))


def _bucket_ends(ends: DataFrame, key: str) -> DataFrame:
    """Per bucket the lowest interval of either side and the highest end."""
    return ends.groupBy(key, "_b").agg(F.min("_l").alias("_fl"), F.min("_r").alias("_fr"), F.max("_p").alias("_top"))


def return_restock(batches: DataFrame, returns: DataFrame) -> DataFrame:
    """WIN-4: all returned units of a product go to its earliest-expiry batch, even an empty one.

    The earliest batch is found with ``min_by`` (an aggregate, combined map-side),
    not a window over the product.
    """
    key = F.struct(F.col("expiry_date").isNull(), "expiry_date", "batch_number", "branch_id")
    first = batches.groupBy("product_barcode").agg(
        F.min_by(F.struct("batch_number", "branch_id", "quantity"), key).alias("b"))
    back = returns.groupBy("product_barcode").agg(F.sum("qty").alias("returned"))
    j = first.join(back, "product_barcode", "inner")
    return j.select("product_barcode", F.col("b.batch_number").alias("batch_number"),
                    F.col("b.branch_id").alias("branch_id"), F.col("returned").cast("long").alias("returned"),
                    (F.col("b.quantity") + F.col("returned")).cast("long").alias("new_quantity"))
