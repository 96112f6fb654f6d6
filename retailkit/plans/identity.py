"""Bulk upload row by row (CHG-17, JN-23): which product each row of a file means, when rows see what earlier rows made.

The reference's loop looks a row up by barcode, else by the name and category that a product has **then**: a row gives its product its own name,
so names move, and a row that finds nothing makes a product that later rows find.  The parts of this that hang on nothing are done for
all rows at once, and only the rest is folded in order:

1. rows whose barcode is in the product table mean that product; they say from which row to which each product has which name;
2. for the others, the stored product that has their name at that row: the smallest barcode of products that the file doesn't touch, and of
   those from 1 whose span covers the row.  Starts and ends of spans and the rows pass by name in file order, so no row meets all
   spans of its name; a name's products of the moment are in memory;
3. the others interact only through shared barcodes and names: connected components over (barcode, name) pairs;
4. a component's rows are folded in file order with the products that it made as state.  Rows that repeat the one before them (same barcode, name,
   stored product, validity) mean the same product, so only the first of a run is folded, and the others take its answer: a
   product with a third of the file is a few rows here.  A component in which rows alternate all the time stays one task's
   stream, with the products that it made in memory.

Rows with ``problem`` (a number that isn't one) look products up but make and change none.  Of several products with the name, the smallest
barcode is meant; a generated code that a product has already means that product.  Rows have a name; ``_row`` is unique and not negative.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailkit.operators.components import components
from retailkit.operators.running import running_agg
from retailkit.plans.ingest import bulk_apply, generated_barcode
from retailkit.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET = 4096           # rows of the file in a bucket


def _block(row: str) -> Column:
    return F.floor(F.col(row) / BUCKET)


def run_starts(df: DataFrame, keys: list[str], row: str, same: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``same`` columns differ from those of the row before them, per key in the order of ``row``: first inside blocks of the
    file, then among what is left."""
    for part in ([*keys, "_block"], keys):
        w = Window.partitionBy(*part).orderBy(row)
        before = F.lag(F.struct(*same)).over(w)
        df = df.withColumn("_block", _block(row)).withColumn("_new", ~before.eqNullSafe(F.struct(*same))).filter("_new").drop("_new", "_block")
    return df


def name_key(name="name", category="category") -> Column:
    return F.concat(F.lower(name), F.lit("\x1f"), F.lower(category))


def stored_holders(hits: DataFrame, rest: DataFrame, products: DataFrame) -> DataFrame:
    """(_row, held): for each row of ``rest`` (_row, k) with a stored product that has its name at that row, the smallest barcode of these."""
    named = products.select("barcode", name_key().alias("k"))
    touched = hits.select("barcode").distinct()
    still = named.join(touched, "barcode", "left_anti").filter("k IS NOT NULL").groupBy("k").agg(F.min("barcode").alias("held"))
    first = named.join(touched, "barcode", "left_semi").select("barcode", F.lit(-1).cast("long").alias("since"), "k")
    moves = run_starts(first.unionByName(hits.select("barcode", F.col("_row").alias("since"), "k")), ["barcode"], "since", ["k"])
    spans = running_agg(moves, ["barcode"], [F.col("since").desc()], "since", "until", bucket=-_block("since"), inclusive=False, agg="min")
    spans = spans.filter("k IS NOT NULL").select("k", F.col("barcode").alias("held"), "since", "until")
    takes, leaves = [F.struct(F.col(c).alias("at"), F.lit(i).alias("step")) for c, i in (("since", 2), ("until", 0))]
    moves = spans.filter("until IS NULL OR until > since").select("k", "held", F.explode(F.array(takes, leaves)).alias("e")).filter("e.at IS NOT NULL")
    asked = rest.select("k", F.col("_row").alias("at"), F.lit(1).alias("step"), F.lit(None).cast("string").alias("held"))
    events = asked.unionByName(moves.select("k", "e.at", "e.step", "held"))
    moving = events.filter("k IS NOT NULL").repartition("k").sortWithinPartitions("k", "at", "step").mapInPandas(_sweep, "_row long, held string")
    return rest.join(still, "k").select("_row", "held").unionByName(moving).groupBy("_row").agg(F.min("held").alias("held"))


def _sweep(batches):
    """(k, at, step, held) in order of (k, at, step), where a product leaves a name (step 0), a row asks (1) or a product takes it (2) -> (_row, held): the
    smallest barcode of the products with the row's name."""
    import heapq

    import pandas as pd
    name, heap, held_by = None, [], {}
    for pdf in batches:
        out = []
        for k, at, step, code in zip(*(pdf[c].tolist() for c in ("k", "at", "step", "held"))):
            if k != name:
                name, heap, held_by = k, [], {}
            if step == 2:
                if not held_by.get(code):
                    heapq.heappush(heap, code)
                held_by[code] = held_by.get(code, 0) + 1
            elif step == 0:
                held_by[code] -= 1
            else:
                while heap and not held_by[heap[0]]:            # left before
                    heapq.heappop(heap)
                if heap:
                    out.append((at, heap[0]))
        yield pd.DataFrame(out, columns=["_row", "held"])


def _fold(batches):
    """Rows (comp, _row, b, k, held, ok, made) in order of (comp, _row) -> (_row, barcode, matched)."""
    import heapq

    import pandas as pd
    comp, name_of, named = None, {}, {}                              # named: per name a heap of codes, some of which have left it
    for pdf in batches:
        out = []
        for c, row, b, k, held, ok, made in pdf[["comp", "_row", "b", "k", "held", "ok", "made"]].itertuples(index=False, name=None):
            if c != comp:
                comp, name_of, named = c, {}, {}
            by_code = b != "" and b in name_of
            codes = named.get(k, [])
            while not by_code and codes and name_of[codes[0]] != k:
                heapq.heappop(codes)
            found = [b] if by_code else [*codes[:1], *([held] if isinstance(held, str) else [])]
            code = min(found) if found else (b or made)
            if ok and (by_code or not found):                    # a product found by its name has that name already
                if name_of.get(code) != k:
                    name_of[code] = k
                    heapq.heappush(named.setdefault(k, []), code)
            out.append((row, code, bool(found)))
        yield pd.DataFrame(out, columns=["_row", "barcode", "matched"])


def resolve_in_order(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` (of ``parse_upload``) with ``barcode``, the product that each row means, and ``matched`` (it was there before the row)."""
    ensure_checkpoint_dir(rows.sparkSession)
    known = products.select(F.col("barcode").alias("barcode_provided"), F.lit(True).alias("_known"))
    all_rows = rows.join(known, "barcode_provided", "left").withColumn("_known", F.coalesce("_known", F.lit(False))).checkpoint()
    short = all_rows.select("_row", F.col("barcode_provided").alias("b"), name_key().alias("k"), F.col("problem").isNull().alias("ok"), generated_barcode().alias("made"), "_known")
    hits = short.filter("_known AND ok").select(F.col("b").alias("barcode"), "_row", "k")
    rest = short.filter("NOT _known").drop("_known")
    rest = rest.join(stored_holders(hits, rest.select("_row", "k"), products), "_row", "left")
    pairs = rest.filter("b <> ''").select(F.concat(F.lit("k"), "k").alias("a"), F.concat(F.lit("b"), "b").alias("b")).distinct()
    comp = components(pairs).filter("node LIKE 'k%'").select(F.expr("substring(node, 2)").alias("k"), F.col("root").alias("comp"))
    rest = rest.join(comp, "k", "left").withColumn("comp", F.coalesce("comp", F.concat(F.lit("k"), "k"))).checkpoint()
    heads = run_starts(rest, ["comp"], "_row", ["b", "k", "held", "ok"]).checkpoint()
    told = heads.repartition("comp").sortWithinPartitions("comp", "_row").mapInPandas(_fold, "_row long, barcode string, matched boolean").checkpoint()
    marked = rest.select("comp", "_row", "ok").join(heads.select("_row", F.col("_row").alias("_head")), "_row", "left")
    led = running_agg(marked, ["comp"], [F.col("_row")], "_head", "_of", bucket=_block("_row"), agg="max").select("_row", "ok", "_of")
    answer = led.join(told.withColumnRenamed("_row", "_of"), "_of").select("_row", "barcode", (F.col("matched") | (F.col("ok") & (F.col("_row") > F.col("_of")))).alias("matched"))
    cols = [F.col(c) for c in rows.columns]
    found = all_rows.filter("_known").select(*cols, F.col("barcode_provided").alias("barcode"), F.lit(True).alias("matched"))
    return found.unionByName(all_rows.filter("NOT _known").join(answer, "_row").select(*cols, "barcode", "matched"))


def apply_in_order(rows: DataFrame, products: DataFrame, batches: DataFrame, branch: str, branch_id: int) -> dict[str, DataFrame]:
    """CHG-17 as the row loop does it: ``products`` and new ``batches`` after the file, ``counts`` (of rows with a problem too), ``categories`` of all rows,
    ``errors`` (_row, name, problem), and the ``rows`` with the product that each means."""
    m = resolve_in_order(rows, products).checkpoint()
    after, new_batches, counts, _ = bulk_apply(rows, products, batches, branch, branch_id, matched=m)
    return {"products": after, "batches": new_batches, "counts": counts, "categories": m.select("category").distinct(),
            "errors": m.filter("problem IS NOT NULL").select("_row", "name", "problem"), "rows": m}
