"""Uploads in row order against the loop, and components against union-find."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from retailkit.operators.components import components
from retailkit.plans import identity as ID

ROWS = "_row long, name string, category string, barcode_provided string, problem string"


def made(name, category):
    return re.sub("[^A-Z]", "X", name[:3].upper()) + "-" + hashlib.md5(f"{name.lower()}\x1f{category.lower()}".encode()).hexdigest()


def loop(rows, products):
    """_row -> (barcode, matched), one row after the other."""
    name_of = {b: None if n is None or c is None else (n.lower(), c.lower()) for b, n, c in products}
    out = {}
    for row, n, c, b, bad in sorted(rows, key=lambda r: r[0]):
        k = (n.lower(), c.lower())
        found = [b] if b and b in name_of else [x for x, v in name_of.items() if v == k]
        code = min(found) if found else b or made(n, c)
        out[row] = (code, bool(found))
        if not bad:
            name_of[code] = k
    return out


def resolved(spark, rows, products):
    p = spark.createDataFrame(products, "barcode string, name string, category string")
    got = ID.resolve_in_order(spark.createDataFrame(rows, ROWS), p).collect()
    assert len(got) == len(rows)
    return {r._row: (r.barcode, r.matched) for r in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_see_what_earlier_rows_made(spark, seed):
    """A third of the rows are one product; names move between stored and new products; some rows have a problem."""
    rnd = random.Random(seed)
    products = [(f"p{i}", None if i == 7 else f"N{rnd.randrange(9)}", "Cat") for i in range(8)]
    rows = []
    for row in range(600):
        if row % 3 == 0:
            n, b = ("n1", "q0") if seed == 1 else ("hot", "")
        else:
            n, b = f"n{rnd.randrange(12)}", rnd.choice(["", "", f"p{rnd.randrange(8)}", f"q{rnd.randrange(6)}"])
        rows.append((row * 37, n.upper() if rnd.random() < 0.3 else n, "cat", b, "bad" if rnd.random() < 0.1 else None))
    rnd.shuffle(rows)
    assert resolved(spark, rows, products) == loop(rows, products)


def test_odd_files(spark):
    products = [("a", "Milk", "Dairy"), ("b", "Milk", "Dairy"), ("c", None, None)]
    assert resolved(spark, [], products) == {}
    rows = [(0, "MILK", "dairy", "", None), (1, "Cream", "Dairy", "a", None), (2, "Milk", "Dairy", "zz", None), (3, "cream", "Dairy", "zz", None), (4, "Tea", "Dry", "zz", "bad"),
            (5, "Tea", "Dry", "zz", None), (6, "Butter", "Dairy", "zz", None), (7, "Tea", "Dry", "", None), (8, "Milk", "Dairy", "c", None), (9, "Milk", "Dairy", "zz", None),
            (10, "Milk", "Dairy", "", None)]
    assert resolved(spark, rows, products) == loop(rows, products) == {
        0: ("a", True), 1: ("a", True), 2: ("b", True), 3: ("a", True), 4: ("zz", False), 5: ("zz", False), 6: ("zz", True), 7: (made("tea", "dry"), False),
        8: ("c", True), 9: ("zz", True), 10: ("b", True)}


def test_file_is_applied(spark):
    rows = [(0, "New", "Cat", 1.0, 2.0, 5, "L", "q", 0, None), (1, "NEW", "cat", 1.0, 3.0, 2, "L", "", 9, None), (2, "Old", "Cat", 1.0, 1.0, 0, "", "p", 0, "stock is no number"),
            (3, "Newer", "Own", 1.0, 4.0, 1, "", "q", 0, None)]
    df = spark.createDataFrame(rows, "_row long, name string, category string, cost double, price double, stock int, batch_number string, barcode_provided string, physical_count int, problem string")
    df = df.withColumns({"expiry_date": F.lit(None).cast("date"), "conversion_rate": F.lit(1.0), "reorder_level": F.lit(10)})
    products = spark.createDataFrame([("p", "Was", "Cat", 1.0, 1.0, 4, {"Main": 4}, 1.0, 5)],
                                     "barcode string, name string, category string, price double, cost_price double, stock int, stock_levels map<string,int>, conversion_rate double, reorder_level int")
    batches = spark.createDataFrame([], "product_barcode string, batch_number string, branch_id int, expiry_date date, quantity int")
    got = ID.apply_in_order(df, products, batches, "Main", 1)
    assert {r.barcode: (r.name, r.category, r.stock, r.stock_levels["Main"]) for r in got["products"].collect()} == {"p": ("Was", "Cat", 4, 4), "q": ("Newer", "Own", 8, 8)}
    assert [(r.product_barcode, r.batch_number, r.quantity) for r in got["batches"].collect()] == [("q", "L", 5)]
    assert [(r.product_barcode, r.physical_count, r.system_count) for r in got["counts"].collect()] == [("q", 9, 8)]
    assert [tuple(r) for r in got["errors"].collect()] == [(2, "Old", "stock is no number")]
    assert {r.category for r in got["categories"].collect()} == {"Cat", "cat", "Own"}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [(f"r{rnd.randrange(90)}", f"r{rnd.randrange(90)}") for _ in range(60)] + [("x", "x"), ("y", None)]
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v
    for a, b in edges:
        if b is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: top(v) for v in up}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
