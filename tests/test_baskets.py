"""All-or-nothing baskets in parallel rounds against the loop, and dispatched transfers on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retailkit.operators.baskets import settle_baskets
from retailkit.operators.changeset import post, rows_of
from retailkit.operators.running import day_bucket
from retailkit.plans import postings as PO

COLS = "source string, basket long, at timestamp_ntz, item string, qty int, available long"


def loop(rows):
    """(source, basket, item) -> (accepted, used before, qty), one basket after the other."""
    baskets, av = {}, {}
    for k, b, at, i, q, a in rows:
        x = baskets.setdefault((k, b), [at, {}])
        x[0] = min(x[0], at)
        x[1][i] = x[1].get(i, 0) + (q or 0)
        av[k, i] = a
    used, out = {}, {}
    for (k, b), (at, need) in sorted(baskets.items(), key=lambda e: (e[1][0], e[0][1])):
        ok = all(av[k, i] is not None and used.get((k, i), 0) + q <= av[k, i] for i, q in need.items())
        for i, q in need.items():
            out[k, b, i] = (ok, used.get((k, i), 0), q)
            if ok:
                used[k, i] = used.get((k, i), 0) + q
    return out


def settled(spark, rows, **more):
    df = spark.createDataFrame(rows, COLS)
    got = settle_baskets(df, "source", ["basket"], "at", "item", "qty", "available", day_bucket, **more).collect()
    assert len({(r.source, r.basket, r.item) for r in got}) == len(got)
    return {(r.source, r.basket, r.item): (r.accepted, r.used_before, r.qty) for r in got}


def made(seed, n=500, items=12, stock=60, least=1):
    """A third of the baskets and of the lines are of one source and one item; some items are unknown, some quantities null."""
    rnd = random.Random(seed)
    av = {(s, i): None if rnd.random() < 0.04 else rnd.randint(0, stock) for s in "ABC" for i in range(items)}
    rows = []
    for b in range(n):
        s = "A" if b % 3 == 0 else rnd.choice("ABC")
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 9))
        for _ in range(rnd.randint(1, 4)):
            i = 0 if rnd.random() < 0.33 else rnd.randrange(items)
            rows.append((s, b, at, f"p{i}", rnd.choice([None] + list(range(least, 9))), av[s, i]))
    return rows


@pytest.mark.parametrize("seed,rounds,least", [(1, 24, 1), (2, 24, -4), (3, 2, 1), (4, 1, -3)])
def test_rounds_equal_the_loop(spark, seed, rounds, least):
    """Also where few rounds leave a rest to the sequential form, and where lines give back."""
    rows, report = made(seed, n=300, least=least), []
    assert settled(spark, rows, rounds=rounds, report=report) == loop(rows)
    assert report == sorted(report, reverse=True) and (rounds == 24) == (report[-1] == 0)


def test_odd_baskets(spark):
    t = dt.datetime(2024, 1, 1)
    assert settled(spark, []) == {}
    rows = [("A", 1, t, "x", 3, 5), ("A", 1, t, "x", 3, 5), ("A", 2, t, "x", 5, 5), ("A", 2, t, "x", 0, 5), ("A", 3, t, "x", None, 5), ("A", 4, t, "x", 1, 5),
            ("B", 1, t, "x", 1, None), ("B", 1, t, "y", 1, 9), ("B", 2, t, "y", 9, 9)]       # repeated lines add up; ties of time go by the number
    assert settled(spark, rows) == loop(rows)
    null = settled(spark, [("A", None, t, "x", 2, 3), ("A", None, t, "y", 2, 3), ("A", 7, t, "x", 2, 3)])
    assert null == {("A", None, "x"): (True, 0, 2), ("A", None, "y"): (True, 0, 2), ("A", 7, "x"): (False, 2, 2)}


def test_transfers_leave_their_source(spark, tmp_path):
    branches = spark.createDataFrame([(1, "Main", "Accra"), (2, "North", None), (3, "Late", "Accra")], "id long, name string, location string")
    products = spark.createDataFrame([("p", 20, {"Main": 4, "Accra": 6, "North": 5, "Yard": 5}), ("q", None, {"Main": 2}), ("r", 3, None), ("s", 9, {"Accra": 9})],
                                     "barcode string, stock int, stock_levels map<string,int>")
    t = [dt.datetime(2024, 1, 1, h) for h in range(10)]
    lines = [(1, "Accra", "North", "p", 7, t[0]), (2, "Main", "Yard", "p", 4, t[1]), (2, "Main", "Yard", "q", 1, t[1]),      # 3 of p left: refused, q isn't taken
             (3, "Main", "North", "p", 3, t[2]), (3, "Main", "North", "q", 2, t[2]), (4, "Yard", "Accra", "p", 5, t[3]), (5, "North", "Main", "r", 1, t[4]),
             (6, "North", "Main", "zz", 0, t[5]), (7, None, "Main", None, 1, t[6]), (8, "North", "Main", "r", 0, t[7])]
    df = spark.createDataFrame(lines, "transfer_id long, from_location string, to_location string, barcode string, qty int, created_at timestamp_ntz").withColumn("source", F.lit("clash"))
    changes = PO.dispatch_transfers(df, products, branches)
    folder = str(tmp_path / "dispatch")
    post(changes, folder)
    got = {k: rows_of(spark, changes, folder, k) for k in ("product", "transfer", "reject")}
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got["transfer"].collect()) == [
        (1, "Main", "North", "In Transit", "p", 7), (3, "Main", "North", "In Transit", "p", 3), (3, "Main", "North", "In Transit", "q", 2),
        (4, "Yard", "Main", "In Transit", "p", 5), (8, "North", "Main", "In Transit", "r", 0)]
    assert sorted((r.transfer_id, r.barcode, r.available, r.requested, r.reason) for r in got["reject"].collect()) == [
        (2, "p", 3, 4, "Insufficient stock"), (5, "r", 0, 1, "Insufficient stock"), (6, "zz", None, 0, "not found"), (7, "", None, 1, "not found")]
    new = {r.barcode: (r.stock, r.stock_levels) for r in PO.take_from_stock(products, branches, got["product"]).collect()}
    assert new == {"p": (5, {"Main": 0, "North": 5, "Yard": 0}), "q": (None, {"Main": 0}), "r": (3, {"North": 0}), "s": (9, {"Accra": 9})}
