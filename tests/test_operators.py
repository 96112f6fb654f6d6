"""Custom operators against brute-force Python on random data with a hot key."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from retailkit.operators.fold import sequential_accept
from retailkit.operators.intervals import overlap_amounts, points_in_intervals
from retailkit.operators.running import day_bucket, running_sum
from retailkit.operators.sequence import global_row_number
from retailkit.operators.topk import first_per_group, top_k_per_group
from retailkit.operators.upsert import upsert
from retailkit.operators import fefo
from retailkit.operators.fefo import fefo_many, fefo_single

T0 = dt.datetime(2024, 1, 1)


def _events(n=3000, keys=20, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.34 else rnd.randrange(1, keys)      # key 0 holds a third of the rows
        rows.append((i, k, T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)), rnd.randrange(-5, 20)))
    return rows


def test_running_sum_two_level_equals_single_window(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "id LONG, k LONG, ts TIMESTAMP_NTZ, v LONG")
    order = [F.col("ts"), F.col("id")]
    a = running_sum(df, ["k"], order, "v", "run", bucket=day_bucket("ts"))
    b = running_sum(df, ["k"], order, "v", "run")
    assert a.select("id", "run").exceptAll(b.select("id", "run")).count() == 0
    exp = {}
    acc = {}
    for i, k, ts, v in sorted(rows, key=lambda r: (r[2], r[0])):
        acc[k] = acc.get(k, 0) + v
        exp[i] = acc[k]
    got = {r["id"]: r["run"] for r in a.select("id", "run").collect()}
    assert got == exp


def test_running_sum_exclusive(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 1)], "k INT, o INT, v INT")
    out = running_sum(df, ["k"], [F.col("o")], "v", "before", bucket=F.col("o"), inclusive=False)
    assert [r["before"] for r in out.orderBy("o").collect()] == [0, 5, 12]


def _fefo_loop(batches, demands):
    """The reference's per-sale loop: earliest expiry first, NULL expiry last."""
    left = {}
    for b in sorted(batches, key=lambda b: (b[2] is None, b[2] or dt.date.min, b[1], b[3])):
        if b[4] > 0:
            left.setdefault(b[0], []).append([b[1], b[3], b[4]])
    out = {}
    for sid, pos, prod, qty, ts in sorted(demands, key=lambda d: (d[4], d[0], d[1], d[3])):
        need = qty
        for bt in left.get(prod, []):
            if need <= 0:
                break
            take = min(need, bt[2])
            if take > 0:
                out[(sid, pos, bt[0], bt[1])] = out.get((sid, pos, bt[0], bt[1]), 0) + take
                bt[2] -= take
                need -= take
    return out


def test_fefo_many_equals_sequential_loop(spark, monkeypatch):
    rnd = random.Random(3)
    batches, demands = [], []
    for p in range(6):
        for j in range(rnd.randrange(1, 8)):
            exp = None if rnd.random() < 0.15 else dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(0, 90))
            batches.append((str(p), f"B{j:02d}", exp, rnd.randrange(1, 4), rnd.randrange(0, 30)))
    for s in range(300):
        demands.append((s, 0, str(rnd.randrange(0, 6)), rnd.randrange(1, 15),
                        T0 + dt.timedelta(hours=rnd.randrange(0, 2000))))
    bdf = spark.createDataFrame(batches, "product_barcode STRING, batch_number STRING, expiry_date DATE, "
                                         "branch_id INT, quantity INT")
    ddf = spark.createDataFrame(demands, "sale_id LONG, pos INT, product_barcode STRING, qty INT, created_at TIMESTAMP_NTZ")
    exp = _fefo_loop(batches, demands)
    for axis in (3, 7, 50, 4096):             # buckets smaller and larger than the intervals
        monkeypatch.setattr(fefo, "AXIS", axis)
        got = fefo_many(bdf, ddf, [F.col("created_at"), F.col("sale_id"), F.col("pos"), F.col("qty")])
        got = {(r["sale_id"], r["pos"], r["batch_number"], r["branch_id"]): r["take"] for r in got.collect()}
        assert got == exp


def test_fefo_single_demand_above_supply_and_zero_batches(spark):
    b = spark.createDataFrame([("x", "1", dt.date(2024, 1, 5), 1, 3), ("x", "2", None, 1, 10),
                               ("x", "3", dt.date(2024, 1, 1), 1, 0), ("x", "4", dt.date(2024, 1, 1), 2, 4)],
                              "product_barcode STRING, batch_number STRING, expiry_date DATE, branch_id INT, quantity INT")
    d = spark.createDataFrame([("x", 100)], "product_barcode STRING, demand INT")
    got = {r["batch_number"]: r["take"] for r in fefo_single(b, d).collect()}
    assert got == {"4": 4, "1": 3, "2": 10}          # zero-quantity batch skipped, NULL expiry last


def test_sequential_accept_equals_loop(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(800):
        k = 0 if rnd.random() < 0.4 else rnd.randrange(1, 9)
        rows.append((k, i, T0 + dt.timedelta(minutes=rnd.randrange(0, 5000)), Decimal(rnd.randrange(1, 400)),
                     True, Decimal("10.00"), Decimal(rnd.choice([500, 1000, 3000]))))
    lim = {}
    for r in rows:                    # one limit per key (first row's)
        lim.setdefault(r[0], r[6])
    rows = [r[:6] + (lim[r[0]],) for r in rows]
    df = spark.createDataFrame(rows, "k LONG, id LONG, ts TIMESTAMP_NTZ, amt DECIMAL(12,2), chk BOOLEAN, "
                                     "start DECIMAL(12,2), lim DECIMAL(12,2)")
    got = {r["id"]: (r["accepted"], r["balance_after"])
           for r in sequential_accept(df, "k", ["ts", "id"], "amt", "chk", "start", "lim").collect()}
    bal, exp = {}, {}
    for k, i, ts, a, _, s0, lm in sorted(rows, key=lambda r: (r[2], r[1])):
        b = bal.get(k, s0)
        ok = b + a <= lm
        if ok:
            b += a
        bal[k] = b
        exp[i] = (ok, b)
    assert got == exp


def test_sequential_accept_rejected_then_fits(spark):
    df = spark.createDataFrame([(1, 1, 80.0), (1, 2, 50.0), (1, 3, 20.0)], "k LONG, id LONG, amt DOUBLE") \
        .select("k", "id", F.col("amt").cast("decimal(12,2)").alias("amt"), F.lit(True).alias("chk"),
                F.lit(0).cast("decimal(12,2)").alias("s"), F.lit(100).cast("decimal(12,2)").alias("lim"))
    got = [r["accepted"] for r in sequential_accept(df, "k", ["id"], "amt", "chk", "s", "lim").orderBy("id").collect()]
    assert got == [True, False, True]


def test_points_in_intervals_equals_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.randrange(0, 4), T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6))) for i in range(500)]
    ivs = []
    for j in range(40):
        s = T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6))
        e = None if rnd.random() < 0.1 else s + dt.timedelta(minutes=rnd.randrange(0, 60 * 40))
        ivs.append((1000 + j, rnd.randrange(0, 4), s, e))
    p = spark.createDataFrame(pts, "pid LONG, u LONG, ts TIMESTAMP_NTZ")
    i = spark.createDataFrame(ivs, "iid LONG, u LONG, st TIMESTAMP_NTZ, en TIMESTAMP_NTZ")
    got = sorted((r["pid"], r["iid"]) for r in points_in_intervals(p, i, "u", "ts", "st", "en").collect())
    exp = sorted((a, b) for a, u, ts in pts for b, u2, s, e in ivs if u == u2 and ts >= s and (e is None or ts <= e))
    assert got == exp


def test_overlap_amounts_equals_brute_force(spark):
    rnd = random.Random(9)

    def ivs(n, base):
        out = []
        for i in range(n):
            lo = rnd.randrange(0, 300)
            out.append((base + i, "k", lo, lo + rnd.randrange(0, 50)))
        return out
    a, b = ivs(60, 0), ivs(60, 1000)
    l = spark.createDataFrame(a, "aid LONG, key STRING, alo LONG, ahi LONG")
    r = spark.createDataFrame(b, "bid LONG, key STRING, blo LONG, bhi LONG")
    exp = {}
    for i, _, lo1, hi1 in a:
        for j, _, lo2, hi2 in b:
            o = min(hi1, hi2) - max(lo1, lo2)
            if o > 0:
                exp[(i, j)] = o
    for width in (16, "auto"):
        got = {(x["aid"], x["bid"]): x["overlap"]
               for x in overlap_amounts(l, r, "key", "alo", "ahi", "blo", "bhi", width).collect()}
        assert got == exp


def test_global_row_number_is_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(10 ** 6), 777)
    df = spark.createDataFrame([(i,) for i in ids], "id LONG")
    got = [(r["id"], r["seq"]) for r in global_row_number(df, "id", "seq", partitions=5).orderBy("id").collect()]
    assert got == [(i, n + 1) for n, i in enumerate(sorted(ids))]


def test_top_k_per_group_and_first_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 5)], "g STRING, v INT")
    top = top_k_per_group(df, ["g"], [F.col("v").desc()], 2)
    assert sorted((r["g"], r["v"]) for r in top.collect()) == [("a", 2), ("a", 3), ("b", 5)]
    first = first_per_group(df, ["g"], F.struct("v"), ["v"])
    assert sorted((r["g"], r["v"]) for r in first.collect()) == [("a", 1), ("b", 5)]


def test_upsert_policies(spark):
    t = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k INT, q INT, s STRING")
    c = spark.createDataFrame([(2, 5, None), (3, 7, "z")], "k INT, q INT, s STRING")

    def run(policy, **kw):
        return sorted(tuple(r) for r in upsert(t, c, ["k"], policy, **kw).drop("_action").collect())
    assert run("ignore") == [(1, 10, "x"), (2, 20, "y"), (3, 7, "z")]
    assert run("overwrite") == [(1, 10, "x"), (2, 5, None), (3, 7, "z")]
    assert run("add", add_cols=("q",)) == [(1, 10, "x"), (2, 25, "y"), (3, 7, "z")]
    assert run("keep_if_null") == [(1, 10, "x"), (2, 5, "y"), (3, 7, "z")]
    assert run("partial", set_cols=("q",)) == [(1, 10, "x"), (2, 5, "y"), (3, 7, "z")]


def test_sequential_baskets_equals_loop(spark):
    from retailkit.operators.fold import sequential_baskets
    rnd = random.Random(17)
    rows = []
    avail = {(s, p): rnd.randrange(0, 30) for s in range(3) for p in range(5)}
    for t in range(200):
        s = 0 if rnd.random() < 0.4 else rnd.randrange(1, 3)
        ts = T0 + dt.timedelta(minutes=rnd.randrange(0, 3000))
        for _ in range(rnd.randrange(1, 4)):
            p = rnd.randrange(0, 5)
            rows.append((s, t, ts, p, rnd.randrange(1, 6), avail[(s, p)]))
    df = spark.createDataFrame(rows, "src LONG, tid LONG, ts TIMESTAMP_NTZ, item LONG, q LONG, av LONG")
    got = {(r["src"], r["tid"]): r["accepted"]
           for r in sequential_baskets(df, "src", "tid", ["ts"], "item", "q", "av").collect()}
    used, exp = {}, {}
    baskets = {}
    for s, t, ts, p, q, av in rows:
        need = baskets.setdefault((s, t), [ts, {}])[1]
        need[p] = need.get(p, 0) + q
    for (s, t), (ts, need) in sorted(baskets.items(), key=lambda kv: (kv[0][0], kv[1][0], kv[0][1])):
        ok = all(used.get((s, p), 0) + q <= avail[(s, p)] for p, q in need.items())
        if ok:
            for p, q in need.items():
                used[(s, p)] = used.get((s, p), 0) + q
        exp[(s, t)] = ok
    assert got == exp and 0 < sum(exp.values()) < len(exp)


def test_points_in_very_long_intervals(spark):
    """Intervals of years are not cut into days and still meet their points."""
    t = dt.datetime(2020, 1, 1)
    iv = spark.createDataFrame([(1, "a", t, t + dt.timedelta(days=4000)), (2, "a", t, t + dt.timedelta(days=2)), (3, "a", t, None)], "sid INT, key STRING, s TIMESTAMP_NTZ, e TIMESTAMP_NTZ")
    pt = spark.createDataFrame([(i, "a", t + dt.timedelta(days=d)) for i, d in enumerate((0, 1, 2, 3, 3999, 4001))], "pid INT, key STRING, ts TIMESTAMP_NTZ")
    got = {(r.sid, r.pid) for r in points_in_intervals(pt, iv, "key", "ts", "s", "e").collect()}
    assert got == {(1, i) for i in range(5)} | {(2, i) for i in range(3)} | {(3, i) for i in range(6)}
