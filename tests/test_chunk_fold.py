"""The chunked accept/reject fold against the plain loop."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailkit.operators.chunk_fold import accept, accept_in_chunks
from retailkit.operators.running import day_bucket

SCHEMA = "k string, id long, ts timestamp_ntz, amt decimal(18,2), chk boolean, start decimal(18,2), lim decimal(18,2)"


def rows_of(rnd, key, n, limit, returns, first=0, start="10.00"):
    t0 = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        back = rnd.random() < returns
        amount = Decimal(rnd.randint(1, 9000)) / 100
        out.append((key, first + i, t0 + dt.timedelta(minutes=rnd.randint(0, 20_000)), -amount if back else amount, not back, Decimal(start), limit))
    return out


def loop(rows):
    out, balance = {}, {}
    for k, i, _, a, checked, start, limit in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        b = balance.get(k, start if start is not None else Decimal(0))
        a = a or Decimal(0)
        ok = not checked or b + a <= (limit if limit is not None else Decimal(0))
        b += a if ok else 0
        balance[k] = b
        out[i] = (ok, b)
    return out


def mixed(seed):
    rnd = random.Random(seed)
    rows = rows_of(rnd, "hot", 900, Decimal("4000.00"), 0.35)                       # a third of the rows, now and then at its limit
    rows += rows_of(rnd, "full", 400, Decimal("300.00"), 0.02, 1000)                # always at its limit
    rows += rows_of(rnd, "calm", 600, Decimal("900000.00"), 0.1, 2000)              # never refused
    rows += rows_of(rnd, "none", 200, None, 0.5, 3000)
    for i in range(40):
        rows += rows_of(rnd, f"k{i}", rnd.randint(1, 30), Decimal(rnd.choice(["50.00", "500.00"])), 0.2, 4000 + 100 * i)
    rows.append(("calm", 9000, dt.datetime(2024, 1, 2), None, True, Decimal(1), Decimal("900000.00")))
    rnd.shuffle(rows)
    return rows


def decided(df):
    return {r.id: (r.accepted, r.balance_after) for r in df.collect()}


@pytest.mark.parametrize("rounds", [0, 3])
def test_chunks_equal_the_loop(spark, rounds):
    rows = mixed(rounds)
    rows = [r if r[0] != "calm" else (*r[:5], Decimal("10.00"), r[6]) for r in rows]
    got, report = accept_in_chunks(spark.createDataFrame(rows, SCHEMA), "k", ["ts", "id"], "amt", "chk", "start", "lim", day_bucket("ts"), chunk=37, rounds=rounds)
    assert decided(got) == loop(rows)
    assert report["rounds"] <= rounds + 1 and report["chunks"] > 50


def test_calm_keys_are_folded_once(spark):
    rows = rows_of(random.Random(1), "calm", 800, Decimal("900000.00"), 0.1)
    got, report = accept_in_chunks(spark.createDataFrame(rows, SCHEMA), "k", ["ts", "id"], "amt", "chk", "start", "lim", day_bucket("ts"), chunk=50)
    assert decided(got) == loop(rows)
    assert report == {"chunks": 16, "rounds": 1, "refolded_rows": 0, "streamed_rows": 0}


def test_only_hot_keys_are_cut(spark):
    rows = [r for r in mixed(7) if r[1] != 9000]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit("x"))
    got = accept(df, "k", ["ts", "id"], "amt", "chk", "start", "lim", day_bucket("ts"), chunk=300)
    assert decided(got) == loop(rows) and got.columns == [*df.columns, "accepted", "balance_after"]
    assert accept(df.limit(0), "k", ["ts", "id"], "amt", "chk", "start", "lim", day_bucket("ts")).count() == 0
