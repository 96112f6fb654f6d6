"""Rename chains against the edits applied one after the other."""

import random

from retailkit.operators import chains


def test_renames_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(chains, "BUCKET", 16)
    rnd = random.Random(30)
    codes = [f"c{i}" for i in range(60)]
    edits = [(rnd.choice(codes[:20] if i % 3 else codes), rnd.choice(codes), i) for i in range(300)]
    edits += [("A", "B", 1000), ("B", "C", 1001), ("x", "y", 1003), ("z", "x", 1004), ("P", "Q", 1010), ("Q", "P", 1011), ("same", "same", 1020), (None, "n", 1030), ("n", None, 1031)]
    edits += [(f"L{i}", f"L{i + 1}", 2000 + i) for i in range(100)]                    # one chain of 100
    rows = [(c, i) for i, c in enumerate([*codes, "A", "B", "C", "x", "z", "P", "Q", "same", "n", "L0", "L50", "never", None])]
    want = {i: c for c, i in rows}
    for old, new, _ in sorted(edits, key=lambda e: e[2]):
        if old is not None and new is not None:
            want = {i: new if c == old else c for i, c in want.items()}
    rnd.shuffle(edits)
    renames = spark.createDataFrame(edits, "old string, new string, seq long")
    got = chains.rename_all(spark.createDataFrame(rows, "code string, id long"), "code", renames)
    assert got.columns == ["code", "id"] and {r.id: r.code for r in got.collect()} == want
    assert chains.rename_all(spark.createDataFrame(rows, "code string, id long"), "code", renames.limit(0)).count() == len(rows)
    hops = {r.old: r.hops for r in chains.last_names(renames).collect()}
    assert hops["L0"] == 100 and hops["A"] == 2 and hops["z"] == 1
