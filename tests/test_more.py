"""Scope predicates, edits, shift pairing, sinks and bounded fallbacks on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from retailkit.functions import scope as SC
from retailkit.plans import changes as CH
from retailkit.sources import sinks


def test_scope_predicates(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "C"), (None, "A")], "f STRING, t STRING")
    assert df.filter(SC.either_endpoint("f", "t", "A")).count() == 2
    assert df.filter(SC.scope_with_global("f", "B")).count() == 2
    assert df.filter(SC.strict_scope("f", "cashier", "B")).count() == 1
    assert df.filter(SC.strict_scope("f", "admin", "B")).count() == 3
    assert df.filter(SC.branch_sentinel("f", "All Branches", False)).count() == 3
    assert df.filter(SC.branch_sentinel("f", "Z", False)).count() == 0


def test_fuzzy_pick_ranks_by_pattern_then_id(spark):
    b = spark.createDataFrame([(1, "Alpha North", "Coast"), (2, "Beta", "North Hills"), (3, "Gamma North", "X")],
                              "id LONG, name STRING, location STRING")
    r = SC.fuzzy_pick(b, ["%north%"], ["%gamma%", "%alpha%"]).first()
    assert r["id"] == 3


def test_shift_pairing(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([(1, t(8), "open"), (1, t(12), "close"), (1, t(13), "open"), (1, t(13), "close"),
                                (1, t(20), "open"), (2, t(9), "open")], "user_id LONG, ts TIMESTAMP_NTZ, kind STRING")
    got = sorted((r["user_id"], r["start_time"].hour, r["end_time"].hour if r["end_time"] else None)
                 for r in CH.pair_shift_events(ev).collect())
    assert got == [(1, 8, 12), (1, 13, 13), (1, 20, None), (2, 9, None)]


def test_product_edit_sets_first_key_and_keeps_null_flags(spark):
    p = spark.createDataFrame([(1, "1", {"Main Warehouse": 5, "B1": 2}, True), (2, "2", {}, False)],
                              "id LONG, barcode STRING, stock_levels MAP<STRING,INT>, track_batch BOOLEAN")
    e = spark.createDataFrame([(1, 9, "X", "NEW", None), (2, 4, "Y", None, True)],
                              "id LONG, new_stock INT, new_name STRING, new_barcode STRING, new_track_batch BOOLEAN")
    got = {r["id"]: (r["barcode"], r["stock_key"], r["stock"], r["track_batch"])
           for r in CH.product_edits(p, e).collect()}
    assert got == {1: ("NEW", "Main Warehouse", 11, True), 2: ("2", "Main Warehouse", 4, True)}


def test_monthly_summary_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "summary")
    d = lambda m: dt.date(2024, m, 1)
    a = spark.createDataFrame([(d(1), "x", 1), (d(2), "x", 2)], "month DATE, product STRING, qty INT")
    sinks.write_monthly_summary(a, path)
    sinks.write_monthly_summary(spark.createDataFrame([(d(2), "x", 5)], "month DATE, product STRING, qty INT"), path)
    got = sorted((str(r["month"]), r["qty"]) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", 1), ("2024-02-01", 5)]          # January kept, February replaced


def test_audit_append(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([("Sale", "1", 5, 4)], "action_type STRING, product_barcode STRING, "
                                                        "quantity_before INT, quantity_after INT")
    sinks.append_audit(rows, path)
    sinks.append_audit(rows, path)
    assert spark.read.parquet(path).count() == 2


def _formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_period_filters_reach_the_scan(spark):
    """A period job prunes orders at the Parquet scan on the stored date (row-group skipping)."""
    from retailkit.catalog import queries
    from conftest import SF_SMALL
    plan = _formatted(queries()["rpt09_branch_matrix_range"](spark, SF_SMALL))
    assert "GreaterThan(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_projection_reaches_the_scan(spark):
    """Only the columns a job reads are read from Parquet."""
    from retailkit.catalog import queries
    from conftest import SF_SMALL
    plan = _formatted(queries()["rpt09_branch_matrix"](spark, SF_SMALL))
    schemas = [l for l in plan.splitlines() if l.startswith("ReadSchema: struct<o_")]
    assert schemas and all("o_orderpriority" not in l for l in schemas)
