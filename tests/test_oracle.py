"""Every registered job equals its DuckDB oracle on the smallest supplied tables.

(The driver runs the same comparison at sf0.01; ``tools_check.py`` does it locally.)
"""

import pytest

from retailkit.catalog import oracle_sql, queries
from retailkit.check import compare

from conftest import SF_SMALL

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_job_matches_oracle(spark, duck_small, name):
    df = queries()[name](spark, SF_SMALL)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    r = compare(df, duck_small, ORACLE[name])
    assert r["columns_match"], r
    assert r["match"], r


def test_every_job_has_an_oracle():
    assert set(queries()) == set(ORACLE)


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["branch", "txn_count", "revenue"]
    assert df.count() > 0
    assert set(queries()) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def test_bench_headline_jobs_are_registered():
    import bench
    assert set(bench.HEADLINE) <= set(queries())
    assert len(bench.HEADLINE) == len(set(bench.HEADLINE))
