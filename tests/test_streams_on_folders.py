"""Streams over tables of several part files, in several micro-batches out of time order, equal the batch reports."""

import os

import pytest
from pyspark.sql import functions as F

from retailkit import session
from retailkit.check import compare, duck
from retailkit.catalog import oracle_sql
from retailkit.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with orders and events as folders of four part files, newest rows first."""
    d = tmp_path_factory.mktemp("parts")
    for f in os.listdir(SF):
        if f not in ("orders.parquet", "events.parquet"):
            os.symlink(f"{SF}/{f}", d / f)
    for t, by in (("orders", "o_orderdate"), ("events", "ts")):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        q = df.withColumn("_part", F.ntile(4).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(F.col(by).desc())))
        for i in range(1, 5):
            q.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(str(d / f"{t}.parquet"))
    return str(d)


@pytest.mark.parametrize("name,run", [("str01_hourly_sales", J.run_hourly_sales), ("str02_stock_after_stream", J.run_stock_deltas),
                                      ("str03_credit_decisions", J.run_credit_decisions), ("str04_shift_sales", J.run_shift_attribution)])
def test_streams_over_part_files(spark, folder, name, run):
    out = compare(run(spark, folder, 1), duck(SF), oracle_sql()[name])
    assert out["match"] and out["spark_rows"] > 0, out


def test_missing_table_is_an_error(spark, tmp_path):
    (tmp_path / "orders.parquet").mkdir()
    with pytest.raises(FileNotFoundError):
        J.stream_table(spark, str(tmp_path), "orders")


class _Fake:
    class conf:
        get = staticmethod(lambda k, d=None: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(_Fake)


def test_named_folder_is_kept(spark):
    assert session.ensure_checkpoint_dir(spark) == session.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before
