"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches given as ``{column: python list}``; one batch in memory at a time."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield record_batch([out[n] for n in names], schema)

    return df.mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def record_batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=ARROW[t]) for c, (_, t) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared checkpoint folder (every executor sees it)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df``, written and read again, with a broadcast hint if it has at most ``rows`` rows; beyond, Spark joins it by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
