"""Header + lines documents (SRC-6, JN-21, JN-25).

Lines are collected per header key with ``collect_list(struct)`` (one
shuffle on the key; a document's lines are one row by the data model) and
sorted for a deterministic order; headers without lines get an empty array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(headers: DataFrame, lines: DataFrame, key: str, name: str, order: list[str] | None = None) -> DataFrame:
    cols = [c for c in lines.columns if c != key]
    fields = (order or []) + [c for c in cols if c not in (order or [])]
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    elem = g.schema[name].dataType
    j = headers.join(g, key, "left")
    return j.withColumn(name, F.coalesce(F.col(name), F.array().cast(elem)))
