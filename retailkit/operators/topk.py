"""Ordered limits (TOP-*).

``top_k`` is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: each task keeps its own k best rows and only those
reach the final merge, so nothing unbounded is sorted in one place.

``top_k_per_group`` filters ``row_number() <= k`` over a window; Spark
(>= 3.5) plans a WindowGroupLimit below the shuffle, so each map task
forwards at most k rows per group and a hot group cannot flood a reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_size(asked, most: int, usual: int = 50) -> int:
    """TOP-8: the size of a page: as asked, ``usual`` if nothing (or 0) is asked for, never over ``most``."""
    return min(int(asked or usual), most)


def top_k(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """TOP-1..3/5/6/8: total order expected (add a unique tie-break column)."""
    if offset:
        return df.orderBy(*order).offset(offset).limit(k)
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list, order: list[Column], k: int, rank_col: str = "_rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k).drop(rank_col)


def first_per_group(df: DataFrame, keys: list, order_struct: Column, payload: list[str]) -> DataFrame:
    """row_number() == 1 as an aggregate: ``min_by(payload, ordering)``.

    Being an aggregate, it combines map-side (partial min per task), so a
    key holding a third of the rows still moves one row per task.
    """
    agg = [F.min_by(F.col(c), order_struct).alias(c) for c in payload]
    return df.groupBy(*keys).agg(*agg)
