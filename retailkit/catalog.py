"""Registry of runnable jobs: name -> (Spark callable, oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a flat DataFrame
(no arrays or maps, so results compare row by row).  The oracle SQL runs
in DuckDB over the same supplied tables through ``retailkit.oracle``.
Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retailkit.oracle import with_views
from retailkit.sources.adapter import SALES_AS_OF, EVENTS_AS_OF, STOCK_KEYS, Retail

Job = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Job, str | None]] = {}


def job(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"duplicate job {name}")
        REGISTRY[name] = (fn, with_views(sql) if sql else None)
        return fn
    return deco


def queries() -> dict[str, Job]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load():
    # Importing the job modules fills REGISTRY.
    from retailkit.plans import jobs_sales, jobs_stock, jobs_credit, jobs_tax, jobs_ops, jobs_rules  # noqa: F401
    from retailkit.plans import jobs_more, jobs_extra, jobs_ingest, jobs_reports, jobs_stored, jobs_statements, jobs_postings, jobs_viewers, jobs_identity  # noqa: F401
    from retailkit.plans import jobs_stream  # noqa: F401  (reuses the oracle SQL registered above)


__all__ = ["job", "queries", "oracle_sql", "Retail", "SALES_AS_OF", "EVENTS_AS_OF", "STOCK_KEYS"]
