"""Registered streaming jobs: each runs its stream to completion (availableNow) over a file
stream of the supplied tables and returns the sink; the oracle is the batch SQL of the same
report, all windows and days included."""

from __future__ import annotations

from retailkit.catalog import REGISTRY, job
from retailkit.streaming import jobs as J


def _sql_of(name: str) -> str:
    return REGISTRY[name][1]


@job("str01_hourly_sales", """
SELECT date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
       COALESCE(store_location, 'Main Branch') AS branch, COUNT(*) AS transactions,
       CAST(SUM(total_amount) AS DECIMAL(18,2)) AS revenue
FROM sales WHERE LOWER(status) = 'completed' GROUP BY 1, 2, 3""")
def str01_hourly_sales(spark, d):
    return J.run_hourly_sales(spark, d)


def _register_twins():
    # the streamed results must equal the batch jobs' results: reuse their oracle SQL verbatim
    pairs = {"str02_stock_after_stream": ("chg01_stock_after_sales", J.run_stock_deltas),
             "str03_credit_decisions": ("win11_credit_decisions", J.run_credit_decisions),
             "str04_shift_sales": ("jn05_shift_sales", J.run_shift_attribution)}
    for name, (twin, fn) in pairs.items():
        if name not in REGISTRY:
            REGISTRY[name] = (fn, _sql_of(twin))


_register_twins()
