"""Side-by-side check of a Spark job against its DuckDB oracle.

Mirrors the driver's gate: same row count, same column names, and the
same multiset of rows once columns are sorted by name.  Values are
normalised by type (decimals by their digits, floats rounded to 9
significant places) so that only real differences count.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("D", str(v.normalize()) if v != 0 else "0")
    if isinstance(v, float):
        if math.isnan(v):
            return ("F", "nan")
        return ("F", float(f"{v:.9g}"))
    if isinstance(v, int):
        return ("I", v)
    if isinstance(v, dt.datetime):
        return ("T", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("T", dt.datetime(v.year, v.month, v.day).isoformat()) if False else ("Dt", v.isoformat())
    return ("S", str(v))


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "columns_match": sorted(s_cols) == sorted(o_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, o_cols
        out["match"] = False
        return out
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_o = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    cs = Counter(tuple(_norm(r[i]) for i in order_s) for r in s_rows)
    co = Counter(tuple(_norm(r[i]) for i in order_o) for r in o_rows)
    out["match"] = cs == co
    if not out["match"]:
        out["only_spark"] = list((cs - co).elements())[:3]
        out["only_oracle"] = list((co - cs).elements())[:3]
    return out
