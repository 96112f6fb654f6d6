"""Column-returning helpers for the scalar rules of the reference (FN-*).

All of these build Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIN_BRANCH = "Main Branch"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("date")


def lit_ts(d) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("timestamp_ntz")


def dec(v: str, p: int = 10, s: int = 2) -> Column:
    """Exact decimal literal (a Python float would become a DOUBLE)."""
    return F.lit(str(v)).cast(f"decimal({p},{s})")


# -- money and ratios (value-stable across engines) --------------------------
def money(c) -> Column:
    return col(c).cast("decimal(18,2)")


def money_sum(c, zero: bool = False) -> Column:
    s = F.sum(col(c))
    if zero:
        s = F.coalesce(s, F.lit(0))
    return s.cast("decimal(18,2)")


def ratio(c, places: int = 4) -> Column:
    """Ratios are compared as rounded doubles (decimal division types differ by engine)."""
    return F.round(col(c).cast("double"), places)


def safe_div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# -- dates and periods (FN-12, FN-13, FN-16, FLT-8/9/13) ---------------------
def day_end_inclusive(d) -> Column:
    """``d + 1 day - 1 second`` as a timestamp: the reference's inclusive end."""
    return F.timestamp_add("SECOND", F.lit(-1), F.timestamp_add("DAY", F.lit(1), lit_date(d).cast("timestamp_ntz")))


def month_start(d) -> Column:
    return F.trunc(lit_date(d), "month")


def year_start(d) -> Column:
    return F.trunc(lit_date(d), "year")


def prev_month_range(year: int, month: int) -> tuple[_dt.date, _dt.date]:
    start = _dt.date(year, month, 1)
    nxt = _dt.date(year + (month == 12), month % 12 + 1, 1)
    return start, nxt


# -- nested items (AGG-2, FN-28) ---------------------------------------------
def items_gross(items="items") -> Column:
    """Σ qty·price over the nested item array, computed inside the row."""
    return F.aggregate(col(items), F.lit(0).cast("decimal(20,2)"),
                       lambda acc, i: (acc + i["qty"] * i["price"]).cast("decimal(20,2)"))


def return_sign(is_return="is_return") -> Column:
    return F.when(col(is_return), F.lit(-1)).otherwise(F.lit(1))


def branch_label(c="store_location") -> Column:
    return F.coalesce(col(c), F.lit(MAIN_BRANCH))


# -- map columns (JN-11, JN-24, FN-21..26) -----------------------------------
def map_get(m, key) -> Column:
    return F.try_element_at(col(m), key if isinstance(key, Column) else F.lit(key))


def map_get0(m, key) -> Column:
    """Missing key means 0 (the reference's COALESCE(map->>k,'0'))."""
    return F.coalesce(map_get(m, key), F.lit(0))


def map_total(m) -> Column:
    """Σ map values, NULL values counted as 0 (FN-23)."""
    return F.aggregate(F.map_values(col(m)), F.lit(0).cast("long"),
                       lambda acc, v: acc + F.coalesce(v, F.lit(0)).cast("long"))


def map_add(m, delta) -> Column:
    """jsonb_set(m, k, old + n) for every key of ``delta`` (FN-21)."""
    base, d = (F.coalesce(col(x).cast("map<string,bigint>"), F.create_map().cast("map<string,bigint>")) for x in (m, delta))
    return F.map_zip_with(base, d, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def map_clamp_negative(m) -> Column:
    """FN-24: negative entries set to 0."""
    return F.transform_values(col(m), lambda k, v: F.greatest(v, F.lit(0)))


def map_has_negative(m) -> Column:
    """FLT-17: EXISTS a negative value in the map."""
    return F.exists(F.map_values(col(m)), lambda v: v < 0)


def map_lookup_alias(m, keys, zero_is_missing: bool = False) -> Column:
    """JN-24: first alias key that has a value; the ``||`` variant treats 0 as missing (T12)."""
    vals = []
    for k in keys:
        v = map_get(m, k)
        vals.append(F.nullif(v, F.lit(0)) if zero_is_missing else v)
    return F.coalesce(*vals, F.lit(0))


def map_key_ci(m, key) -> Column:
    """FN-25: the map key equal to ``key`` ignoring case (first in key order)."""
    k = key if isinstance(key, Column) else F.lit(key)
    return F.try_element_at(F.filter(F.array_sort(F.map_keys(col(m))), lambda x: F.upper(x) == F.upper(k)), F.lit(1))


# -- stock and expiry (FLT-14/15, FN-14/15) ----------------------------------
def low_stock_le(stock="stock", level="reorder_level") -> Column:
    """FLT-14: COALESCE(stock,0) <= COALESCE(reorder_level,10)."""
    return F.coalesce(col(stock), F.lit(0)) <= F.coalesce(col(level), F.lit(10))


def low_stock_lt(stock="stock", level="reorder_level", default_level: bool = True) -> Column:
    """FLT-15: strict form; without the default a NULL level drops the row."""
    lv = F.coalesce(col(level), F.lit(10)) if default_level else col(level)
    return col(stock) < lv


def days_to(d, as_of) -> Column:
    return F.datediff(col(d), lit_date(as_of))


def expiry_status(expiry="expiry_date", as_of=None) -> Column:
    """FN-15: Expired / Expiring Soon (<=7 d) / Near Expiry (<=30 d) / OK; NULL -> OK."""
    d = days_to(expiry, as_of)
    return (F.when(col(expiry).isNull(), F.lit("OK"))
            .when(col(expiry) < lit_date(as_of), F.lit("Expired"))
            .when(d <= 7, F.lit("Expiring Soon"))
            .when(d <= 30, F.lit("Near Expiry"))
            .otherwise(F.lit("OK")))


# -- text (FN-3, FN-7, FN-29) -------------------------------------------------
def action_label(c) -> Column:
    """FN-29: underscores to spaces, first letter of each word upper-cased, rest kept."""
    words = F.split(F.regexp_replace(col(c), "_", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                               w.substr(F.lit(2), F.length(w)))), " ")
