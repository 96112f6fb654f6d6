"""Text-to-value rules of the spreadsheet upload, as Column expressions (FN-7, FN-8, FN-9).

No Python UDF: every rule is a Catalyst expression, so parsing a file of
any size stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailkit.functions.exprs import col


def js_parse_int(c) -> Column:
    """``parseInt``: optional spaces and sign, then leading digits; anything else -> NULL (NaN)."""
    s = F.regexp_extract(col(c), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(s == "", F.lit(None).cast("long")).otherwise(s.cast("long"))


def js_parse_float(c) -> Column:
    """``parseFloat``: the longest numeric prefix (sign, digits, optional fraction); else NULL."""
    s = F.regexp_extract(F.ltrim(col(c)), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.cast("double"))


def clean_num(c) -> Column:
    """FN-7: drop everything but digits, '.', '-', then parseFloat; failure or 0 -> 0.

    'GHS 10.00' -> 10.0, '₵5' -> 5.0, '1,000' -> 1000.0, 'abc' -> 0, '-3' -> -3.0, '' -> 0.
    """
    stripped = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"[^0-9.\-]", "")
    return F.coalesce(js_parse_float(stripped), F.lit(0.0))


def flexible_date(c) -> Column:
    """FN-9: day/month/year in any order with '/', '-' or '.' separators.

    The first separator found ('/', then '-', then '.') splits the text into
    three integers p0, p1, p2.  A part above 31 is the year; a part above 12
    must be the day; two-digit years pivot at 50 (49 -> 2049, 50 -> 1950).
    Day overflow rolls into the next month as a JS Date does; the result is a
    pure date (no time zone shift, T22).  Anything else gives NULL.
    """
    t = F.trim(col(c).cast("string"))
    sep = (F.when(t.contains("/"), F.lit("/")).when(t.contains("-"), F.lit("-"))
           .when(t.contains("."), F.lit(".")))

    def parts_of(v):
        parts = F.split(v["t"], F.concat(F.lit("["), v["sep"], F.lit("]")))
        ints = F.transform(parts, lambda x: js_parse_int(x))
        return F.struct((v["sep"].isNotNull() & (F.size(parts) == 3)).alias("ok"),
                        F.try_element_at(ints, F.lit(1)).alias("p0"), F.try_element_at(ints, F.lit(2)).alias("p1"),
                        F.try_element_at(ints, F.lit(3)).alias("p2"))

    def pick(a, b, c_):
        return F.struct(a.alias("y"), b.alias("m"), c_.alias("d"))

    def order_of(v):
        p0, p1, p2 = v["p0"], v["p1"], v["p2"]
        ymd = (F.when(p0 > 31, F.when(p1 > 12, pick(p0, p2, p1)).otherwise(pick(p0, p1, p2)))
               .when(p2 > 31, F.when(p0 > 12, pick(p2, p1, p0)).when(p1 > 12, pick(p2, p0, p1))
                     .otherwise(pick(p2, p1, p0)))
               .when((p0 > 12) & (p1 <= 12) & (p2 <= 31), pick(p0, p1, p2))
               .when((p1 > 31) | ((p1 > 12) & (p0 <= 12) & (p2 <= 31)), pick(p1, p2, p0))
               .when((p2 > 31) | (p2 > 0),
                     F.when(p0 > 12, pick(p2, p1, p0)).when(p1 > 12, pick(p2, p0, p1)).otherwise(pick(p2, p1, p0))))
        ok = v["ok"] & p0.isNotNull() & p1.isNotNull() & p2.isNotNull()
        return F.when(ok, ymd)

    def date_of(v):
        y, m, d = v["y"], v["m"], v["d"]
        valid = v.isNotNull() & (y != 0) & (d >= 1) & (d <= 31) & (m >= 1) & (m <= 12)
        year = F.when(y < 100, F.when(y < 50, y + 2000).otherwise(y + 1900)).otherwise(y)
        return F.when(valid, F.date_add(F.make_date(year.cast("int"), m.cast("int"), F.lit(1)), (d - 1).cast("int")))

    # each stage is bound once (a one-element transform acts as a let), so the split and the
    # integer parsing run once per value instead of once per CASE branch that mentions them
    v = _let(F.struct(t.alias("t"), sep.alias("sep")), parts_of)
    v = _let(v, order_of)
    return _let(v, date_of)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def spreadsheet_serial(n) -> Column:
    """Numeric cells: days since 1900-01-01 minus 2 (the spreadsheet leap-year quirk)."""
    return F.date_add(F.lit("1900-01-01").cast("date"), (col(n) - 2).cast("int"))


def _norm(k: str) -> str:
    return re.sub(r"[^a-z0-9]", "", k.lower())


def find_column(columns: list[str], patterns: list[str]) -> str | None:
    """FN-8: first pattern (in order) whose normalised text is contained in a normalised header.

    Runs once on the driver over the header names (schema metadata), never per row.
    'contains' matching means 'name' can hit 'supplier name' (T17) -- kept as in the reference.
    """
    keys = [k.strip().lower() for k in columns]
    for p in patterns:
        np_ = _norm(p)
        for orig, k in zip(columns, keys):
            if np_ in _norm(k):
                return orig
    return None
