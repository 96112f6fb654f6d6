"""Registered text-rule jobs: the upload parsers applied to text that Spark derives from the
line table, checked against an independent SQL implementation of the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailkit.catalog import job, Retail
from retailkit.functions.parse import clean_num, flexible_date


def _date_texts(r: Retail):
    l = r.raw("lineitem")
    d = F.col("l_shipdate")
    fmt = (F.when(F.col("l_linenumber") % 4 == 0, F.date_format(d, "dd/MM/yyyy"))
           .when(F.col("l_linenumber") % 4 == 1, F.date_format(d, "MM-dd-yy"))
           .when(F.col("l_linenumber") % 4 == 2, F.date_format(d, "yyyy.MM.dd"))
           .otherwise(F.date_format(d, "d.M.yy")))
    return l.select("l_orderkey", "l_linenumber", fmt.alias("text"))


P = "regexp_extract(parts[{i}], '^\\s*([+-]?[0-9]+)', 1)"


def _pi(i):
    return f"CASE WHEN {P.format(i=i)} = '' THEN NULL ELSE CAST({P.format(i=i)} AS BIGINT) END"


@job("fn09_flexible_dates", f"""
WITH t AS (SELECT l_orderkey, l_linenumber,
                  CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y')
                                        WHEN 1 THEN strftime(l_shipdate, '%m-%d-%y')
                                        WHEN 2 THEN strftime(l_shipdate, '%Y.%m.%d')
                                        ELSE strftime(l_shipdate, '%-d.%-m.%y') END AS text FROM lineitem),
s AS (SELECT *, string_split(trim(text), CASE WHEN contains(text, '/') THEN '/' WHEN contains(text, '-') THEN '-'
                                              WHEN contains(text, '.') THEN '.' END) AS parts FROM t),
q AS (SELECT l_orderkey, l_linenumber, text, len(parts) AS n, {_pi(1)} AS p0, {_pi(2)} AS p1, {_pi(3)} AS p2 FROM s),
r AS (SELECT *, CASE
        WHEN p0 > 31 THEN CASE WHEN p1 > 12 THEN [p0, p2, p1] ELSE [p0, p1, p2] END
        WHEN p2 > 31 THEN CASE WHEN p0 > 12 THEN [p2, p1, p0] WHEN p1 > 12 THEN [p2, p0, p1] ELSE [p2, p1, p0] END
        WHEN p0 > 12 AND p1 <= 12 AND p2 <= 31 THEN [p0, p1, p2]
        WHEN p1 > 31 OR (p1 > 12 AND p0 <= 12 AND p2 <= 31) THEN [p1, p2, p0]
        WHEN p2 > 31 OR p2 > 0 THEN CASE WHEN p0 > 12 THEN [p2, p1, p0] WHEN p1 > 12 THEN [p2, p0, p1]
                                         ELSE [p2, p1, p0] END END AS ymd FROM q)
SELECT l_orderkey, l_linenumber, text,
       CASE WHEN n = 3 AND p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND ymd IS NOT NULL
             AND ymd[1] <> 0 AND ymd[2] BETWEEN 1 AND 12 AND ymd[3] BETWEEN 1 AND 31
            THEN make_date(CAST(CASE WHEN ymd[1] < 100 THEN CASE WHEN ymd[1] < 50 THEN ymd[1] + 2000
                                                                 ELSE ymd[1] + 1900 END
                                     ELSE ymd[1] END AS INTEGER), CAST(ymd[2] AS INTEGER), 1)
                 + CAST(ymd[3] - 1 AS INTEGER) END AS parsed
FROM r""")
def fn09_flexible_dates(spark, d):
    t = _date_texts(Retail(spark, d))
    return t.select("l_orderkey", "l_linenumber", "text", flexible_date("text").alias("parsed"))


@job("fn07_clean_numbers", """
WITH t AS (SELECT l_orderkey, l_linenumber,
                  CASE l_linenumber % 4 WHEN 0 THEN 'GHS ' || printf('%.2f', l_extendedprice)
                                        WHEN 1 THEN '₵' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                                        WHEN 2 THEN format('{:,.2f}', l_extendedprice)
                                        ELSE 'n/a ' || CAST(l_linenumber AS VARCHAR) || '-x' END AS text
           FROM lineitem),
c AS (SELECT *, regexp_replace(text, '[^0-9.\\-]', '', 'g') AS stripped FROM t),
p AS (SELECT *, regexp_extract(ltrim(stripped), '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) AS num FROM c)
SELECT l_orderkey, l_linenumber, text, COALESCE(CASE WHEN num = '' THEN NULL ELSE CAST(num AS DOUBLE) END, 0.0)
         AS value
FROM p""")
def fn07_clean_numbers(spark, d):
    l = Retail(spark, d).raw("lineitem")
    text = (F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("GHS "), F.format_string("%.2f", "l_extendedprice")))
            .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("₵"), F.col("l_quantity").cast("int").cast("string")))
            .when(F.col("l_linenumber") % 4 == 2, F.format_number("l_extendedprice", 2))
            .otherwise(F.concat(F.lit("n/a "), F.col("l_linenumber").cast("string"), F.lit("-x"))))
    t = l.select("l_orderkey", "l_linenumber", text.alias("text"))
    return t.select("l_orderkey", "l_linenumber", "text", clean_num("text").alias("value"))
