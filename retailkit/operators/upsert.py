"""Set-based upsert of a snapshot table (the reference's INSERT ... ON CONFLICT).

Parquet tables have no row-level MERGE, so an upsert is a full outer join
of the current snapshot with the change rows on the key, written to a new
path.  Policies (SURVEY §2.10):

* ``ignore``      keep the existing row, insert only new keys;
* ``overwrite``   the change row replaces the existing one;
* ``add``         ``add_cols`` are summed, ``keep_cols`` keep the existing row's value (NULL too), other columns are
                  overwritten when the change has a value;
* ``keep_if_null``every column: change value unless it is NULL;
* ``partial``     only ``set_cols`` are overwritten.

Changes must be unique per key (aggregate them first); the join is a
shuffle on the key (or a broadcast when Spark's size check allows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("ignore", "overwrite", "add", "keep_if_null", "partial")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], policy: str,
           add_cols: tuple = (), set_cols: tuple = (), keep_cols: tuple = ()) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    t = target.withColumn("_t", F.lit(True))
    c = changes.withColumn("_c", F.lit(True))
    cols = [x for x in target.columns if x not in keys]
    tt = t.select(*keys, "_t", *[F.col(x).alias(f"_t_{x}") for x in cols])
    cc = c.select(*keys, "_c", *[F.col(x).alias(f"_c_{x}") for x in cols if x in changes.columns])
    j = tt.join(cc, keys, "full_outer")
    has_t, has_c = F.col("_t").isNotNull(), F.col("_c").isNotNull()
    out = []
    for x in cols:
        tv = F.col(f"_t_{x}")
        cv = F.col(f"_c_{x}") if x in changes.columns else F.lit(None).cast(target.schema[x].dataType)
        if policy == "ignore":
            v = F.when(has_t, tv).otherwise(cv)
        elif policy == "overwrite":
            v = F.when(has_c, cv).otherwise(tv)
        elif policy == "add":
            if x in add_cols:
                v = F.when(has_t & has_c, F.coalesce(tv, F.lit(0)) + F.coalesce(cv, F.lit(0))) \
                     .when(has_c, cv).otherwise(tv)
            elif x in keep_cols:
                v = F.when(has_t, tv).otherwise(cv)
            else:
                v = F.when(has_c, F.coalesce(cv, tv)).otherwise(tv)
        elif policy == "keep_if_null":
            v = F.coalesce(cv, tv)
        else:  # partial
            v = F.when(has_c, cv).otherwise(tv) if x in set_cols else F.when(has_t, tv).otherwise(cv)
        out.append(v.cast(target.schema[x].dataType).alias(x))
    action = F.when(has_t & has_c, "update").when(has_c, "insert").otherwise("keep")
    return j.select(*keys, *out, action.alias("_action"))
