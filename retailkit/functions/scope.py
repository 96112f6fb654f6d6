"""Branch scope predicates (FLT-1..5, FLT-7, FLT-19) as Columns or small frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailkit.functions.exprs import col

ALL_BRANCHES = "All Branches"
UNRESTRICTED_ROLES = ("admin", "ceo")


def strict_scope(c, role: str, store: str | None) -> Column:
    """FLT-1: non-admin, non-CEO viewers with a branch see only their branch's rows."""
    if role in UNRESTRICTED_ROLES or not store:
        return F.lit(True)
    return col(c) == F.lit(store)


def scope_with_global(c, branch) -> Column:
    """FLT-2: the branch's rows plus global rows (NULL branch)."""
    return (col(c) == F.lit(branch)) | col(c).isNull()


def either_endpoint(from_col, to_col, branch) -> Column:
    """FLT-3: transfers that leave from or arrive at the branch."""
    return (col(from_col) == F.lit(branch)) | (col(to_col) == F.lit(branch))


def branch_sentinel(c, branch: str | None, known) -> Column:
    """FLT-5: 'All Branches' or no branch -> no filter; an unresolved branch -> no rows (1=0).

    ``known`` is a bool or a boolean Column (e.g. from a one-row resolution frame crossed in)."""
    if not branch or branch == ALL_BRANCHES:
        return F.lit(True)
    k = known if isinstance(known, Column) else F.lit(bool(known))
    return k & (col(c) == F.lit(branch))


def all_of(preds: list[Column]) -> Column:
    """FLT-11: optional predicates appended one by one."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def contains_ci(c, text: str) -> Column:
    """FLT-19: case-insensitive substring search."""
    return F.lower(col(c)).contains(text.lower())


def fuzzy_pick(branches: DataFrame, patterns: list[str], ranking: list[str]) -> DataFrame:
    """FLT-7: branches whose name or location ILIKE any pattern, ranked by the first ranking pattern
    the name matches (then id), first row only."""
    hit = reduce(lambda a, b: a | b, [F.col("name").ilike(p) | F.col("location").ilike(p) for p in patterns])
    rank = None
    for i, p in enumerate(ranking, start=1):
        rank = F.when(F.col("name").ilike(p), i) if rank is None else rank.when(F.col("name").ilike(p), i)
    rank = rank.otherwise(len(ranking) + 1)
    return branches.filter(hit).orderBy(rank.asc(), F.col("id").asc()).limit(1).select("id", "name", "location")
