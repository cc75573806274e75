"""Ranks as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window as W
from pyspark.sql import functions as F


def average_rank(value, *group) -> Column:
    """Ascending 1-based rank within ``group``; ties share their mean rank."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count(F.lit(1)).over(W.partitionBy(*group, value))
    return F.rank().over(W.partitionBy(*group).orderBy(value)) + (ties - 1) / 2


def ordinal_rank(value, tie: str, *group) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.row_number().over(W.partitionBy(*group).orderBy(value, tie))


def random_tie_rank(value: str, tie: str, seed: int, *group) -> Column:
    """Ordinal rank with ties in an order drawn by hash."""
    return F.row_number().over(W.partitionBy(*group).orderBy(value, F.xxhash64(F.col(tie), F.lit(seed)), tie))


def top_and_bottom(frame, value: str, tie: str, n: int, *group, keep: str = "both"):
    """Rows among the ``n`` largest and/or smallest per group, with ``top`` and ``bottom`` places (1-based)."""
    out = frame
    conditions = []
    if keep in ("both", "top"):
        out = out.withColumn("top", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(value), tie)))
        conditions.append(F.col("top") <= n)
    if keep in ("both", "bottom"):
        out = out.withColumn("bottom", F.row_number().over(W.partitionBy(*group).orderBy(F.col(value), tie)))
        conditions.append(F.col("bottom") <= n)
    cond = conditions[0]
    for c in conditions[1:]:
        cond = cond | c
    return out.where(cond)
