"""p-values of scores and their false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import mathx


def bh(frame: DataFrame, p: str, *group: str, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within each group: the running least of p * m / rank from the largest p down."""
    m = F.count(p).over(W.partitionBy(*group))
    up = F.row_number().over(W.partitionBy(*group).orderBy(F.col(p).asc_nulls_last()))
    f = frame.withColumn("_r", up).withColumn("_q", F.col(p) * m / F.col("_r"))
    least = F.min("_q").over(W.partitionBy(*group).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0))
    return f.withColumn(out, F.least(least, F.lit(1.0))).drop("_r", "_q")


def to_pvalues(frame: DataFrame, value: str = "nes", *, two_sided: bool = True, adjust: bool = True, along: str = "sample",
               neg_log: bool = False, pseudocount: float = 1e-300, out: str = "pval") -> DataFrame:
    """``frame`` with p-values of normal scores, adjusted within ``along`` (sample or regulator), or their negative logarithms."""
    p = f"2 * ({mathx.sf(f'abs({value})')})" if two_sided else mathx.sf(value)
    f = frame.withColumn(out, F.expr(f"least({p}, 1.0D)"))
    if adjust:
        f = bh(f, out, along, out="_fdr").withColumn(out, F.col("_fdr")).drop("_fdr")
    return f.withColumn(out, -F.log10(F.col(out) + F.lit(pseudocount))) if neg_log else f
