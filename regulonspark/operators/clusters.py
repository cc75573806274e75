"""Cluster statistics with analytic nulls, and the regulators that stand out.

Input is a long matrix (sample, feature, value) and clusters (sample,
cluster). Permutation nulls have closed forms, so nothing is permuted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import mathx
from ..functions.ranks import average_rank, top_and_bottom
from .common import feature_groups


#: Samples up to which a side counts as small for the exact Mann-Whitney test, and the most on the other side.
EXACT, EXACT_OTHER = 8, 10_000


def labelled(m: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """The matrix with a cluster column; one cluster '0' if there are none."""
    if clusters is None:
        return m.withColumn("cluster", F.lit("0"))
    c = clusters.toDF("sample", "cluster").select(F.col("sample").cast("string").alias("sample"), F.col("cluster").cast("string").alias("cluster"))
    return m.join(c, "sample")


def _sums(m: DataFrame, clusters: DataFrame | None) -> DataFrame:
    g = labelled(m, clusters).groupBy("cluster", "feature").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").cast("double").alias("n"))
    w = W.partitionBy("feature")
    return g.select("cluster", "feature", "s", "n", F.sum("s").over(w).alias("st"), F.sum("q").over(w).alias("qt"), F.sum("n").over(w).alias("nt"))


def null_p(score: str, mean: str, sd: str) -> str:
    """SQL of min(1, 2 * cdf((-|score| - mean) / sd))."""
    return f"least(1.0D, 2 * ({mathx.cdf(f'(-abs({score}) - ({mean})) / nullif({sd}, 0)')}))"


def stouffer(m: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """cluster, feature, score, pval: the sum over the root of the count."""
    f = _sums(m, clusters).selectExpr(
        "cluster", "feature", "s / sqrt(n) AS score", "sqrt(n) * st / nt AS mu",
        "sqrt(greatest(qt / nt - (st / nt) * (st / nt), 0) * (nt - n) / nullif(nt - 1, 0)) AS sd")
    return f.select("cluster", "feature", "score", F.expr(null_p("score", "mu", "sd")).alias("pval"))


def mean_diffs(m: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, feature, score, pval: the mean inside minus the mean outside."""
    f = _sums(m, clusters).selectExpr(
        "cluster", "feature", "s / n - try_divide(st - s, nt - n) AS score",
        "sqrt(greatest(qt / nt - (st / nt) * (st / nt), 0) * try_divide(nt * nt, n * (nt - n) * (nt - 1))) AS sd")
    return f.select("cluster", "feature", "score", F.expr(null_p("score", "0", "sd")).alias("pval"))


def median_diffs(m: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, feature, score: the median inside minus the median outside."""
    lab = labelled(m, clusters)
    each = lab.select("cluster").distinct().withColumnRenamed("cluster", "own")
    both = lab.crossJoin(each).groupBy("own", "feature").agg(
        (F.median(F.when(F.col("cluster") == F.col("own"), F.col("value"))) - F.median(F.when(F.col("cluster") != F.col("own"), F.col("value")))).alias("score"))
    return both.select(F.col("own").alias("cluster"), "feature", "score")


@lru_cache(maxsize=256)
def _u_tail(a: int, b: int) -> np.ndarray:
    """Probabilities that U of a and b samples is at least 0, 1, .. a * b, by the count of rank orders."""
    ways = np.zeros(a * b + 1, object)  # whole numbers of any size: nothing is lost where they cancel
    ways[0] = 1
    # the generating function of U: the product of (1 - x^(b + i)) / (1 - x^i)
    for i in range(1, a + 1):
        grown = ways.copy()
        if b + i < len(ways):
            grown[b + i :] -= ways[: -(b + i)]
        for start in range(min(i, len(ways))):
            grown[start::i] = np.cumsum(grown[start::i])
        ways = grown
    return (np.cumsum(ways[::-1])[::-1] / ways.sum()).astype(float)


@F.pandas_udf(DoubleType())
def _exact_p(u: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Two-sided p of the larger U where a side is small, null elsewhere."""
    out = np.full(len(u), np.nan)
    small = np.minimum(a, b)
    for at in np.flatnonzero((small > 0) & (small <= EXACT) & (np.maximum(a, b) <= EXACT_OTHER)):
        x, y = sorted((int(a[at]), int(b[at])))
        out[at] = min(1.0, 2 * _u_tail(x, y)[int(round(max(u[at], x * y - u[at])))])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def mwu(m: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, feature, score (U), pval: two-sided Mann-Whitney.

    Exact where the cluster or the rest has ``EXACT`` samples or fewer (and the other at most
    ``EXACT_OTHER``) and no value is tied, else normal with ties and continuity correction.
    """
    r = labelled(m, clusters).withColumn("r", average_rank("value", "feature"))
    r = r.withColumn("ties", F.count("*").over(W.partitionBy("feature", "value")).cast("double"))
    g = r.groupBy("cluster", "feature").agg(F.sum("r").alias("r1"), F.count("*").cast("double").alias("n1"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    w = W.partitionBy("feature")
    g = g.select("cluster", "feature", "r1", "n1", F.sum("n1").over(w).alias("n"), F.sum("t").over(w).alias("t"))
    g = g.selectExpr("cluster", "feature", "r1 - n1 * (n1 + 1) / 2 AS score", "n1 * (n - n1) AS nn", "n1", "CASE WHEN t = 0 THEN n - n1 ELSE 0 END AS n2",
                     "sqrt(n1 * (n - n1) / 12 * ((n + 1) - try_divide(t, n * (n - 1)))) AS sd")
    z = "(greatest(score, nn - score) - nn / 2 - 0.5D) / nullif(sd, 0)"
    normal = F.expr(f"least(1.0D, 2 * ({mathx.sf(z)}))")
    return g.select("cluster", "feature", "score", F.coalesce(_exact_p("score", "n1", "n2"), normal).alias("pval"))


def closeness(vectors: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """sample, cluster, closeness of every sample to every cluster's centre: 1 - sqrt(1 - correlation)."""
    c = labelled(vectors, clusters).groupBy("cluster", "feature").agg(F.avg("value").alias("centre"))
    j = vectors.join(c, "feature").groupBy("sample", "cluster").agg(F.corr("value", "centre").alias("r"))
    return j.select("sample", "cluster", (1 - F.sqrt(F.greatest(1 - F.col("r"), F.lit(0.0)))).alias("closeness"))


def spearman(m: DataFrame, vectors: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """cluster, feature, score, pval: correlation of a feature's ranks with the closeness to the cluster's centre."""
    r = m.select("sample", "feature", average_rank("value", "feature").alias("r"))
    g = r.join(closeness(vectors, clusters), "sample").groupBy("cluster", "feature").agg(
        F.corr("r", "closeness").alias("score"), F.count("*").cast("double").alias("n"))
    return g.select("cluster", "feature", "score", F.expr(null_p("score", "0", "n / pow(n - 1, 1.5D)")).alias("pval"))


STATISTICS = {"stouffer": stouffer, "mwu": mwu, "mean_diffs": mean_diffs, "spearman": spearman}


def statistic(method: str, m: DataFrame, clusters: DataFrame | None = None, *, vectors: DataFrame | None = None,
              groups: dict[str, DataFrame] | None = None, wanted=None) -> DataFrame:
    """One of ``STATISTICS``, of the features in the ``wanted`` groups (names of ``groups``) if these are given."""
    if method not in STATISTICS:
        raise ValueError(f"statistics are {sorted(STATISTICS)}")
    if wanted is not None:
        m = feature_groups(m, groups or {}, wanted)
    if method == "spearman":
        return spearman(m, m if vectors is None else vectors, clusters)
    return STATISTICS[method](m, clusters)


def top_regulators(m: DataFrame, clusters: DataFrame | None = None, *, n: int = 50, both: bool = True, method: str = "stouffer",
                   vectors: DataFrame | None = None, groups: dict[str, DataFrame] | None = None, wanted=None) -> DataFrame:
    """cluster, feature, score, mark: the n highest (marks n..1) and, if ``both``, the n lowest (marks -1..-n turned: the lowest has -n)."""
    s = statistic(method, m, clusters, vectors=vectors, groups=groups, wanted=wanted).select("cluster", "feature", "score").where("score IS NOT NULL")
    t = top_and_bottom(s, "score", "feature", n, "cluster", keep="both" if both else "top")
    mark = F.when(F.col("top") <= n, n + 1 - F.col("top"))
    if both:
        mark = mark.otherwise(-(n + 1 - F.col("bottom")))
    return t.select("cluster", "feature", "score", mark.cast("int").alias("mark"))


def flag_top(m: DataFrame, tops: DataFrame) -> DataFrame:
    """feature, is_top for every feature of the matrix."""
    t = tops.select("feature").distinct().withColumn("_t", F.lit(True))
    return m.select("feature").distinct().join(t, "feature", "left").select("feature", F.coalesce("_t", F.lit(False)).alias("is_top"))


def only_top(m: DataFrame, tops: DataFrame) -> DataFrame:
    return m.join(tops.select("feature").distinct(), "feature", "left_semi")
