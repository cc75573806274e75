"""Gene-expression signatures: normalisations of a long matrix (sample, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import average_rank

MAD = 1.4826


def scale(m: DataFrame) -> DataFrame:
    """Per feature (value - mean) / standard deviation (n - 1)."""
    per = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return m.join(per, "feature").select("sample", "feature", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")).alias("value"))


def rank(m: DataFrame) -> DataFrame:
    """Average rank within each feature."""
    return m.select("sample", "feature", average_rank("value", "feature").alias("value"))


def _center_scale(m: DataFrame, key: str, center: str, spread: str) -> DataFrame:
    mid = m.groupBy(key).agg((F.median("value") if center == "median" else F.avg("value")).alias("mid"))
    m = m.join(mid, key)
    if spread == "std":
        out = m.groupBy(key).agg(F.stddev_samp("value").alias("spread"))
    else:
        out = m.groupBy(key).agg((MAD * F.median(F.abs(F.col("value") - F.col("mid")))).alias("spread"))
    return m.join(out, key)


def mad(m: DataFrame) -> DataFrame:
    """Per feature (value - median) / (1.4826 median absolute deviation)."""
    c = _center_scale(m, "feature", "median", "mad")
    return c.select("sample", "feature", F.try_divide(F.col("value") - F.col("mid"), F.col("spread")).alias("value"))


def ttest(m: DataFrame) -> DataFrame:
    """t of each sample against all others, from sums per feature."""
    per = m.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    x, n, s, q = (F.col(c) for c in ("value", "n", "s", "q"))
    mean = F.try_divide(s - x, n - 1)
    var = F.try_divide(q - x * x - (n - 1) * mean * mean, n - 2)
    t = F.try_divide(x - mean, F.sqrt(F.greatest(var, F.lit(0.0)) / (n - 1)))
    return m.join(per, "feature").select("sample", "feature", t.alias("value"))


def rank_norm(m: DataFrame, center: str = "median", spread: str = "mad") -> DataFrame:
    """Ranks within each feature, then each sample centred and scaled; infinities and gaps go to the finite extremes."""
    r = rank(m)
    c = _center_scale(r, "sample", center, spread)
    d = F.col("value") - F.col("mid")
    z = c.select("sample", "feature", F.try_divide(d, F.col("spread")).alias("z"), F.signum(d).alias("side"))
    ends = z.agg(F.struct(F.min("z").alias("lo"), F.max("z").alias("hi"))).scalar()
    return z.withColumn("ends", ends).select(
        "sample", "feature",
        F.coalesce("z", F.when(F.col("side") > 0, F.col("ends.hi")).otherwise(F.col("ends.lo"))).alias("value"))


METHODS = {"scale": scale, "rank": rank, "mad": mad, "ttest": ttest, "doublerank": rank_norm}


def signature(m: DataFrame, method: str | None) -> DataFrame:
    if method is None:
        return m
    if method not in METHODS:
        raise ValueError(f"methods are {sorted(METHODS)}")
    return METHODS[method](m)
