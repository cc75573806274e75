"""The frames behind plots: which samples, variables and values are shown, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.distances import silhouette
from ..operators.clusters import top_regulators


def plot_frame(activity: DataFrame | None, expression: DataFrame | None = None, *, variables=None, obs: DataFrame | None = None,
               coordinates: DataFrame | None = None) -> DataFrame:
    """sample, variable, value, with obs columns and coordinates; expression variables get the suffix ``_gExpr`` beside activity."""
    parts = []
    if activity is not None:
        parts.append(activity.select("sample", F.col("feature").alias("variable"), "value"))
    if expression is not None:
        name = F.concat("feature", F.lit("_gExpr")) if activity is not None else F.col("feature")
        parts.append(expression.select("sample", name.alias("variable"), "value", F.col("feature").alias("_f")))
    if variables is not None:
        v = activity or expression
        names = v.sparkSession.createDataFrame([(str(x), n) for n, x in enumerate(dict.fromkeys(variables))], "_v string, position int")
        parts = [p.join(names, (p["_f"] if "_f" in p.columns else p["variable"]) == F.col("_v")).drop("_v") for p in parts]
    parts = [p.drop("_f") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for more in (obs, coordinates):
        if more is not None:
            out = out.join(more, "sample", "left")
    return out


def group_summary(frame: DataFrame, group: str, threshold: float = 0.0) -> DataFrame:
    """group, variable, mean, fraction above the threshold, quartiles: what dot, matrix and violin plots show."""
    return frame.groupBy(group, "variable").agg(
        F.avg("value").alias("mean"), F.avg(F.when(F.col("value") > threshold, 1.0).otherwise(0.0)).alias("fraction"),
        F.percentile("value", 0.25).alias("q1"), F.median("value").alias("median"), F.percentile("value", 0.75).alias("q3"))


def normalized_expression(counts: DataFrame, total: float = 1e4) -> DataFrame:
    """log1p of counts scaled to a common total, if all counts are whole; unchanged otherwise."""
    whole = counts.agg(F.min((F.col("value") == F.floor("value")) & (F.col("value") >= 0))).scalar()
    depth = F.sum("value").over(W.partitionBy("sample"))
    return counts.select("sample", "feature", F.when(whole, F.log1p(F.try_divide(F.col("value") * total, depth))).otherwise(F.col("value")).alias("value"))


def sample_order(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """sample, cluster, position: heatmap columns, cluster by cluster, the most typical first."""
    s = silhouette(vectors, clusters)
    size = s.groupBy("cluster").count()
    start = F.sum("count").over(W.orderBy("cluster").rowsBetween(W.unboundedPreceding, -1))
    first = size.select("cluster", F.coalesce(start, F.lit(0)).alias("first"))
    return s.join(first, "cluster").select("sample", "cluster", (F.col("first") + F.col("place")).alias("position"))


def regulator_rows(m: DataFrame, clusters: DataFrame, n: int = 10, method: str = "stouffer", tops: DataFrame | None = None) -> DataFrame:
    """cluster, feature, total, position: each cluster's top regulators by summed activity."""
    tops = top_regulators(m, clusters, n=n, both=False, method=method) if tops is None else tops
    total = m.join(clusters.toDF("sample", "cluster").select(F.col("sample").cast("string").alias("sample"), F.col("cluster").cast("string").alias("cluster")), "sample")
    total = total.join(tops.select("cluster", "feature"), ["cluster", "feature"]).groupBy("cluster", "feature").agg(F.sum("value").alias("total"))
    return total.withColumn("position", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("total"), "feature")))


def colour_scale(value, limit: float = 10.0):
    """A value's place from 0 to 1 on a diverging scale clipped at the limit."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value)) / (2 * limit) + 0.5


def network_frames(edges: DataFrame, activity: DataFrame, expression: DataFrame, regulators: DataFrame, clusters: DataFrame | None = None):
    """(vertices, edges) of the sub-network of ``regulators``: mean activity or expression per cluster, mean mode per target."""
    keep = edges.join(regulators.select(F.col(regulators.columns[0]).alias("regulator")).distinct(), "regulator", "left_semi")
    sign = keep.groupBy("target").agg(F.avg("mor").alias("mor"))
    both = keep.select(F.col("regulator").alias("id"), F.lit(True).alias("is_regulator")).union(
        keep.select("target", F.lit(False))).groupBy("id").agg(F.max("is_regulator").alias("is_regulator"))

    def means(m: DataFrame, flag: bool) -> DataFrame:
        m = m.withColumn("cluster", F.lit("0")) if clusters is None else m.join(clusters.toDF("sample", "cluster"), "sample")
        return m.groupBy("cluster", "feature").agg(F.avg("value").alias("value")).select("cluster", F.col("feature").alias("id"), "value", F.lit(flag).alias("is_regulator"))

    values = means(activity, True).unionByName(means(expression, False))
    vertices = both.join(values, ["id", "is_regulator"], "left").join(sign, F.col("id") == F.col("target"), "left").select(
        "id", "is_regulator", "cluster", "value", "mor", colour_scale(F.col("value")).alias("colour"))
    return vertices, keep.select(F.col("regulator").alias("src"), F.col("target").alias("dst"), "mor", "likelihood")
