"""Long-format frames.

matrix: sample, feature, value; network: regulator, target, mor, likelihood;
activity: sample, regulator, nes (and pes). Zeros are data: a matrix has a row
for every cell, see :func:`densify`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

def as_matrix(frame: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    return frame.select(F.col(sample).cast("string").alias("sample"), F.col(feature).cast("string").alias("feature"),
                        F.col(value).cast("double").alias("value"))


def counts_of(frame: DataFrame, samples: DataFrame, sample: str = "sample", feature: str = "feature", count: str = "count") -> DataFrame:
    """sample, feature, count of a long frame that has all of ``samples`` (one column) and no other."""
    counts = frame.select(F.col(sample).cast("string").alias("sample"), F.col(feature).cast("string").alias("feature"), F.col(count).cast("double").alias("count"))
    wanted = samples.select(F.col(samples.columns[0]).cast("string").alias("sample")).distinct()
    odd = counts.select("sample").distinct().join(wanted.withColumn("wanted", F.lit(True)), "sample", "full").where("wanted IS NULL")
    if odd.limit(1).count() or wanted.join(counts, "sample", "left_anti").limit(1).count():
        raise ValueError("the counts are not of the same samples")
    return counts


def from_wide(frame: DataFrame, sample: str) -> DataFrame:
    """One row per cell of a frame with a column per feature."""
    names = [c for c in frame.columns if c != sample]
    # by number, as a feature's name can be anything (a dot in it, or "sample")
    cast = frame.select(F.col(f"`{sample}`").cast("string").alias("_sample"), *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{k}").alias("value")) for k, c in enumerate(names)]))
    return cast.select(F.col("_sample").alias("sample"), cells.alias("cell")).select("sample", "cell.feature", "cell.value")


def from_vectors(frame: DataFrame, sample: str, vector: str) -> DataFrame:
    """One row per element of an array column; features are the positions."""
    return frame.select(F.col(sample).cast("string").alias("sample"), F.posexplode(vector).alias("feature", "value")).select(
        "sample", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"))


def to_wide(matrix: DataFrame, value: str = "value", row: str = "sample", column: str = "feature", columns=None) -> DataFrame:
    return matrix.groupBy(row).pivot(column, columns).agg(F.first(value))


def densify(matrix: DataFrame, fill: float = 0.0) -> DataFrame:
    """The matrix with a row for every sample and feature that occur in it.

    The cells are samples times features by nature, as many as the result has rows.
    """
    matrix = written(matrix, "matrix")
    samples, features = matrix.select("sample").distinct(), matrix.select("feature").distinct()
    cells = samples.crossJoin(features)
    return cells.join(matrix, ["sample", "feature"], "left").select(
        "sample", "feature", F.coalesce("value", F.lit(fill)).alias("value"))


def only(frame: DataFrame, column: str, names: DataFrame, anti: bool = False) -> DataFrame:
    """Rows whose ``column`` is (not) among ``names`` (one column, duplicates allowed)."""
    keys = names.select(F.col(names.columns[0]).alias(column))
    return frame.join(keys, column, "left_anti" if anti else "left_semi")


def names_frame(spark, names) -> DataFrame:
    if isinstance(names, DataFrame):
        return names
    return spark.createDataFrame([(str(n),) for n in names], "name string")


def feature_groups(matrix: DataFrame, groups: dict[str, DataFrame], wanted) -> DataFrame:
    """The matrix's rows whose feature is in any wanted group; aliases as in ``GROUPS``."""
    keys = [GROUPS.get(str(w).lower()) for w in ([wanted] if isinstance(wanted, str) else wanted)]
    if None in keys or any(k not in groups for k in keys):
        raise ValueError(f"feature groups are {sorted(set(GROUPS))}")
    names = groups[keys[0]]
    for k in keys[1:]:
        names = names.union(groups[k])
    return only(matrix, "feature", names)


GROUPS = {"tf": "tfs", "tfs": "tfs", "cotf": "cotfs", "cotfs": "cotfs", "sig": "sig", "sigs": "sig", "surf": "surf", "surfs": "surf"}
