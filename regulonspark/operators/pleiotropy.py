"""Pleiotropy correction: targets shared with a regulator that explains them better lose likelihood.

Per sample, among regulators with significant activity, every ordered pair
that shares enough targets is tested on the shared ones; the dominated
regulator's shared likelihoods are divided by a penalty and its activity is
scored again. Pairs are a join of the edges on the target; the tests are
aggregations over it. Nothing is collected per sample. The steps are tables. Each
sample is taken to have all features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.ranks import average_rank
from ..sources.store import written
from .enrichment import ranked
from .network import Network


def candidates(activity: DataFrame, regulators: float = 0.05) -> DataFrame:
    """sample, regulator, nes of significant regulators (a p-value), or of the strongest (a number); composite names are left out."""
    a = activity.where(~F.col("regulator").contains("--"))
    if regulators < 1:
        a = a.where(F.expr(f"2 * ({mathx.sf('abs(nes)')})") < regulators)
    else:
        place = F.row_number().over(W.partitionBy("sample").orderBy(F.desc(F.abs("nes")), "regulator"))
        a = a.withColumn("place", place).where(F.col("place") <= int(regulators))
    n = F.count("*").over(W.partitionBy("sample"))
    return a.withColumn("n", n).where("n >= 2").select("sample", "regulator", "nes")


def correct(matrix: DataFrame, activity: DataFrame, net: Network, *, regulators: float = 0.05, shadow: float = 0.05, targets: int = 10,
            penalty: float = 20.0, method: str = "adaptive", min_size: int = 5) -> DataFrame:
    """``activity`` (sample, regulator, nes) with the scores of dominated regulators replaced."""
    edges = written(net.filter_targets(keep=matrix.select("feature").distinct()).edges, "edges")
    cand = written(candidates(activity, regulators), "candidates")
    matrix = written(matrix.select("sample", "feature", "value"), "values")
    # values of each candidate's own targets, ranked among them
    own = cand.join(edges, "regulator").join(matrix.withColumnRenamed("feature", "target"), ["sample", "target"])
    w = W.partitionBy("sample", "regulator")
    own = own.withColumn("t", 2 * average_rank("value", "sample", "regulator") / (F.count("*").over(w) + 1) - 1)
    own = own.withColumn("u", 2 * F.abs("t") - 1)
    own = own.withColumn("u", F.col("u") + (1 - F.max("u").over(w)) / 2).withColumns({"pt": F.col("t") / 2 + 0.5, "pu": F.col("u") / 2 + 0.5})
    l = F.col("likelihood")
    own = mathx.add_ppf(mathx.add_ppf(own, "pt", "z2"), "pu", "z1")
    own = written(own.select("sample", "regulator", "target", "likelihood", (F.col("mor") * l * F.col("z2") * F.signum("nes")).alias("x2"),
                             ((1 - F.abs("mor")) * l * F.col("z1")).alias("x1")), "own-targets")
    # which regulators share enough targets does not depend on the sample, so that most pairs go before samples come in
    one = edges.select("regulator", "target").distinct()
    rivals = one.join(one.withColumnRenamed("regulator", "rival"), "target").where("regulator <> rival")
    enough = rivals.groupBy("regulator", "rival").agg(F.count("*").alias("k")).where(F.col("k") >= targets).drop("k")
    overlap = written(rivals.join(enough, ["regulator", "rival"]), "overlaps")
    shared = own.join(overlap, ["regulator", "target"]).join(cand.select("sample", F.col("regulator").alias("rival")), ["sample", "rival"], "left_semi")
    tests = shared.groupBy("sample", "regulator", "rival").agg(
        F.count("*").alias("k"), F.sum("x2").alias("s1"), F.sum("x1").alias("s2"),
        F.sum(l).alias("sl"), F.sum(l * l).alias("sll"), F.max("likelihood").alias("ml")).where(F.col("k") >= targets)
    tests = tests.withColumn("stat", F.expr("(abs(s1) + greatest(s2, 0)) / sl * (CASE WHEN s1 < 0 THEN -1 ELSE 1 END) * sqrt(sll) / ml"))
    tests = written(tests.select("sample", "regulator", "rival", F.greatest(F.expr(mathx.sf("stat")), F.lit(1e-300)).alias("p")), "tests")
    back = tests.select("sample", F.col("regulator").alias("rival"), F.col("rival").alias("regulator"), F.col("p").alias("q"))
    pairs = tests.join(back, ["sample", "regulator", "rival"])
    pairs = pairs.withColumn("tests", F.count("*").over(W.partitionBy("sample", "regulator")))
    # the regulator whose shared targets are not enriched, while its rival's are, is dominated
    lost = pairs.where((F.col("p") >= shadow) & (F.col("q") < shadow)) if method == "absolute" else pairs.where(F.col("p") > F.col("q"))
    weight = F.log(F.lit(float(penalty))) / F.col("tests") if method == "absolute" else (
        F.log1p(F.abs(F.log10("p") - F.log10("q"))) * penalty / F.col("tests"))
    lost = written(lost.select("sample", "regulator", "rival", weight.alias("w")), "dominated")
    cut = lost.join(overlap, ["regulator", "rival"]).groupBy("sample", "regulator", "target").agg(F.sum("w").alias("w"))
    changed = lost.select("sample", "regulator").distinct()
    new = changed.join(edges, "regulator").join(cut, ["sample", "regulator", "target"], "left").select(
        "sample", "regulator", "target", "mor", (l * F.exp(-F.coalesce("w", F.lit(0.0)))).alias("l"))
    scores = ranked(matrix, False).withColumnRenamed("feature", "target")
    again = new.join(scores, ["sample", "target"]).groupBy("sample", "regulator").agg(
        F.count("*").alias("k"), F.sum(F.col("mor") * F.col("l") * F.col("z2")).alias("d"), F.sum((1 - F.abs("mor")) * F.col("l") * F.col("z1")).alias("u"),
        F.sum("l").alias("sl"), F.sqrt(F.sum(F.col("l") * F.col("l"))).alias("root"), F.max("l").alias("ml")).where(F.col("k") >= min_size)
    again = written(again.select("sample", "regulator", F.expr("(abs(d) + greatest(u, 0)) / sl * signum(d) * root / ml").alias("nes2")), "rescored")
    return activity.join(again, ["sample", "regulator"], "left").withColumn("nes", F.coalesce("nes2", "nes")).drop("nes2")
