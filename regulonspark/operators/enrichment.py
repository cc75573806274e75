"""Regulator activity by analytic rank-based enrichment.

``area``: quantile-transformed ranks, weighted by likelihood, in a directed and
an undirected tail. ``narnea``: signed ranks against their null moments.
Both are one rank window per sample, one join with the edges, one aggregation. Ranks
and weighted edges are tables, so the plans that lead to them run once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.ranks import average_rank, ordinal_rank, top_and_bottom
from ..sources.store import written
from .common import only
from .network import Network
from .signature import signature


def _uniform(*parts: str) -> str:
    """A number from 0 to 1 that depends on the parts (SQL) only."""
    text = " || '|' || ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D"


def _kept_features(matrix: DataFrame, net: Network, eset_filter: bool) -> DataFrame:
    """The filter comes before ranking: it changes ranks."""
    if not eset_filter:
        return matrix
    return only(matrix, "feature", net.targets().union(net.regulators()).distinct())


def _likely_targets(nets: Sequence[Network], features: DataFrame, min_targets: int) -> DataFrame:
    """net, regulator, target, mor, likelihood: regulators with enough targets, then only targets that are ``features``."""
    out = None
    for k, net in enumerate(nets):
        one = net.prune(None, min_targets, eliminate=False).edges.withColumn("net", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return only(out, "target", features)


def ranked(matrix: DataFrame, ordinal: bool) -> DataFrame:
    """A table of sample, feature, t2, z2, z1: ranks as quantiles in two tails. The one pass over the matrix's plan."""
    rank = ordinal_rank("value", "feature", "sample") if ordinal else average_rank("value", "sample")
    n = F.count("*").over(W.partitionBy("sample"))
    tails = written(matrix.select("sample", "feature", (rank / (n + 1)).alias("t2")), "ranks")
    top = tails.agg(F.max(F.abs(F.col("t2") - 0.5) * 2)).first()[0]
    f = tails.withColumn("t1", F.abs(F.col("t2") - 0.5) * 2 + (0.0 if top is None else (1 - top) / 2))
    return mathx.add_ppf(mathx.add_ppf(f, "t2", "z2"), "t1", "z1").select("sample", "feature", "z2", "z1")


def weighted_edges(nets: Sequence[Network], features: DataFrame, min_targets: int) -> DataFrame:
    """A table of net, regulator, target, directed, undirected: what each edge counts in the two tails."""
    known = _likely_targets(nets, features, min_targets)
    of = W.partitionBy("net", "regulator")
    l = F.col("likelihood")
    # repeated pairs are averaged for the weights, and count as they are in the root of the squares
    known = known.withColumn("icp", F.try_divide(F.sqrt(F.sum(l * l).over(of)), F.max(l).over(of)))
    one = known.groupBy("net", "regulator", "target").agg(F.avg("mor").alias("mor"), F.avg(l).alias("likelihood"), F.first("icp").alias("icp"))
    weight = F.try_divide(l, F.sum(l).over(of)) * F.col("icp")
    return written(one.select("net", "regulator", "target", (weight * F.col("mor")).alias("directed"), (weight * (1 - F.abs("mor"))).alias("undirected")), "edges")


def _area_of_nets(matrix: DataFrame, nets: Sequence[Network], *, min_targets: int = 30, eset_filter: bool = False, ordinal: bool = False) -> DataFrame:
    """sample, net, regulator, nes. Samples are ranked once for all networks, unless their filters make the ranks differ."""
    if eset_filter and len(nets) > 1:
        return _by_net(nets, lambda net: area(matrix, net, min_targets=min_targets, eset_filter=True, ordinal=ordinal))
    scores = ranked(_kept_features(matrix, nets[0], eset_filter), ordinal)
    edges = weighted_edges(nets, scores.select("feature").distinct(), min_targets)
    sums = scores.withColumnRenamed("feature", "target").join(edges, "target").groupBy("sample", "net", "regulator").agg(
        F.sum(F.col("directed") * F.col("z2")).alias("d"), F.sum(F.col("undirected") * F.col("z1")).alias("u"))
    return sums.select("sample", "net", "regulator", ((F.abs("d") + F.greatest("u", F.lit(0.0))) * F.signum("d")).alias("nes"))


def area(matrix: DataFrame, net: Network, *, min_targets: int = 30, eset_filter: bool = False, ordinal: bool = False) -> DataFrame:
    """sample, regulator, nes. Regulators are counted before targets without values are left out."""
    return _area_of_nets(matrix, [net], min_targets=min_targets, eset_filter=eset_filter, ordinal=ordinal).drop("net")


def area_weighted(matrix: DataFrame, net: Network, weights: DataFrame | None = None, *, min_targets: int = 20) -> DataFrame:
    """sample, regulator, nes, where values may be missing (null, or no row) and count with ``weights`` (sample, feature, weight; 1 if none).

    Each sample's ranks are among the values it has, and its undirected tail is lifted by its
    own. Cells without a weight count nothing. Regulators are counted by the targets that are features.
    """
    m = written(matrix.where(F.col("value").isNotNull()).select("sample", "feature", "value"), "values")
    features = matrix.select("feature").distinct()
    known = net.filter_targets(keep=features).prune(None, min_targets, eliminate=False).edges
    w = W.partitionBy("sample")
    f = m.select("sample", "feature", (average_rank("value", "sample") / (F.count("*").over(w) + 1)).alias("t2")).withColumn("t1", F.abs(F.col("t2") - 0.5) * 2)
    f = f.withColumn("t1", F.col("t1") + (1 - F.max("t1").over(w)) / 2)
    f = mathx.add_ppf(mathx.add_ppf(f, "t2", "z2"), "t1", "z1").select("sample", F.col("feature").alias("target"), "z2", "z1")
    if weights is None:
        f = f.withColumn("weight", F.lit(1.0))
    else:
        given = weights.toDF("sample", "target", "weight").select(F.col("sample").cast("string").alias("sample"), F.col("target").cast("string").alias("target"), "weight")
        f = f.join(given, ["sample", "target"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    l, x = F.col("likelihood"), F.col("likelihood") * F.col("weight")
    sums = f.join(known, "target").groupBy("sample", "regulator").agg(
        F.sum(x * F.col("mor") * F.col("z2")).alias("d"), F.sum(x * (1 - F.abs("mor")) * F.col("z1")).alias("u"), F.sum(x).alias("total"),
        F.sqrt(F.sum(x * x)).alias("root"), F.max(x).alias("top"), F.min("weight").alias("least"), F.count("*").alias("n"))
    whole = known.groupBy("regulator").agg(F.sqrt(F.sum(l * l)).alias("root1"), F.max(l).alias("top1"), F.count("*").alias("n1"))
    # where no cell counts less than 1, the regulator's own likelihoods set the size of the score
    sums = sums.join(whole, "regulator")
    lessened = written(sums.withColumn("lessened", (F.col("least") < 1) | (F.col("n") < F.col("n1"))), "weighted-sums")
    any_less = bool(lessened.agg(F.max("lessened")).first()[0])
    size = F.try_divide("root", "top") if any_less else F.try_divide("root1", "top1")
    sign = F.when(F.col("d") < 0, -1.0).otherwise(1.0)
    es = F.try_divide((F.abs("d") + F.greatest("u", F.lit(0.0))) * sign, "total")
    return lessened.select("sample", "regulator", (es * size).alias("nes"))


def _by_net(nets: Sequence[Network], run) -> DataFrame:
    out = None
    for k, net in enumerate(nets):
        one = run(net).withColumn("net", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def network_scores(stacked: DataFrame, n: int = 50) -> DataFrame:
    """sample, net, score: half the distance between the mean of the n highest and the n lowest."""
    t = top_and_bottom(stacked, "nes", "regulator", n, "sample", "net")
    return t.groupBy("sample", "net").agg(
        ((F.avg(F.when(F.col("top") <= n, F.col("nes"))) - F.avg(F.when(F.col("bottom") <= n, F.col("nes")))) / 2).alias("score"))


def area_meta(matrix: DataFrame, nets: Sequence[Network], *, mvws: int | float | str | DataFrame = 1, **how) -> DataFrame:
    """Several networks: a power that weighs their scores, 'auto' for the best network per sample, or a frame (sample, net number)."""
    stacked = _area_of_nets(matrix, nets, **how)
    if isinstance(mvws, DataFrame):
        chosen = mvws.toDF("sample", "net").withColumn("sample", F.col("sample").cast("string"))
        return stacked.join(chosen, ["sample", "net"]).select("sample", "regulator", "nes")
    if mvws == "auto":
        stacked = written(stacked, "nets")
        best = network_scores(stacked).groupBy("sample").agg(F.min_by("net", F.struct(-F.col("score"), F.col("net"))).alias("net"))
        return stacked.join(best, ["sample", "net"]).select("sample", "regulator", "nes")
    w = F.pow(F.abs("nes"), F.lit(float(mvws)))
    return stacked.groupBy("sample", "regulator").agg(
        F.coalesce(F.try_divide(F.sum(F.col("nes") * w), F.sum(w)), F.lit(0.0)).alias("nes"))


def _combined(frame: DataFrame, out: str, d: str, u: str, rho: str = "rho") -> DataFrame:
    """``frame`` with the one score, as column ``out``, for a directed and an undirected score and their correlation."""
    d, u, rho = F.col(d), F.col(u), F.col(rho)
    f = mathx.add_logsf(frame, (d + u) / F.sqrt(2 + 2 * rho), "_plus")
    f = mathx.add_logsf(f, (u - d) / F.sqrt(2 - 2 * rho), "_minus").withColumn("_l", F.least("_plus", "_minus"))
    f = f.withColumn("_f", F.col("_l") + F.log(1 - F.exp("_l") / 2))
    f = mathx.add_log_quantile(f, "_f", "_z")
    return f.withColumn(out, F.when(F.col("_plus") < F.col("_minus"), F.col("_z")).otherwise(-F.col("_z"))).drop("_plus", "_minus", "_l", "_f", "_z")


def _signed_ranks(m: DataFrame, seed: str) -> DataFrame:
    """A table of sample, feature, s (sign), r (rank of the size), n (features of the sample); zeros are drawn."""
    m = written(m, "values")
    least, positive, other = m.agg(
        F.min(F.when(F.col("value") != 0, F.col("value"))), F.count(F.when(F.col("value") > 0, 1)), F.count(F.when(F.col("value") != 0, 1))).first()
    share = positive / other if other else None
    drawn = (f"(CASE WHEN {_uniform(repr(seed), 'sample', 'feature', repr('s'))} < {share!r}D THEN 1 ELSE -1 END) * "
             f"{_uniform(repr(seed), 'sample', 'feature', repr('m'))} * {least!r}D") if other else "CAST(NULL AS DOUBLE)"
    m = m.select("sample", "feature", F.expr(f"CASE WHEN value <> 0 THEN value ELSE {drawn} END").alias("value"))
    return written(m.select("sample", "feature", F.signum("value").alias("s"), average_rank(F.abs("value"), "sample").alias("r"),
                            F.count("*").over(W.partitionBy("sample")).cast("double").alias("n")), "signed-ranks")


def _narnea_of_nets(matrix: DataFrame, nets: Sequence[Network], *, min_targets: int = 30, eset_filter: bool = False, seed: str = "0") -> DataFrame:
    """A table of sample, net, regulator, nes, pes. Samples are ranked once for all networks, unless their filters make the ranks differ."""
    if eset_filter and len(nets) > 1:
        return _by_net(nets, lambda net: narnea(matrix, net, min_targets=min_targets, eset_filter=True, seed=seed))
    ranked = _signed_ranks(_kept_features(matrix, nets[0], eset_filter), seed)
    r, s, n = F.col("r"), F.col("s"), F.first("n")
    moments = ranked.groupBy("sample").agg(n.alias("n"), (F.sum(r * s) / n).alias("e_rs"), (F.sum(r * r * s) / n).alias("e_r2s")).select(
        "sample", "n", ((F.col("n") + 1) / 2).alias("e_r"), ((2 * F.col("n") * F.col("n") + 3 * F.col("n") + 1) / 6).alias("e_r2"), "e_rs", "e_r2s")
    known = _likely_targets(nets, ranked.select("feature").distinct(), min_targets)
    mode = F.expr(f"CASE WHEN abs(mor) >= 1 THEN signum(mor) * 0.999D WHEN mor = 0 THEN 0.002D * ({_uniform(repr(seed), 'regulator', 'target')} - 0.5D) ELSE mor END")
    one = known.groupBy("net", "regulator", "target").agg(F.avg("mor").alias("mor"), F.avg("likelihood").alias("l")).withColumn("mor", mode)
    top = F.dense_rank().over(W.partitionBy("net", "regulator").orderBy(F.desc("l")))
    edges = written(one.select(
        "net", "regulator", "target", (F.col("mor") * F.col("l")).alias("a"), ((1 - F.abs("mor")) * F.col("l")).alias("b"),
        (F.abs("mor") * F.col("l")).alias("c"), top.alias("place")), "edges")
    # the strongest response that a regulator can have: its likeliest targets in the highest ranks
    a, b, c, place = (F.col(x) for x in ("a", "b", "c", "place"))
    sums = edges.groupBy("net", "regulator").agg(*[F.sum(x).alias(y) for x, y in (
        (a, "sa"), (a * a, "saa"), (b, "sb"), (b * b, "sbb"), (a * b, "sab"), (c, "pa"), (c * place, "pap"), (b, "pb"), (b * place, "pbp"))])
    hits = ranked.withColumnRenamed("feature", "target").join(edges, "target").groupBy("sample", "net", "regulator").agg(
        F.sum(r * s * a).alias("d"), F.sum(r * b).alias("u"))
    f = hits.join(sums, ["net", "regulator"]).join(moments, "sample").selectExpr(
        "sample", "net", "regulator", "sa * e_rs AS ed", "saa * (e_r2 - e_rs * e_rs) AS vd", "sb * e_r AS eu", "sbb * (e_r2 - e_r * e_r) AS vu",
        "sab * (e_r2s - e_rs * e_r) AS cov", "d", "u", "(n + 1) * pa - pap AS dmax", "(n + 1) * pb - pbp AS umax").selectExpr(
        "sample", "net", "regulator", "try_divide(d - ed, sqrt(vd)) AS zd", "try_divide(u - eu, sqrt(vu)) AS zu", "try_divide(dmax - ed, sqrt(vd)) AS zp",
        "try_divide(-dmax - ed, sqrt(vd)) AS zn", "try_divide(umax - eu, sqrt(vu)) AS zm", "try_divide(cov, sqrt(vd * vu)) AS rho")
    for out, directed, undirected in (("nes", "zd", "zu"), ("pos", "zp", "zm"), ("neg", "zn", "zm")):
        f = _combined(f, out, directed, undirected)
    most = F.abs(F.when(F.col("nes") > 0, F.col("pos")).otherwise(F.col("neg")))
    # a table, so that a filter on the scores is not rewritten through all these formulas
    out = written(f.select("sample", "net", "regulator", "nes", F.try_divide("nes", most).alias("pes")), "narnea")
    return out


def narnea(matrix: DataFrame, net: Network, *, min_targets: int = 30, eset_filter: bool = False, seed: str = "0") -> DataFrame:
    """sample, regulator, nes, pes.

    Zeros become small values with the signs' share of the matrix and modes of
    0 a small mode, both drawn by hash of their names, so that reruns agree.
    Repeated (regulator, target) pairs are an error of the input; they are averaged.
    """
    return _narnea_of_nets(matrix, [net], min_targets=min_targets, eset_filter=eset_filter, seed=seed).drop("net")


def narnea_meta(matrix: DataFrame, nets: Sequence[Network], **how) -> DataFrame:
    """Networks weighted per sample by the share of common regulators in which they have the strongest response."""
    stacked = _narnea_of_nets(matrix, nets, **how)
    common = stacked.groupBy("sample", "regulator").agg(
        F.count("pes").alias("k"), F.min_by("net", F.struct(-F.abs("pes"), F.col("net"))).alias("net")).where(F.col("k") == len(nets))
    weights = common.groupBy("sample", "net").agg(F.count("*").alias("w")).withColumn(
        "w", F.col("w") / F.sum("w").over(W.partitionBy("sample")))
    w = F.coalesce("w", F.lit(0.0))
    j = stacked.join(weights, ["sample", "net"], "left").withColumn("w", w)
    return j.groupBy("sample", "regulator").agg(
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("nes")), F.sqrt(F.sum(F.when(F.col("nes") != 0, F.col("w") * F.col("w"))))), F.lit(0.0)).alias("nes"),
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("pes")), F.sum(F.when(F.col("pes") != 0, F.col("w")))), F.lit(0.0)).alias("pes"))


def infer_activity(matrix: DataFrame, nets: Network | Sequence[Network], *, enrichment: str | None = "area", method: str | None = None,
                   mvws=1, min_targets: int = 30, eset_filter: bool = True, ordinal: bool = False, pleiotropy: bool = False,
                   obs: DataFrame | None = None) -> DataFrame:
    """The whole chain: signature, enrichment, several networks, optional pleiotropy correction and sample annotation."""
    nets = [nets] if isinstance(nets, Network) else list(nets)
    m = signature(matrix, method)
    kind = (enrichment or "narnea").lower()
    if kind == "area":
        how = dict(min_targets=min_targets, eset_filter=eset_filter, ordinal=ordinal)
        out = area(m, nets[0], **how) if len(nets) == 1 else area_meta(m, nets, mvws=mvws, **how)
        if pleiotropy:
            from .pleiotropy import correct

            out = correct(m, out, nets[0])
    elif kind == "narnea":
        how = dict(min_targets=min_targets, eset_filter=eset_filter)
        out = narnea(m, nets[0], **how) if len(nets) == 1 else narnea_meta(m, nets, **how)
    else:
        raise ValueError("enrichment is 'area' or 'narnea'")
    return out if obs is None else out.join(obs, "sample", "left")


def path_enrich(activity: DataFrame, collections: Network | Sequence[Network], *, value: str = "nes", obs: DataFrame | None = None, **how) -> DataFrame:
    """Enrichment of gene-set collections in an activity matrix; no least number of targets. With ``obs`` the sets become its columns."""
    m = activity.select("sample", F.col("regulator").alias("feature"), F.col(value).alias("value"))
    out = infer_activity(m, collections, min_targets=0, **how)
    return out if obs is None else obs.join(out.groupBy("sample").pivot("regulator").agg(F.first("nes")), "sample", "left")
