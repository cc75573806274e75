"""The registered queries: every operator over its whole derived table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, ordinal_rank
from ..operators import clusters as C, distances as D, enrichment as E, pvals as P, sampling as S, signature as G, tools as T
from ..operators.common import densify, from_vectors
from ..operators.network import Network
from ..operators.pleiotropy import correct
from . import plot_frames as V
from . import views
from .oracle import oracle_sql as oracle_sql


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["area_nes"](spark, sf_dir)


class Data:
    """The derived networks and matrices of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def net(self, sql: str) -> Network:
        return Network(views.spark_view(self.spark, self.sf_dir, sql))

    @cached_property
    def m1(self) -> DataFrame:
        return densify(views.spark_view(self.spark, self.sf_dir, views.M1_SPARSE))

    @property
    def m2(self) -> DataFrame:
        return from_vectors(self.table("embeddings"), "vec_id", "embedding")

    @property
    def clusters(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("sample"), F.col("label").cast("string").alias("cluster"))

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("sample"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def rounded(frame: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in frame.columns])


def _activity(d: Data) -> DataFrame:
    return d.m2.select("sample", F.col("feature").alias("regulator"), (F.col("value") * 10).alias("nes"))


def _pval(d: Data, **how) -> DataFrame:
    out = P.to_pvalues(_activity(d), **how)
    return rounded(out.select("sample", F.col("regulator").alias("feature"), "pval"), "pval")


def _similarity(d: Data, **how) -> DataFrame:
    return D.activity_similarity(d.m2.withColumn("value", F.col("value") * 10), places=6, **how)


def _halves(d: Data) -> tuple[DataFrame, DataFrame]:
    a, odd = _activity(d), F.pmod(F.col("sample").cast("bigint"), F.lit(2)) == 1
    return a.where(~odd), a.where(odd)


def _pathways(d: Data) -> Network:
    """Each cluster's regulators with the highest scores, as gene sets."""
    tops = C.top_regulators(d.m2, d.clusters, n=20, both=True)
    return Network(tops.select(F.concat(F.lit("set"), "cluster"), "feature", F.signum("mark"), F.lit(1.0)))


def _counts(d: Data) -> DataFrame:
    return d.m2.select("sample", "feature", F.floor(F.abs("value") * 100).cast("double").alias("count"))


def _members(d: Data) -> DataFrame:
    return S.metacell_members(d.vectors, _counts(d), d.clusters, size=10, n_cells=5)


def _vis_nodes(d: Data) -> DataFrame:
    net = d.net(views.N1)
    nothing = d.m1.where("false")
    v, _ = V.network_frames(net.edges, nothing, d.m1, net.regulators())
    return v.select("id", "is_regulator", F.round("mor", 13).alias("mor"), F.round("value", 4).alias("value"))


QUERIES = {
    "net_targets_per_regulon": lambda d: d.net(views.N1).targets_per_regulon(),
    "net_size": lambda d: d.net(views.N1).size(),
    "net_summary": lambda d: rounded(d.net(views.N1).summary(), "mean_abs_mor", "mean_likelihood"),
    "net_filter_targets": lambda d: d.net(views.N1).filter_targets(
        keep=d.table("part").where("p_size <= 25").select(F.col("p_partkey").cast("string"))).edges,
    "net_filter_regulators": lambda d: d.net(views.N1).filter_regulators(
        remove=d.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string"))).edges,
    "net_get_reg": lambda d: d.net(views.N1).get_reg("1"),
    "net_targets": lambda d: d.net(views.N1).targets(),
    "net_prune": lambda d: d.net(views.N1).prune(50).edges,
    "net_repeated_pairs": lambda d: d.net(views.N0).repeated_pairs(),
    "net_dedup_likelihood": lambda d: d.net(views.N0).remove_duplicate_pairs().edges,
    "net_icp": lambda d: rounded(d.net(views.N1).icp(), "icp"),
    "net_ic_weights": lambda d: rounded(d.net(views.N1).weights(), "weight", places=9),
    "net_normalized_likelihoods": lambda d: rounded(d.net(views.N1).normalized_likelihoods().edges, "likelihood"),
    "net_integrate": lambda d: rounded(d.net(views.N2).integrate([d.net(views.N3)], [1, 2]).edges, "mor", "likelihood"),
    "net_translate": lambda d: d.net(views.N1).translate_targets(views.spark_view(d.spark, d.sf_dir, views.BRANDS), "id", "name").edges.select(
        "regulator", "target", "mor", "likelihood"),
    "net_from_aracne": lambda d: rounded(Network.from_aracne(views.spark_view(d.spark, d.sf_dir, views.ARACNE), mi_threshold=10).edges, "likelihood"),
    "net_from_activity": lambda d: Network.from_activity(_activity(d), 10).edges,
    "net_regulons": lambda d: d.net(views.N1).regulons().select(
        "regulator", F.size("edges").cast("bigint").alias("edges"), F.col("edges")[0]["target"].alias("first_target")),
    "sig_scale": lambda d: rounded(G.scale(d.m2), "value"),
    "sig_rank": lambda d: G.rank(d.m2),
    "sig_mad": lambda d: rounded(G.mad(d.m2), "value"),
    "sig_ttest": lambda d: rounded(G.ttest(d.m2), "value"),
    "sig_doublerank": lambda d: rounded(G.rank_norm(d.m2), "value"),
    "rank_average": lambda d: d.m2.select("sample", "feature", average_rank("value", "sample").alias("r")),
    "rank_ordinal": lambda d: d.m2.select("sample", "feature", ordinal_rank("value", "feature", "sample").alias("r")),
    "area_nes": lambda d: rounded(E.area(d.m1, d.net(views.N1)), "nes"),
    "area_nes_ordinal": lambda d: rounded(E.area(d.m1, d.net(views.N1), ordinal=True), "nes"),
    "area_eset_filter": lambda d: rounded(E.area(d.m1, d.net(views.N2), eset_filter=True), "nes"),
    "area_meta_weights": lambda d: rounded(E.area_meta(d.m1, [d.net(views.N2), d.net(views.N3)]), "nes"),
    "area_meta_auto": lambda d: rounded(E.area_meta(d.m1, [d.net(views.N2), d.net(views.N3)], mvws="auto"), "nes"),
    "area_meta_manual": lambda d: rounded(E.area_meta(
        d.m1, [d.net(views.N2), d.net(views.N3)],
        mvws=d.m1.select("sample").distinct().select("sample", F.pmod(F.col("sample").cast("int"), F.lit(2)).alias("net"))), "nes"),
    "narnea_nes_pes": lambda d: rounded(E.narnea(d.m1, d.net(views.N1)), "nes", "pes"),
    "narnea_meta": lambda d: rounded(E.narnea_meta(d.m1, [d.net(views.N2), d.net(views.N3)]), "nes", "pes"),
    "viper_rank_area": lambda d: rounded(E.infer_activity(d.m1, d.net(views.N2), method="rank"), "nes"),
    "viper_two_networks": lambda d: rounded(E.infer_activity(d.m1, [d.net(views.N2), d.net(views.N3)]), "nes"),
    "viper_narnea": lambda d: rounded(E.infer_activity(d.m1, d.net(views.N3), enrichment="narnea"), "nes", "pes").where("nes > 0"),
    "area_weighted": lambda d: rounded(E.area_weighted(
        views.spark_view(d.spark, d.sf_dir, views.M1_SPARSE), d.net(views.N1), views.spark_view(d.spark, d.sf_dir, views.CELL_WEIGHTS)), "nes"),
    "stouffer": lambda d: rounded(C.stouffer(d.m2, d.clusters), "score", "pval"),
    "mean_diffs": lambda d: rounded(C.mean_diffs(d.m2, d.clusters), "score", "pval"),
    "median_diffs": lambda d: rounded(C.median_diffs(d.m2, d.clusters), "score"),
    "mwu": lambda d: rounded(C.mwu(d.m2, d.clusters), "pval"),
    "spearman": lambda d: rounded(C.spearman(d.m2, d.m2, d.clusters), "score", "pval"),
    "top_mrs": lambda d: rounded(C.top_regulators(d.m2, d.clusters, n=10), "score"),
    "nes_to_pval": lambda d: _pval(d, adjust=False),
    "nes_to_pval_fdr": lambda d: _pval(d),
    "nes_to_neg_log10": lambda d: _pval(d, two_sided=False, adjust=False, neg_log=True),
    "corr_distance": lambda d: D.corr_distance(d.vectors, places=5),
    "knn": lambda d: D.knn(d.vectors, 10).drop("dist"),
    "silhouette": lambda d: rounded(D.silhouette(d.vectors, d.clusters).drop("place"), "silhouette"),
    "similarity_two_sided": lambda d: _similarity(d),
    "similarity_greater": lambda d: _similarity(d, method="greater"),
    "similarity_less": lambda d: _similarity(d, method="less"),
    "similarity_nn": lambda d: _similarity(d, nn=20),
    "oncomatch": lambda d: T.oncomatch(*_halves(d), size=20, places=6),
    "path_enrich": lambda d: rounded(E.path_enrich(_activity(d), _pathways(d)), "nes"),
    "pleiotropy": lambda d: rounded(correct(d.m1, E.area(d.m1, d.net(views.N1).prune(50)), d.net(views.N1).prune(50), targets=3), "nes"),
    "metacell_counts": lambda d: rounded(S.metacell_counts(
        D.knn(d.vectors, 5).select(F.lit("0").alias("cluster"), F.col("sample").alias("metacell"), F.col("neighbor").alias("sample")),
        d.m2.withColumnRenamed("value", "count")).drop("cluster"), "count"),
    "repr_subsample": lambda d: S.repr_subsample(d.vectors, 20, clusters=d.clusters),
    "repr_metacells": _members,
    "metacell_stats": lambda d: S.metacell_stats(_members(d), _counts(d)),
    "metacell_shares": lambda d: rounded(S.metacell_stats(
        D.knn(d.vectors, 5).select(F.lit("0").alias("cluster"), F.col("sample").alias("metacell"), F.col("neighbor").alias("sample")),
        _counts(d)).select("samples_used", "perc_reused", "mean_use", "std_use"), "perc_reused", "mean_use", "std_use"),
    "pca": lambda d: T.pca(d.vectors, 5).select("sample", F.posexplode("vec").alias("component", "score")),
    "dendrogram": lambda d: T.dendrogram(d.vectors, d.clusters),
    "vis_net_nodes": _vis_nodes,
    "group_summary": lambda d: rounded(V.group_summary(V.plot_frame(d.m2, obs=d.clusters), "cluster"), "mean", "fraction", "q1", "median", "q3"),
    "normalized_expression": lambda d: rounded(V.normalized_expression(d.m1.withColumn("value", F.floor("value").cast("double"))), "value"),
    "sample_order": lambda d: V.sample_order(d.vectors, d.clusters),
    "mr_rows": lambda d: rounded(V.regulator_rows(d.m2, d.clusters), "total"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Data(spark, sf_dir))) for name, f in QUERIES.items()}
