"""Operators against small brute-force versions and invariants."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulonspark.operators import clusters as C, distances as D, enrichment as E, pvals as P, sampling as S, signature as G, tools as T
from regulonspark.operators.network import Network
from regulonspark.plans import registry
from regulonspark.sources import io

NET = "regulator string, target string, mor double, likelihood double"
PPF = NormalDist().inv_cdf


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 12))
    rows = [(f"s{i}", f"g{j:02d}", float(x[i, j])) for i in range(6) for j in range(12)]
    return spark.createDataFrame(rows, "sample string, feature string, value double"), x


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{k}", f"g{j:02d}", float(rng.uniform(-1, 1)), float(rng.uniform(0.1, 1))) for k in range(3) for j in rng.permutation(12)[:6]]
    return Network(spark.createDataFrame(rows, NET)), rows


def brute_area(x, rows):
    n = x.shape[1]
    t2 = (np.argsort(np.argsort(x, 1), 1) + 1) / (n + 1)
    t1 = np.abs(t2 - 0.5) * 2
    t1 = t1 + (1 - t1.max()) / 2
    z2, z1 = np.vectorize(PPF)(t2), np.vectorize(PPF)(t1)
    out = {}
    for r in sorted({r for r, *_ in rows}):
        e = [(int(t[1:]), m, w) for a, t, m, w in rows if a == r]
        total, top = sum(w for *_, w in e), max(w for *_, w in e)
        for i in range(len(x)):
            d = sum(w / total * m * z2[i, t] for t, m, w in e)
            u = sum(w / total * (1 - abs(m)) * z1[i, t] for t, m, w in e)
            out[f"s{i}", r] = (abs(d) + max(u, 0)) * np.sign(d) * math.sqrt(sum((w / top) ** 2 for *_, w in e))
    return out


def test_area_matches_brute_force(matrix, net):
    got = {(r.sample, r.regulator): r.nes for r in E.area(matrix[0], net[0], min_targets=1).collect()}
    want = brute_area(matrix[1], net[1])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_area_ignores_monotone_changes(matrix, net):
    m = matrix[0].withColumn("value", F.exp("value"))
    a = {(r.sample, r.regulator): r.nes for r in E.area(m, net[0], min_targets=1).collect()}
    assert all(a[k] == pytest.approx(v, abs=1e-9) for k, v in brute_area(matrix[1], net[1]).items())


def test_narnea_sign_and_bounds(matrix, net):
    a = {(r.sample, r.regulator): r for r in E.narnea(matrix[0], net[0], min_targets=1).collect()}
    b = {(r.sample, r.regulator): r for r in E.narnea(matrix[0].withColumn("value", -F.col("value")), net[0], min_targets=1).collect()}
    assert len(a) == 18
    for k in a:
        assert math.isfinite(a[k].nes) and a[k].nes == pytest.approx(-b[k].nes, abs=1e-6)


def test_network_changes(spark):
    a = Network(spark.createDataFrame([("reg1", "t1", 0.5, 0.7), ("reg2", "t2", 0.6, 0.8)], NET))
    b = Network(spark.createDataFrame([("reg1", "t1", 0.5, 0.7), ("reg3", "t3", 0.6, 0.8)], NET))
    both = a.integrate([b])
    assert {r.regulator for r in both.edges.collect()} == {"reg1", "reg2", "reg3"}
    assert a.filter_targets(keep=["t1"]).edges.count() == 1
    assert a.filter_regulators(remove=["reg1"]).edges.first().regulator == "reg2"
    assert a.prune(1).edges.count() == 2 and a.prune(2).edges.count() == 0
    with pytest.raises(ValueError):
        a.filter_regulators(keep=["tfs"])


def test_network_files(spark, tmp_path, net):
    for kind in ("csv", "tsv", "parquet"):
        io.write_network(net[0], f"{tmp_path}/net.{kind}")
        assert sorted(io.read_network(spark, f"{tmp_path}/net.{kind}").edges.collect()) == sorted(net[0].edges.collect())
    with pytest.raises(ValueError):
        io.read_network(spark, "net.pkl")


def test_signatures(matrix):
    m, x = matrix
    got = {(r.sample, r.feature): r.value for r in G.scale(m).collect()}
    assert got["s0", "g03"] == pytest.approx((x[0, 3] - x[:, 3].mean()) / x[:, 3].std(ddof=1))
    others = x[0, 3] - np.delete(x[:, 3], 0)
    t = others.mean() / (others.std(ddof=1) / math.sqrt(5))
    assert {(r.sample, r.feature): r.value for r in G.ttest(m).collect()}["s0", "g03"] == pytest.approx(t)


def test_cluster_statistics(spark, matrix):
    m, x = matrix
    c = spark.createDataFrame([(f"s{i}", str(i % 2)) for i in range(6)], "sample string, cluster string")
    got = {(r.cluster, r.feature): r for r in C.stouffer(m, c).collect()}
    assert got["0", "g05"].score == pytest.approx(x[::2, 5].sum() / math.sqrt(3))
    assert all(0 <= r.pval <= 1 for r in got.values())
    u = {(r.cluster, r.feature): r.score for r in C.mwu(m, c).collect()}
    assert u["0", "g05"] == sum(a > b for a in x[::2, 5] for b in x[1::2, 5])


def test_fdr(spark):
    f = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.5)], "k string, p double")
    assert [round(r.fdr, 6) for r in P.bh(f, "p", "k").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_conservation_of_itself_is_highest(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(f"s{i}", f"p{j}", float(v)) for i in range(5) for j, v in enumerate(rng.normal(size=50))], "sample string, regulator string, nes double")
    got = T.oncomatch(a, a, size=10).toPandas().pivot(index="sample", columns="reference", values="score")
    assert (got.idxmax(axis=1) == got.index).all()


def test_neighbours_and_sampling(spark, matrix):
    v = D.vectors_of(matrix[0])
    near = D.knn(v, 3, block=2).collect()
    assert len(near) == 18 and all(r.neighbor == r.sample for r in near if r["rank"] == 1)
    assert S.repr_subsample(v, 2).count() == 2
    sim = {(r.sample_i, r.sample_j): r.similarity for r in D.activity_similarity(matrix[0], block=4).collect()}
    assert all(sim[i, j] == pytest.approx(sim[j, i]) for i, j in sim)


def test_sql_is_of_registered_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
