"""Operators against plain loops: enrichment of several kinds, pleiotropy, tools, tests on small groups, metacells."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulonspark.operators import clusters as C, common as K, distances as D, enrichment as E, pleiotropy as P, pvals as V, sampling as S, signature as G, tools as T
from regulonspark.operators.network import Network

NET = "regulator string, target string, mor double, likelihood double"
N = NormalDist()


def ppf(p):
    return N.inv_cdf(min(max(p, 2.0**-52), 1 - 2.0**-52))


def sf(x):
    return 0.5 * math.erfc(x / math.sqrt(2))


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def frame(spark, x, feature="g", column="feature", value="value"):
    rows = [(f"s{i}", f"{feature}{j:02d}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, f"sample string, {column} string, {value} double")


def random_net(seed, regulators=4, features=14, targets=8):
    rng = np.random.default_rng(seed)
    return [(f"r{k}", f"g{j:02d}", float(rng.uniform(-1, 1)), float(rng.uniform(0.1, 1))) for k in range(regulators) for j in sorted(rng.permutation(features)[:targets])]


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).normal(size=(6, 14))


def edges_of(net, r):
    return [(int(t[1:]), m, l) for a, t, m, l in net if a == r]


def area(x, net):
    n = x.shape[1]
    t2 = np.array([ranks(row) / (n + 1) for row in x])
    t1 = np.abs(t2 - 0.5) * 2
    t1 = t1 + (1 - t1.max()) / 2
    out = {}
    for r in sorted({e[0] for e in net}):
        e = edges_of(net, r)
        total, top = sum(l for *_, l in e), max(l for *_, l in e)
        for i in range(len(x)):
            d = sum(l / total * m * ppf(t2[i, t]) for t, m, l in e)
            u = sum(l / total * (1 - abs(m)) * ppf(t1[i, t]) for t, m, l in e)
            out[f"s{i}", r] = (abs(d) + max(u, 0)) * np.sign(d) * math.sqrt(sum((l / top) ** 2 for *_, l in e))
    return out


def same(got, want, tol=1e-6):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=tol), k


def scores(df):
    return {(r.sample, r.regulator): r.nes for r in df.collect()}


SIGNATURES = {
    None: lambda x: x,
    "scale": lambda x: (x - x.mean(0)) / x.std(0, ddof=1),
    "rank": lambda x: np.apply_along_axis(ranks, 0, x),
    "mad": lambda x: (x - np.median(x, 0)) / (1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)),
    "ttest": lambda x: np.array([[(d := x[i, j] - np.delete(x[:, j], i)).mean() / (d.std(ddof=1) / math.sqrt(len(d))) for j in range(x.shape[1])] for i in range(len(x))]),
    "doublerank": lambda x: (lambda r: (r - np.median(r, 1, keepdims=True)) / (1.4826 * np.median(np.abs(r - np.median(r, 1, keepdims=True)), 1, keepdims=True)))(np.apply_along_axis(ranks, 0, x)),
}


@pytest.mark.parametrize("method", SIGNATURES)
def test_facade_with_every_signature(spark, x, method):
    net = random_net(1, features=14, targets=9)
    used = sorted({int(t[1:]) for _, t, *_ in net})
    cut = SIGNATURES[method](x)[:, used]  # only features of the network are ranked
    place = {t: k for k, t in enumerate(used)}
    small = [(r, f"g{place[int(t[1:])]:02d}", m, l) for r, t, m, l in net]
    got = scores(E.infer_activity(frame(spark, x), Network(spark.createDataFrame(net, NET)), method=method, min_targets=1))
    same(got, area(cut, small))


def test_facade_refuses_what_it_does_not_know(spark, x):
    net = Network(spark.createDataFrame(random_net(1), NET))
    for how in ({"method": "none"}, {"enrichment": "other"}):
        with pytest.raises(ValueError):
            E.infer_activity(frame(spark, x), net, **how)


def test_facade_with_obs_and_two_networks(spark, x):
    nets = [random_net(1), random_net(2, regulators=5)]
    parts = [area(x, n) for n in nets]
    want = {}
    for k in {k for p in parts for k in p}:
        v = [p[k] for p in parts if k in p]
        want[k] = sum(a * abs(a) for a in v) / sum(map(abs, v))
    obs = spark.createDataFrame([("s0", "a"), ("s1", "b")], "sample string, kind string")
    out = E.infer_activity(frame(spark, x), [Network(spark.createDataFrame(n, NET)) for n in nets], min_targets=1, eset_filter=False, obs=obs)
    same(scores(out), want)
    assert {r.sample: r.kind for r in out.collect()}["s1"] == "b"


def logsf(z):
    return math.log(sf(z)) if z < 30 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def combine(d, u, rho):
    plus, minus = logsf((d + u) / math.sqrt(2 + 2 * rho)), logsf((u - d) / math.sqrt(2 - 2 * rho))
    least = min(plus, minus)
    z = -ppf(math.exp(least + math.log(2) + math.log1p(-math.exp(least) / 2) - math.log(2)))
    return z if plus < minus else -z


def narnea(x, net):
    out, n = {}, x.shape[1]
    for i, row in enumerate(x):
        r, s = ranks(np.abs(row)), np.sign(row)
        er, er2, ers, er2s = (n + 1) / 2, (2 * n * n + 3 * n + 1) / 6, (r * s).sum() / n, (r * r * s).sum() / n
        for g in sorted({e[0] for e in net}):
            e = edges_of(net, g)
            a, b = np.array([m * l for _, m, l in e]), np.array([(1 - abs(m)) * l for _, m, l in e])
            t, m, l = (np.array(c) for c in zip(*e))
            vd, vu = (a * a).sum() * (er2 - ers**2), (b * b).sum() * (er2 - er**2)
            rho = (a * b).sum() * (er2s - ers * er) / math.sqrt(vd * vu)
            d, u = (r[t] * s[t] * a).sum(), (r[t] * b).sum()
            zu = (u - b.sum() * er) / math.sqrt(vu)
            nes = combine((d - a.sum() * ers) / math.sqrt(vd), zu, rho)
            best = n - np.array([len({w for w in l if w > v}) for v in l])
            dm, um = (np.abs(m) * l * best).sum(), ((1 - np.abs(m)) * l * best).sum()
            zm = (um - b.sum() * er) / math.sqrt(vu)
            most = combine(((dm if nes > 0 else -dm) - a.sum() * ers) / math.sqrt(vd), zm, rho)
            out[f"s{i}", g] = nes, nes / abs(most)
    return out


def test_narnea(spark, x):
    net = random_net(3)
    got = E.narnea(frame(spark, x), Network(spark.createDataFrame(net, NET)), min_targets=1)
    want = narnea(x, net)
    same({(r.sample, r.regulator): r.nes for r in got.collect()}, {k: v[0] for k, v in want.items()}, 1e-5)
    same({(r.sample, r.regulator): r.pes for r in got.collect()}, {k: v[1] for k, v in want.items()}, 1e-5)
    assert got.where("nes > 0.1 and pes < 10").count() == sum(v[0] > 0.1 and v[1] < 10 for v in want.values())


def test_zeros_and_extreme_modes_are_drawn_alike_each_time(spark, x):
    y = np.where(np.abs(x) < 0.4, 0.0, x)
    net = [(r, t, [1.0, -1.0, 0.0, m][k % 4], l) for k, (r, t, m, l) in enumerate(random_net(3))]
    a, b = (E.narnea(frame(spark, y), Network(spark.createDataFrame(net, NET)), min_targets=1).orderBy("sample", "regulator").collect() for _ in range(2))
    assert a == b and all(math.isfinite(r.nes) and math.isfinite(r.pes) for r in a)
    none = E.narnea(frame(spark, np.zeros((2, 14))), Network(spark.createDataFrame(net, NET)), min_targets=1).collect()
    assert len(none) == 8 and all(r.nes is None for r in none)


def test_missing_values_and_weights(spark, x):
    rng = np.random.default_rng(8)
    net, gone, w = random_net(4), rng.random(x.shape) < 0.2, rng.uniform(0.2, 1, x.shape)
    m = frame(spark, x).join(spark.createDataFrame([(f"s{i}", f"g{j:02d}") for i, j in zip(*np.nonzero(gone))], "sample string, feature string"), ["sample", "feature"], "left_anti")
    m = m.union(spark.createDataFrame([("s0", "g00", None)], "sample string, feature string, value double")) if gone[0, 0] else m
    want = {}
    for i, row in enumerate(x):
        here = np.flatnonzero(~gone[i])
        t2 = dict(zip(here, ranks(row[here]) / (len(here) + 1)))
        t1 = {j: abs(t - 0.5) * 2 for j, t in t2.items()}
        lift = (1 - max(t1.values())) / 2
        for r in sorted({e[0] for e in net}):
            e = [(t, q, l * w[i, t]) for t, q, l in edges_of(net, r) if t in t2]
            d = sum(q * v * ppf(t2[t]) for t, q, v in e)
            u = sum((1 - abs(q)) * v * ppf(t1[t] + lift) for t, q, v in e)
            want[f"s{i}", r] = (abs(d) + max(u, 0)) * (-1 if d < 0 else 1) / sum(v for *_, v in e) * math.sqrt(sum(v * v for *_, v in e)) / max(v for *_, v in e)
    cells = frame(spark, w).withColumnRenamed("value", "weight")
    same(scores(E.area_weighted(m, Network(spark.createDataFrame(net, NET)), cells, min_targets=1)), want)
    whole = scores(E.area_weighted(frame(spark, x), Network(spark.createDataFrame(net, NET)), min_targets=1))
    same(whole, area(x, net))  # distinct values: the lift of each sample is that of all


@pytest.mark.parametrize("method, penalty, shadow", [("adaptive", 20.0, 0.05), ("absolute", 2.0, 0.01)])
def test_pleiotropy(spark, method, penalty, shadow):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5, 60)) + np.linspace(-3, 3, 60)
    # the later regulators respond by less of their targets
    net = [(f"r{k}", f"g{j:02d}", float((1 if rng.random() < 0.1 * k else np.sign(j - 29.5)) * rng.uniform(0.6, 1)), float(rng.uniform(0.5, 1))) for k in range(6) for j in sorted(rng.permutation(60)[:36 - 3 * k])]
    nes = area(x, net)
    want = dict(nes)
    regs = sorted({e[0] for e in net})
    for i in range(len(x)):
        here = [r for r in regs if 2 * sf(abs(nes[f"s{i}", r])) < 0.05]
        if len(here) < 2:
            continue
        p = {}
        for a, b in itertools.permutations(here, 2):
            ea, shared = edges_of(net, a), {t for t, *_ in edges_of(net, b)}
            r = ranks([x[i, t] for t, *_ in ea])
            t_ = 2 * r / (len(ea) + 1) - 1
            u_ = 2 * np.abs(t_) - 1
            u_ = u_ + (1 - u_.max()) / 2
            both = [k for k, (t, *_) in enumerate(ea) if t in shared]
            if len(both) < 6:
                continue
            s1 = sum(ea[k][1] * ea[k][2] * ppf(t_[k] / 2 + 0.5) * np.sign(nes[f"s{i}", a]) for k in both)
            s2 = sum((1 - abs(ea[k][1])) * ea[k][2] * ppf(u_[k] / 2 + 0.5) for k in both)
            ls = [ea[k][2] for k in both]
            p[a, b] = max(1e-300, sf((abs(s1) + max(s2, 0)) / sum(ls) * (-1 if s1 < 0 else 1) * math.sqrt(sum(l * l for l in ls)) / max(ls)))
        cut = {}
        for (a, b), pa in p.items():
            tests, pb = sum(k[0] == a for k in p), p[b, a]
            lost = pa >= shadow > pb if method == "absolute" else pa > pb
            if lost:
                by = penalty ** (1 / tests) if method == "absolute" else (1 + abs(math.log10(pa) - math.log10(pb))) ** (penalty / tests)
                for t in {t for t, *_ in edges_of(net, a)} & {t for t, *_ in edges_of(net, b)}:
                    cut.setdefault(a, {})[t] = cut.get(a, {}).get(t, 1.0) * by
        for a, by in cut.items():
            changed = [(a, f"g{t:02d}", m, l / by.get(t, 1.0)) for t, m, l in edges_of(net, a)]
            want[f"s{i}", a] = area(x, changed)[f"s{i}", a]
    assert want != nes
    m, one = frame(spark, x), Network(spark.createDataFrame(net, NET))
    same(scores(P.correct(m, E.area(m, one, min_targets=1), one, targets=6, penalty=penalty, method=method, shadow=shadow)), want)


def test_conservation(spark):
    rng = np.random.default_rng(12)
    a, b, size = rng.normal(size=(4, 20)) * 2, rng.normal(size=(3, 20)) * 2, 6
    net = [(f"s{i}", f"g{j:02d}", 1.0 if n < size // 2 else -1.0, 1.0) for i, row in enumerate(b) for n, j in enumerate([*np.argsort(-row)[: size // 2], *np.argsort(row)[: size // 2]])]
    want = {}
    nes = area(a, net)
    for s in {k[0] for k in nes}:
        p = sorted((sf(min(nes[s, r], 30.0)), r) for q, r in nes if q == s)
        for n, (_, r) in enumerate(p):
            fdr = min(1.0, min(v * len(p) / (m + 1) for m, (v, _) in enumerate(p) if m >= n))
            want[s, r] = max(0.0, -math.log10(fdr + 1e-300))
    one, other = (frame(spark, v, column="regulator", value="nes") for v in (a, b))
    same({(r.sample, r.reference): r.score for r in T.oncomatch(one, other, size=size).collect()}, want)
    both = T.oncomatch(one, one, size=size, both_ways=True).collect()
    best = {}
    for r in both:
        best[r.sample] = max(best.get(r.sample, (-1, "")), (r.score, r.reference))
    assert all(s == v[1] for s, v in best.items())


def test_path_enrichment_without_a_least_number_of_targets(spark):
    rng = np.random.default_rng(13)
    a = rng.normal(size=(4, 14))
    sets = [("one", "g01", 1.0, 1.0), ("one", "g05", -1.0, 1.0), ("two", "g02", 1.0, 1.0)]
    sets += [("all", f"g{j:02d}", 1.0, 1.0) for j in range(14)]
    act = frame(spark, a, column="regulator", value="nes")
    got = scores(E.path_enrich(act, Network(spark.createDataFrame(sets, NET))))
    want = {}
    for r in ("one", "two", "all"):
        want |= {k: v for k, v in area(a, [e for e in sets if e[0] == r]).items()}
    same(got, want)
    obs = spark.createDataFrame([(f"s{i}", i) for i in range(4)], "sample string, n int")
    wide = E.path_enrich(act, Network(spark.createDataFrame(sets, NET)), obs=obs)
    assert set(wide.columns) == {"sample", "n", "one", "two", "all"} and wide.count() == 4


def test_similarity_by_extremes(spark, x):
    nn, n = 6, x.shape[1]
    w = np.array([np.where(ranks(r) > n - nn / 2, 1.0, np.where(ranks(r) <= nn / 2, -1.0, 0.0)) for r in x])
    size, t = np.sqrt((w * w).sum(1)), np.array([[ppf(v / (n + 1)) for v in ranks(r)] for r in x])
    v = (w / np.abs(w).sum(1, keepdims=True)) @ t.T * size[:, None]
    want = {(f"s{i}", f"s{j}"): v[i, j] if i == j else (v[i, j] ** 3 + v[j, i] ** 3) / (v[i, j] ** 2 + v[j, i] ** 2) for i in range(6) for j in range(6)}
    same({(r.sample_i, r.sample_j): r.similarity for r in D.activity_similarity(frame(spark, x), nn=nn, block=4).collect()}, want)


def test_components_span_the_variance(spark):
    v = np.random.default_rng(14).normal(size=(30, 5)) * [5, 3, 1, 0.5, 0.1]
    f = spark.createDataFrame([(f"s{i:02d}", [float(a) for a in r]) for i, r in enumerate(v)], "sample string, vec array<double>")
    got = np.array([r.vec for r in T.pca(f, 2).orderBy("sample").collect()])
    c = v - v.mean(0)
    got -= got.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    vt *= np.sign(vt[np.arange(5), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(got, (c @ vt.T)[:, :2], atol=1e-6)


def test_dendrogram_heights(spark):
    rng = np.random.default_rng(15)
    v = rng.normal(size=(24, 6))
    f = spark.createDataFrame([(f"s{i}", [float(a) for a in r]) for i, r in enumerate(v)], "sample string, vec array<double>")
    c = spark.createDataFrame([(f"s{i}", str(i % 6)) for i in range(24)], "sample string, cluster string")
    mean = np.array([v[np.arange(24) % 6 == k].mean(0) for k in range(6)])
    d = 1 - np.corrcoef(mean)
    groups, want = [[k] for k in range(6)], []
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(p, q)].mean(), n, m) for n, p in enumerate(groups) for m, q in enumerate(groups) if n < m)
        want.append((h, len(groups[a] + groups[b])))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    got = [(r.height, r.size) for r in T.dendrogram(f, c).orderBy("step").collect()]
    assert [s for _, s in got] == [s for _, s in want] and np.allclose([h for h, _ in got], [h for h, _ in want])


def test_mann_whitney_is_exact_for_small_groups(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(11, 3))
    x[:, 2] = np.round(x[:, 2])  # ties: the normal form
    c = spark.createDataFrame([(f"s{i}", "a" if i < 4 else "b") for i in range(11)], "sample string, cluster string")
    got = {(r.cluster, r.feature): (r.score, r.pval) for r in C.mwu(frame(spark, x), c).collect()}
    for j in range(2):
        u = sum(p > q for p in x[:4, j] for q in x[4:, j])
        r = ranks(x[:, j])
        every = [sum(r[list(k)]) - 10 for k in itertools.combinations(range(11), 4)]
        p = min(1.0, 2 * np.mean([v >= max(u, 28 - u) for v in every]))
        assert got["a", f"g{j:02d}"] == (u, pytest.approx(p)) and got["b", f"g{j:02d}"][1] == pytest.approx(p)
    assert 0 < got["a", "g02"][1] <= 1
    big = C._u_tail(8, 3000)
    assert big[0] == pytest.approx(1) and big[8 * 3000 // 2] == pytest.approx(0.5, abs=1e-3) and (np.diff(big) <= 0).all()


def test_statistics_of_feature_groups(spark, x):
    m = frame(spark, x)
    c = spark.createDataFrame([(f"s{i}", str(i % 2)) for i in range(6)], "sample string, cluster string")
    groups = {"tfs": K.names_frame(spark, ["g01", "g02", "g02"]), "surf": K.names_frame(spark, ["g07", "zz"])}
    for method in C.STATISTICS:
        assert {r.feature for r in C.statistic(method, m, c, groups=groups, wanted=["TF", "surfs"]).collect()} == {"g01", "g02", "g07"}
    assert {r.feature for r in C.top_regulators(m, c, n=1, groups=groups, wanted="tfs").collect()} <= {"g01", "g02"}
    with pytest.raises(ValueError):
        C.statistic("stouffer", m, c, groups=groups, wanted="cotfs")


def test_pvalues_along_regulators(spark, x):
    f = frame(spark, x * 2, column="regulator", value="nes")
    got = {(r.sample, r.regulator): r.pval for r in V.to_pvalues(f, along="regulator").collect()}
    for j in range(14):
        p = sorted((2 * sf(abs(2 * x[i, j])), i) for i in range(6))
        for n, (_, i) in enumerate(p):
            assert got[f"s{i}", f"g{j:02d}"] == pytest.approx(min(1.0, min(v * 6 / (m + 1) for m, (v, _) in enumerate(p) if m >= n)), abs=1e-7)


def test_rank_norm_by_mean_and_deviation(spark, x):
    r = np.apply_along_axis(ranks, 0, x)
    want = (r - r.mean(1, keepdims=True)) / r.std(1, ddof=1, keepdims=True)
    got = {(q.sample, q.feature): q.value for q in G.rank_norm(frame(spark, x), "mean", "std").collect()}
    same(got, {(f"s{i}", f"g{j:02d}"): want[i, j] for i in range(6) for j in range(14)})


def test_repeated_pairs(spark):
    net = Network(spark.createDataFrame([("r", "t", 0.1, 3.0), ("r", "t", 0.2, 5.0), ("r", "t", 0.3, 4.0), ("r", "u", 0.4, 1.0)], NET))
    kept = {k: sorted(r.mor for r in net.remove_duplicate_pairs(k, order="mor").edges.collect()) for k in ("likelihood", "first", "last", False)}
    assert kept == {"likelihood": [0.2, 0.4], "first": [0.1, 0.4], "last": [0.3, 0.4], False: [0.4]}
    with pytest.raises(ValueError):
        net.remove_duplicate_pairs("some")


def test_metacell_knobs():
    rng = np.random.default_rng(17)
    v, depth = rng.normal(size=(120, 6)), np.full(120, 40.0)
    for bad in ({}, {"size": 5}, {"n_cells": 3, "min_median_depth": 90}, {"perc_data_to_use": 50, "perc_incl_data_reused": 10}, {"size": 5, "n_cells": 2, "perc_data_to_use": 50}):
        with pytest.raises(ValueError):
            S.choose_metacells(v, depth, **bad)
    with pytest.raises(ValueError):
        S.choose_metacells(v, depth, size=5, perc_data_to_use=50, spread=False)
    assert S.choose_metacells(v, depth, size=7, min_median_depth=90).shape == (7, 3)
    assert S.choose_metacells(v, depth, size=7, n_cells=2).shape == (7, 2)
    for goal in (30, 60, 90):
        for fixed in ({"size": 8}, {"n_cells": 5}, {"min_median_depth": 190}):
            got = S.choose_metacells(v, depth, perc_data_to_use=goal, **fixed)
            assert goal <= S._shares(got, 120)[0] <= goal + 12
    for goal in (5, 25):
        for fixed in ({"size": 8}, {"n_cells": 5}):
            got = S.choose_metacells(v, depth, perc_incl_data_reused=goal, **fixed)
            assert S._shares(got, 120)[1] <= goal and len(got) > 1
    own = S.choose_metacells(v, depth, size=9, n_cells=4)
    order = np.argsort(S._dist(v), axis=1, kind="stable")
    assert all((order[r[0], :4] == r).all() for r in own)


def test_metacell_members_sums_and_mitochondrial_share(spark):
    rng = np.random.default_rng(18)
    v = spark.createDataFrame([(f"s{i}", [float(a) for a in rng.normal(size=4)]) for i in range(30)], "sample string, vec array<double>")
    counts = spark.createDataFrame([(f"s{i}", g, float(c)) for i in range(30) for g, c in (("MT-1", i), ("MTX", 2), ("A.1", 1 + i % 3))], "sample string, feature string, count double")
    scored = spark.createDataFrame([(f"s{i}", float(i)) for i in range(30)], "sample string, score double")
    members = S.metacell_members(v, counts, size=4, n_cells=3, scores=scored, min_score=10.0)
    rows = members.collect()
    assert len(rows) == 12 and all(int(r.sample[1:]) >= 10 for r in rows)
    got = {(r.metacell, r.feature): r["count"] for r in S.metacell_counts(members, counts).collect()}
    for k in range(4):
        own = [int(r.sample[1:]) for r in rows if r.metacell == k]
        assert got[k, "MT-1"] == sum(own) and got[k, "MTX"] == 6
    stats = S.metacell_stats(members, counts).first()
    assert stats.metacells == 4 and stats.cells_per_metacell == 3 and stats.samples_used == len({r.sample for r in rows})
    share = {r.sample: r.percent for r in S.mito_share(counts).collect()}
    assert share["s0"] == 0 and share["s4"] == pytest.approx(100 * 4 / 8)


def test_dendrogram_of_few_and_many_clusters(spark, monkeypatch):
    f = spark.createDataFrame([("a", [1.0, 2.0, 4.0]), ("b", [2.0, 1.0, 0.0])], "sample string, vec array<double>")
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "sample string, cluster string")
    assert [(r.a, r.b, r.size) for r in T.dendrogram(f, c).collect()] == [("x", "y", 2)]
    assert T.dendrogram(f, c.where("cluster = 'x'")).count() == 0
    monkeypatch.setattr(T, "MOST_CLUSTERS", 1)
    with pytest.raises(ValueError):
        T.dendrogram(f, c)
