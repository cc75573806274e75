"""Representative subsampling and metacells.

The choice of samples is sequential by nature and runs per cluster, in one
task each with a distance matrix of the cluster's samples. Clusters of more
than ``MOST`` samples are condensed in blocks of near samples, halving until the
rest fits, and their nearest neighbours are found exactly, block by block; the
task holds the cluster's vectors. Sums and statistics are joins and aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples that are paired with one distance matrix (of 3.2 GB) at most, samples of a block of larger clusters (even), and cells of a block of distances.
MOST, BLOCK, CELLS = 20_000, 2_000, 1 << 25
#: Rounds of swaps of representatives at most.
SWEEPS = 100


def _unit(v: np.ndarray) -> np.ndarray:
    v = v - v.mean(1, keepdims=True)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _dist(v: np.ndarray) -> np.ndarray:
    v = _unit(v)
    d = np.sqrt(np.maximum(0.0, 1.0 - np.clip(v @ v.T, -1, 1)))
    np.fill_diagonal(d, 0.0)
    return d


def sample_pairs(d: np.ndarray, size: int, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """``size`` samples in random order and the nearest free neighbour of each; both leave the pool."""
    free = np.ones(len(d), bool)
    chosen, partners = [], []
    for i in rng.permutation(len(d)):
        if len(chosen) == size:
            break
        if not free[i]:
            continue
        free[i] = False
        chosen.append(int(i))
        if free.any():
            others = np.flatnonzero(free)
            j = int(others[np.argmin(d[i, others])])
            free[j] = False
            partners.append(j)
        else:
            partners.append(int(i))
    return chosen, partners


def _nearest(v: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest of every sample, itself among them, from blocks of the distance matrix."""
    v = _unit(v)
    out = np.empty((len(v), min(k, len(v))), np.int64)
    step = max(1, CELLS // len(v))
    for lo in range(0, len(v), step):
        d = np.sqrt(np.maximum(0.0, 1.0 - np.clip(v[lo : lo + step] @ v.T, -1, 1)))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = 0.0
        out[lo : lo + step] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def _pairs(points: np.ndarray, size: int, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """``sample_pairs`` of all points, or in blocks of points on the same sides of random planes if they are many."""
    n = len(points)
    if n <= MOST:
        return sample_pairs(_dist(points), size, rng)
    sides = _unit(points) @ rng.normal(size=(points.shape[1], 16)) > 0
    order = np.lexsort(np.logical_xor.accumulate(sides, axis=1).T[::-1])  # Gray order keeps neighbouring blocks near
    chosen, partners = [], []
    for lo in range(0, n, BLOCK):
        at = order[lo : lo + BLOCK]
        a, b = sample_pairs(_dist(points[at]), size * (lo + len(at)) // n - size * lo // n, rng)
        chosen += at[a].tolist()
        partners += at[b].tolist()
    return chosen, partners


def representative(v: np.ndarray, size: int, seed: int = 0) -> list[int]:
    """Indices of ``size`` samples that stand for all: halve by condensing nearest pairs, then sample."""
    n = len(v)
    if size >= n:
        return list(range(n))
    rng = np.random.default_rng(seed)
    points, members = v.astype(float), [[i] for i in range(n)]
    while len(points) >= 2 * size:
        if len(points) % 2:
            drop = int(rng.integers(len(points)))
            points, members = np.delete(points, drop, 0), members[:drop] + members[drop + 1 :]
        a, b = _pairs(points, len(points) // 2, rng)
        points, members = (points[a] + points[b]) / 2, [members[i] + members[j] for i, j in zip(a, b)]
    if len(points) > size:
        few = min(size, len(points) - size)
        picked, _ = _pairs(points, few, rng)
        if few < size:  # the rest is smaller: leave representatives of it out
            picked = sorted(set(range(len(points))) - set(picked))
    else:
        picked = list(range(len(points)))
    return sorted(int(rng.choice(members[i])) for i in picked)


def repr_subsample(vectors: DataFrame, size: int = 1000, seed: int = 0, clusters: DataFrame | None = None) -> DataFrame:
    """cluster, sample: ``size`` representatives of each cluster (of all samples if there are none)."""
    v = vectors.withColumn("cluster", F.lit("0")) if clusters is None else vectors.join(clusters.toDF("sample", "cluster"), "sample")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample").reset_index(drop=True)
        return g.loc[representative(np.stack(g["vec"].to_numpy()), size, seed), ["cluster", "sample"]].astype(str)

    return v.select("cluster", "sample", "vec").groupBy("cluster").applyInPandas(run, "cluster string, sample string")


class _Near:
    """The nearest of every sample, itself first; found anew only when more are asked for than before."""

    def __init__(self, v: np.ndarray):
        self.v, self.held = v.astype(float), np.empty((len(v), 0), np.int64)

    def __call__(self, k: int) -> np.ndarray:
        if k > self.held.shape[1]:
            self.held = _nearest(self.v, min(len(self.v), max(k, 2 * self.held.shape[1])))
        return self.held[:, :k]


def _groups(order: np.ndarray, rows: list[int], spread: bool) -> np.ndarray:
    """The members of each of ``rows``: its nearest; with ``spread``, rows are swapped for ones that reuse less."""
    rows = list(rows)
    if spread:
        use = np.bincount(order[rows].ravel(), minlength=len(order))
        taken = np.zeros(len(order), bool)
        taken[rows] = True
        for _ in range(SWEEPS):
            moved = False
            for at, r in enumerate(rows):
                use[order[r]] -= 1
                cost = use[order].sum(1).astype(float)
                taken[r] = False
                cost[taken] = np.inf
                best = int(np.argmin(cost))
                if cost[best] < cost[r]:
                    rows[at], moved = best, True
                taken[rows[at]] = True
                use[order[rows[at]]] += 1
            if not moved:
                break
    return order[rows]


def _shares(groups: np.ndarray, n: int) -> tuple[float, float]:
    """Percent of samples used, and of those the percent used more than once."""
    use = np.bincount(groups.ravel(), minlength=n)
    return 100.0 * (use > 0).mean(), 100.0 * (use > 1).sum() / max(1, (use > 0).sum())


def _fitted(share, goal: float, most: int, at_least: bool) -> int:
    """The smallest number whose share reaches the goal, or the largest whose share does not pass it.

    Shares grow with the number but for small dips, so the steps around the bisection's
    result are tried too; if no number will do, the nearest share counts.
    """
    known: dict[int, float] = {}

    def ask(x: int) -> float:
        if x not in known:
            known[x] = share(x)
        return known[x]

    high = 1
    while high < most and ask(high) < goal:
        high = min(most, 2 * high)
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if ask(mid) >= goal else (mid, high)
    for x in range(max(1, high - 3), min(most, high + 3) + 1):
        ask(x)
    good = [x for x, s in known.items() if (s >= goal if at_least else s <= goal)]
    if good:
        return min(good) if at_least else max(good)
    return min(known, key=lambda x: (abs(known[x] - goal), x))


def choose_metacells(v: np.ndarray, depth: np.ndarray, *, size=None, n_cells=None, min_median_depth=None, perc_data_to_use=None,
                     perc_incl_data_reused=None, seed: int = 0, spread: bool = True) -> np.ndarray:
    """Members (size x k) from exactly two of the five knobs.

    Depth stands for the number of cells, so these two exclude each other; so do the two
    shares. The share of samples used is reached, that of samples used again is not passed,
    where any number can; a size over the number of samples is that number.
    """
    given = {k for k, x in dict(size=size, n_cells=n_cells, depth=min_median_depth, used=perc_data_to_use, reused=perc_incl_data_reused).items() if x is not None}
    if len(given) != 2 or given in ({"n_cells", "depth"}, {"used", "reused"}):
        raise ValueError("give exactly two of size, n_cells, min_median_depth, perc_data_to_use, perc_incl_data_reused; "
                         "cells and depth exclude each other, and so do the two shares")
    if not spread and given & {"used", "reused"}:
        raise ValueError("a share can only be met where reuse is kept small")
    n, near = len(v), _Near(v)
    size = min(size, n) if size is not None else None
    k = n_cells if n_cells is not None else int(np.ceil(min_median_depth / depth.mean())) if min_median_depth is not None else None
    k = max(1, min(k, n)) if k is not None else None
    if size is not None and k is not None:
        return _groups(near(k), representative(v, size, seed), spread)
    which = 0 if perc_data_to_use is not None else 1
    goal = perc_data_to_use if perc_data_to_use is not None else perc_incl_data_reused
    rows = representative(v, size, seed) if size is not None else None

    def made(x: int) -> np.ndarray:
        return _groups(near(x), rows, spread) if rows is not None else _groups(near(k), representative(v, x, seed), spread)

    return made(_fitted(lambda x: _shares(made(x), n)[which], goal, n, which == 0))


def metacell_members(vectors: DataFrame, counts: DataFrame, clusters: DataFrame | None = None, *, scores: DataFrame | None = None,
                     min_score: float | None = None, **knobs) -> DataFrame:
    """cluster, metacell, sample: the members of each metacell; samples below ``min_score`` are left out first."""
    depth = counts.groupBy("sample").agg(F.sum("count").alias("depth"))
    v = vectors.join(depth, "sample")
    if scores is not None and min_score is not None:
        v = v.join(scores.toDF("sample", "score"), "sample").where(F.col("score") >= min_score)
    v = v.withColumn("cluster", F.lit("0")) if clusters is None else v.join(clusters.toDF("sample", "cluster"), "sample")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample").reset_index(drop=True)
        got = choose_metacells(np.stack(g["vec"].to_numpy()), g["depth"].to_numpy(), **knobs)
        return pd.DataFrame({"cluster": str(g["cluster"].iloc[0]), "metacell": np.repeat(np.arange(len(got)), got.shape[1]),
                             "sample": g["sample"].to_numpy()[got.ravel()]})

    return v.select("cluster", "sample", "vec", "depth").groupBy("cluster").applyInPandas(run, "cluster string, metacell int, sample string")


def metacell_counts(members: DataFrame, counts: DataFrame) -> DataFrame:
    """cluster, metacell, feature, count: summed counts of the members."""
    return members.join(counts, "sample").groupBy("cluster", "metacell", "feature").agg(F.sum("count").alias("count"))


def mito_share(counts: DataFrame, by: str = "sample", prefix: str = "MT-") -> DataFrame:
    """by, percent: the share of counts whose feature starts with ``prefix``."""
    return counts.groupBy(by).agg(F.coalesce(F.try_divide(
        100 * F.sum(F.when(F.col("feature").startswith(prefix), F.col("count")).otherwise(0.0)), F.sum("count")), F.lit(0.0)).alias("percent"))


def metacell_stats(members: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per cluster: how the samples are used and how deep the metacells are."""
    use = members.groupBy("cluster", "sample").agg(F.count("*").alias("times"))
    u = use.groupBy("cluster").agg(
        F.count("*").alias("samples_used"), (100 * F.avg(F.when(F.col("times") > 1, 1.0).otherwise(0.0))).alias("perc_reused"),
        F.avg("times").alias("mean_use"), F.stddev_pop("times").alias("std_use"))
    size = members.groupBy("cluster", "metacell").agg(F.count("*").alias("cells"))
    depth = metacell_counts(members, counts).groupBy("cluster", "metacell").agg(F.sum("count").alias("depth"))
    s = size.join(depth, ["cluster", "metacell"]).groupBy("cluster").agg(
        F.count("*").alias("metacells"), F.avg("cells").alias("cells_per_metacell"), F.median("depth").alias("median_depth"), F.avg("depth").alias("mean_depth"))
    return s.join(u, "cluster")
