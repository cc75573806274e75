"""Clusters with more samples than one distance matrix takes."""

from __future__ import annotations

import numpy as np
import pytest

from regulonspark.operators import sampling as S


@pytest.mark.parametrize("size", [10, 250, 600, 999])
def test_large_clusters_get_their_representatives(monkeypatch, size):
    monkeypatch.setattr(S, "MOST", 100)
    monkeypatch.setattr(S, "BLOCK", 40, raising=False)
    rng = np.random.default_rng(1)
    groups = np.arange(1001) % 5
    v = rng.normal(size=(5, 8))[groups] + rng.normal(size=(1001, 8)) / 50
    got = S.representative(v, size)
    assert len(got) == len(set(got)) == size and set(groups[got]) == set(range(5))


def test_metacells_of_large_clusters_have_the_nearest(monkeypatch):
    rng = np.random.default_rng(2)
    v, depth = rng.normal(size=(300, 6)), np.ones(300)
    order = np.argsort(S._dist(v), axis=1, kind="stable")
    monkeypatch.setattr(S, "MOST", 100)
    monkeypatch.setattr(S, "CELLS", 7 * 300, raising=False)
    got = S.choose_metacells(v, depth, size=20, n_cells=5)
    assert got.shape == (20, 5) and all((order[r[0], :5] == r).all() for r in got)


def test_a_cluster_over_the_limit():
    v = np.random.default_rng(3).normal(size=(20_001, 4))
    assert len(S.representative(v, 1000)) == 1000
