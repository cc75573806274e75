"""Exact top-k from sorted lists: what is read, ties, and rows without a part."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from regulonspark.llm import topk_nra as T


def brute(ids, v, q, k):
    s = v @ v[q]
    return sorted(((-int(s[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]))[:k]


@pytest.mark.parametrize("clustered", [False, True])
def test_lists_are_not_read_to_their_end(clustered):
    rng = np.random.default_rng(int(clustered))
    v = rng.normal(size=(1500, 32)) + (4 * rng.normal(size=(6, 32))[rng.integers(0, 6, 1500)] if clustered else 0)
    v, ids = np.floor(256 * v).astype(np.int64), np.arange(1500)
    got = T.block_winners(ids[::50], v[::50], ids, v, 5)
    for q in range(0, 1500, 50):
        mine = got[got.query_id == q]
        assert sorted(zip(-mine.score, mine.vec_id)) == brute(ids, v, q, 5)
    assert got.read_share.max() < 1


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.01/embeddings.parquet"), reason="no test tables")
def test_share_read_of_the_test_vectors():
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.floor(256 * np.array(t["embedding"].to_pylist(), float)).astype(np.int64)
    got = T.block_winners(ids[ids % 50 == 0], v[ids % 50 == 0], ids, v, 5)
    assert got.groupby("query_id").read_share.first().lt(1).all()


def test_ties_across_blocks_and_repeated_rows(spark):
    rows = [(i, [1.0, float(i % 3), 2.0]) for i in range(90)] + [(50, [1.0, 2.0, 2.0]), (7, [1.0, 2.0, 2.0]), (7, [1.0, 2.0, 2.0]), (None, [9.0, 9.0, 9.0]), (200, [3.0])]
    rows += [(i, [0.0, 0.0, 0.0]) for i in (300, 301)]
    f = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    ids = np.array([i for i, v in rows if i is not None and len(v) == 3])
    v = np.array([np.floor(256 * np.array(v)) for i, v in rows if i is not None and len(v) == 3]).astype(np.int64)
    for blocks in (16, 1000):
        got = {}
        for r in T.top_k(f, candidates=blocks, queries=2).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        # the query with a repeated id asks twice, with another vector each time
        for q in (0, 300):
            at = int(np.flatnonzero(ids == q)[0])
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(brute(ids, v, at, 5))]
        assert sorted(got) == [0, 50, 300] and len(got[50]) == 5
    assert T.top_k(f.where("false")).count() == 0
