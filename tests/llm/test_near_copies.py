"""The pipeline's near-dedup stage against brute force."""

from __future__ import annotations

import numpy as np

import pytest

import corpus_pipeline
from regulonspark.llm import near_copies as N, simhash as H

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e") for i, t in rows], DOCS)
    out = corpus_pipeline.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def brute(rows):
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in rows:
        label = [min(label[j] for j in n) for n in near]
    return {g: [rows[i] for i in range(len(rows)) if label[i] == g] for g in label}


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"e{rng.integers(1 << 30)}"
    return " ".join(words)


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(3)
    rows = [(None, None), (900, ""), (901, "a b"), (902, "A  b"), (903, "a c")]
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(60, 300)))]
        rows += [(100 * g + j, edited(rng, base, int(rng.integers(0, len(base) // 25)))) for j in range(12)]
    groups = brute(rows)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert 12 < len(groups) < len(rows) - 12
    assert kept(spark, rows) == sorted(want, key=repr)


def test_prefix_has_as_many_as_the_filter_needs(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n + 4)), "en", "s", 0, "e") for n in range(1, 30)], DOCS)
    for r in N._marked(docs, 5).collect():
        assert (r.n, len(r.p)) == (r.doc_id, r.n - -(-4 * r.n // 5) + 1)


@pytest.mark.parametrize("keep", [H.keep_first, N.keep_first])
def test_rows_are_told_apart_without_their_ids(spark, keep):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (None, d), (5, e), (5, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "e") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in keep(docs).collect()), key=repr)
    assert got == sorted([(None, a), (None, b), (7, c), (3, d), (5, e)], key=repr)
