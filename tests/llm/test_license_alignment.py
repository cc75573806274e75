"""Licence scans against a whole-text alignment, and texts with insertions or near variants."""

from __future__ import annotations

import numpy as np
import pytest

from regulonspark.llm import license_scan as S


def smith_waterman(a, b):
    """(score, matched words) of the best local alignment of two word lists, without a band."""
    best = (0, 0)
    above = [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b, 1):
            s, h = above[j - 1]
            cell = max((s + (S.MATCH if x == y else S.MISS), h + (x == y)), (above[j][0] + S.MISS, above[j][1]), (row[j - 1][0] + S.MISS, row[j - 1][1]), (0, 0))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best


@pytest.mark.parametrize("seed", range(6))
def test_planted_notices_match_as_a_whole_alignment_does(seed):
    rng = np.random.default_rng(seed)
    templates = [(f"L{k}", " ".join(f"w{x}" for x in rng.integers(0, 400, int(rng.integers(12, 40))))) for k in range(4)]
    index = S.TemplateIndex(templates)
    for _ in range(12):
        words, planted = [f"z{x}" for x in rng.integers(0, 99, 30)], []
        for k in rng.permutation(4)[: rng.integers(0, 4)]:
            own = templates[k][1].split()
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(own)))
                if rng.random() < 0.5:
                    own[at] = f"y{rng.integers(99)}"
                else:
                    own.insert(at, f"y{rng.integers(99)}")
            planted.append(k)
            words += own + [f"z{x}" for x in rng.integers(0, 99, int(rng.integers(30, 60)))]
        got = {m["template"]: m for m in index.scan(" ".join(words))}
        for k, (_, text) in enumerate(templates):
            own = text.split()
            score, hits = smith_waterman(own, words)
            if hits / len(own) >= S.COVERAGE:
                assert got[k]["matched_words"] >= hits and got[k]["coverage"] >= hits / len(own)
            else:
                assert k not in got
        assert set(got) <= set(planted)


def full(name):
    return max((t for n, t in S.TEMPLATES if n == name), key=len)


def scan(text, **how):
    return [(m["license"], round(m["coverage"], 2)) for m in S.TemplateIndex(**how).scan(text)]


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"])
def test_whole_licences_are_told_apart(name):
    assert scan(f"Copyright 2020 somebody\n\n{full(name)}\n\nthe end") == [(name, 1.0)]


def test_an_insertion_does_not_hide_a_licence():
    words = full("ISC").split()
    inside = " ".join(f"q{i}" for i in range(60))
    found = S.TemplateIndex().scan(" ".join([*words[:50], inside, *words[50:]]))
    assert [(m["license"], m["coverage"]) for m in found] == [("ISC", 1.0)]
    assert found[0]["word_end"] - found[0]["word_start"] == len(S.template_words(full("ISC"))) + 60
    far = " ".join(f"q{i}" for i in range(S.GAP + 20))
    assert scan(" ".join([*words[:50], far, *words[50:]])) == []


def test_halves_far_apart_or_in_the_wrong_order_are_no_match():
    words = full("ISC").split()
    assert scan(" ".join([*words[60:], "x y z", *words[:60]])) == []


def test_grams_of_another_size():
    two = [("T", "alpha beta"), ("U", "gamma delta epsilon zeta")]
    assert scan("one alpha beta two gamma delta epsilon zeta", templates=two, k=2, window=1) == [("T", 1.0), ("U", 1.0)]
    with pytest.raises(ValueError):
        S.TemplateIndex(two, k=3)
