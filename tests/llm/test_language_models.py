"""Character models against a plain interpolated Kneser-Ney, and the rejection of what was not learnt."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from regulonspark.llm import language_id as L

ORDER = 4


def plain(words, order):
    """gram -> probability for each order, context -> back-off weight, and the floor, from strings."""
    raw = [Counter() for _ in range(order + 1)]
    for w in words:
        s = f"\x02{w}\x03"
        for end in range(1, len(s)):
            for n in range(1, order + 1):
                if end >= max(1, n - 1):
                    raw[n][s[end - n + 1 : end + 1], end == n - 1] += 1
    flat = [Counter() for _ in range(order + 1)]
    heads = [set() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for (g, head), c in raw[n].items():
            flat[n][g] += c
            if head:
                heads[n].add(g)
    probs, backs, floor = [None], [None, None], None
    for n in range(1, order + 1):
        counts = dict(flat[n])
        if n < order:
            before = Counter(g[1:] for g in flat[n + 1])
            for g in counts:
                if not (n > 1 and g in heads[n]):
                    counts[g] = max(1, before[g])
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(max(once / max(1, once + 2 * twice), 0.1), 0.95)
        if n == 1:
            total = sum(counts.values())
            floor = d * len(counts) / total / 65536
            probs.append({g: max(c - d, 0) / total + floor for g, c in counts.items()})
            continue
        mass, kinds = defaultdict(float), Counter()
        for g, c in counts.items():
            mass[g[:-1]] += c
            kinds[g[:-1]] += 1
        backs.append({c: d * kinds[c] / mass[c] for c in mass})
        probs.append({g: max(c - d, 0) / mass[g[:-1]] + backs[n][g[:-1]] * probs[n - 1].get(g[1:], floor) for g, c in counts.items()})
    return probs, backs, floor


def score(model, word, order):
    probs, backs, floor = model
    s, total = f"\x02{word}\x03", 0.0
    for end in range(1, len(s)):
        p = probs[1].get(s[end], floor)
        for n in range(2, min(order, end + 1) + 1):
            g = s[end - n + 1 : end + 1]
            p = probs[n].get(g, p * backs[n].get(g[:-1], 1.0))
        total += math.log(p)
    return total


def samples(seed=0):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["the", "ing", "er", "on", "a"], "bb": ["que", "ado", "los", "ra", "ñ"], "cc": ["ung", "sch", "ich", "zu", "ß"]}
    return {k: ["".join(rng.choice(p, rng.integers(1, 4))) for _ in range(150)] for k, p in parts.items()}


@pytest.mark.parametrize("dense", [L.DENSE, 0])
def test_models_are_kneser_ney(monkeypatch, dense):
    monkeypatch.setattr(L, "DENSE", dense)
    words = samples()
    # no start-of-word gram of a lower order is also inside a word here, as the start has its own mark
    models = L.Models({k: L.fit_language(w, ORDER) for k, w in words.items()}, ORDER)
    asked = [*words["aa"][:40], *words["bb"][:40], "unseen", "zzz", "x", "日本"]
    got = models.words(asked)
    for k, lang in enumerate(models.langs):
        own = plain(words[lang], ORDER)
        for w, row in zip(asked, got):
            assert row[k] == pytest.approx(score(own, w, ORDER), rel=1e-5, abs=1e-4), (lang, w)
    assert list(got[:, -1]) == [len(w) + 1 for w in asked]


def held_out(spark, n=60, size=60, seed=2, more=()):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["que", "ado", "los", "ra"], "cc": ["ung", "sch", "ich", "zu"]}
    rows = [(i, " ".join("".join(rng.choice(p, 2)) for _ in range(size)), lang) for i, (lang, p) in enumerate((k, p) for _ in range(n) for k, p in parts.items())]
    return spark.createDataFrame([*rows, *more], "doc_id bigint, text string, lang string"), rows


def test_texts_of_no_learnt_language_are_rejected_and_others_kept(spark):
    rng = np.random.default_rng(3)
    foreign = [(5000 + i, " ".join("".join(rng.choice(list("kxqwjvpz"), 6)) for _ in range(40)), None) for i in range(20)]
    short = [(6000 + i, " ".join("".join(rng.choice(["the", "ing", "er"], 2)) for _ in range(1 + i)), None) for i in range(12)]
    docs, rows = held_out(spark, more=[*foreign, *short])
    who = L.train(docs)
    got = {r.doc_id: r for r in L.identify(docs, who).collect()}
    assert all(got[i].accepted and got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].accepted and got[i].lang_pred == "aa" for i, *_ in short)
    assert not any(got[i].accepted for i, *_ in foreign)
    assert L.keep_accepted(docs, who).count() == len(rows) + len(short)


def test_rare_and_long_labels_are_learnt(spark):
    long = (9000, " ".join(["zoo", "zebra", "jazz"] * 9000), "dd")
    docs, _ = held_out(spark, more=[long, (9001, "jazz zebra zoo", None)])
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs, sample_chars=4000)).collect()}
    assert got[9001].lang_pred == "dd" and got[9000].lang_pred == "dd"
    with pytest.raises(ValueError):
        L.train(docs, max_languages=3)
    bounded = L.train(docs, total_chars=4 * 300)
    assert set(bounded.langs) == {"aa", "bb", "cc", "dd"}
