"""The pipeline's stages one after another, each against a plain version on its own input, and the whole run."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from regulonspark.llm import packing as P, work

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PARTS = {"aa": ["the", "ing", "er", "on"], "bb": ["que", "ado", "los", "ra"]}
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def rows():
    rng = np.random.default_rng(21)

    def words(lang, n):
        return ["".join(rng.choice(PARTS[lang], rng.integers(2, 5))) for _ in range(n)]

    out = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        text = "\n".join(" ".join(words(lang, int(rng.integers(8, 25)))) for _ in range(int(rng.integers(1, 6))))
        out.append([i, text, lang, f"s{i % 4}" if i % 7 else None])
    shared = " ".join(words("aa", 14))
    for i in (3, 9, 20, 41):
        out[i][1] += "\n" + shared  # a line that documents share
    long = words("bb", 120)
    for i, changed in ((60, 0), (61, 2), (62, 40)):  # a document, an edited copy, another one
        copy = list(long)
        for at in rng.choice(120, changed, replace=False):
            copy[at] = "".join(rng.choice(PARTS["bb"], 6))
        out.append([i, " ".join(copy), "bb", "s1"])
    out += [[63, None, "aa", "s0"], [64, "", "bb", "s0"], [65, " ".join("".join(rng.choice(list("xkzw"), 7)) for _ in range(80)), None, "s2"], [None, out[7][1], "bb", "s2"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def near(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in texts]
    label = list(range(len(sets)))
    links = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in sets:
        label = [min(label[j] for j in n) for n in links]
    return label


def without_matching_lines(docs):
    """(row number -> text) after dropping lines that match one of an earlier place."""
    lines = [((d.doc_id is None, d.doc_id or 0, k), n, k, {w for w in WORD.findall(x.lower())}, x) for n, d in enumerate(docs) for k, x in enumerate((d.text or "").split("\n")) if d.text is not None]
    gone = {(n, k) for place, n, k, s, _ in lines if s and any(p < place and o and 9 * len(s & o) >= 4 * (len(s) + len(o)) for p, _, _, o, _ in lines)}
    return {n: d.text if d.text is None else "\n".join(x for k, x in enumerate(d.text.split("\n")) if (n, k) not in gone) for n, d in enumerate(docs)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{folder}/documents.parquet")
    docs, made = spark.read.parquet(f"{folder}/documents.parquet"), {}
    made["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        made[name] = docs.collect()
        assert name == "packing" or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    return folder, made


def key(r):
    return repr((r.doc_id is None, r.doc_id, r.text))


def test_language_stage_drops_what_is_in_no_learnt_language(stages):
    _, made = stages
    gone = {r.doc_id for r in made["documents"]} - {r.doc_id for r in made["language_id"]}
    assert gone == {63, 64, 65} and Counter(map(key, made["language_id"])) <= Counter(map(key, made["documents"]))


def test_line_stage(stages):
    _, made = stages
    docs = made["language_id"]
    want = without_matching_lines(docs)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in made["line_dedup"]) == Counter((d.doc_id, want[n], len(want[n])) for n, d in enumerate(docs))
    assert sum(d.text != want[n] for n, d in enumerate(docs)) >= 3


def test_near_copies_stage(stages):
    _, made = stages
    docs = made["line_dedup"]
    groups: dict[int, list] = {}
    for d, g in zip(docs, near([d.text for d in docs])):
        groups.setdefault(g, []).append(d)
    want = [min(g, key=lambda d: (d.doc_id is None, d.doc_id or 0)) for g in groups.values()]
    assert Counter(map(key, made["simhash"])) == Counter(map(key, want)) and len(want) < len(docs)


def test_mixing_stage(stages):
    _, made = stages
    docs = made["simhash"]
    size = Counter()
    for d in docs:
        size[d.source] += len(WORD.findall(d.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:  # by weight, what is over the double of a source goes to the others
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in full or free:
            target[s] = 2 * size[s] if s in full else level * weight[s]
        left -= sum(2 * size[s] for s in full)
        free = free - full if full else set()
    taken = Counter()
    for r in made["mixing"]:
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    whole = {(d.doc_id, d.source): WORD.findall(d.text or "") for d in docs}
    for r in made["mixing"]:
        own = WORD.findall(r.text)
        assert own == whole[r.doc_id, r.source][: len(own)]
    assert max(Counter(r.doc_id for r in made["mixing"]).values()) <= 2


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    _, made = stages
    tk = Tokenizer.from_file(P.tokenizer_path())
    want = Counter()
    for d in made["mixing"]:
        ids = np.array([*tk.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), P.LENGTH):
            part = ids[k : k + P.LENGTH]
            want[d.doc_id, k // P.LENGTH, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made["packing"]) == want
    by: dict[int, list] = {}
    for r in made["packing"]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= P.LENGTH
    assert len(by) <= -(-sum(r.length for r in made["packing"]) // P.LENGTH) + 1


def test_run_is_all_stages_in_order(spark, stages):
    folder, made = stages
    got = corpus_pipeline.run(spark, folder).collect()

    def place(r):
        return r.doc_id, r.piece, r.start, r.length, r.ids_crc32

    assert Counter(map(place, got)) == Counter(map(place, made["packing"]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "packing"]


@pytest.mark.parametrize("stage", ["language_id", "simhash", "packing"])
def test_python_stages_bound_their_batches(spark, stage, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word and word ', 500) AS text")
    docs = spark.createDataFrame(rows()[:20], DOCS)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    got = long.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) < 2 * work.BATCH_BYTES

    spark.conf.set(setting, "1000")  # a smaller bound stays
    work.bounded_batches(spark)
    assert spark.conf.get(setting) == "1000"
    spark.conf.unset(setting)
