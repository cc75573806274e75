"""The corpus operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from regulonspark.llm import language_id as L, license_scan as S, line_dedup as D, media_sequences as M, mixing as X, packing as P
from regulonspark.llm import simhash as H, topk_nra as T, url_filter as U, warc_bundles as B

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near water"


def table(spark, texts, **how):
    return spark.createDataFrame([(i, t, "en" if t and "the" in t else "xx", f"s{i % 3}", len(t or ""), "e") for i, t in enumerate(texts)], DOCS)


TEXTS = [BASE, BASE, None, "", "   \n\t\n", BASE + " tonight\nsecond line of this text here", "a\nb\na\n" + BASE, "x" * 5000, " ".join(["word"] * 9000),
         "second line of this text here", "Ünïcödé ΣΑΣ çà \u3000 日本語 <|endoftext|> 12 's don't", BASE.replace("owls", "cats").replace("old", "big")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark, docs):
    lines = [(i, k, l, {w for w in re.split(r"[\x20\x09-\x0d]+", l.lower()) if w}) for i, t in enumerate(TEXTS) for k, l in enumerate((t or "").split("\n")) if t is not None]
    want = {i: [] for i in range(len(TEXTS))}
    for n, (i, k, _, s) in enumerate(lines):
        if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for *_, o in lines[:n] if o):
            want[i].append(k)
    got = {r.doc_id: r.removed_lines for r in D.dedup_report(docs).collect()}
    assert got == want
    assert D.dedup_lines(docs).columns == docs.columns and D.dedup_lines(docs).count() == len(TEXTS)
    assert D.dedup_report(empty(spark)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1", "https://b.example.com/en/1?q", "http://x.net/fr/", "http://x.net/fr", "http://y.com", None, "nothing", "x://com:80/", "http://example.com/EN/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rules_frame(spark)).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("y.com", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("com:80", "/", None, "allow") and got[9][2] == "com/"
    tight = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rules_frame(spark), blocks=1).collect()}
    assert tight == got


def test_exact_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [])]
    f = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = np.floor(256 * np.float32(v).astype(float)).astype(int)
    got = {}
    for r in T.top_k(f, candidates=64, queries=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 50))
    for q, found in got.items():
        s = whole @ whole[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(found) == [(n + 1, i, s[i]) for n, i in enumerate(best)]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70000, "<p>b</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, 1) for i, h in enumerate(html)], "page_id bigint, url string, html string, extra int")
    got = {r.page_id: r for r in B.read_records(B.write_bundles(pages, frame_bytes=1000)).collect()}
    assert len(got) == 6 and all(r.intact for r in got.values())
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.refers_to is not None} == {2: ("revisit", 1), 3: ("revisit", 0)}
    assert B.read_records(B.write_bundles(pages.where("false"))).count() == 0


def test_mixing(spark, docs):
    rows = X.mix_plan(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=3)
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 0.5 and all(r.taken <= 2 * r["size"] for r in g)
    mixed = X.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert X.mix_plan(empty(spark)).count() == 0


def test_media_round_trip(spark, docs):
    got = {r.doc_id: r for r in M.document_media(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        whole = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(whole), zlib.crc32(whole[-16:]))
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and M.decode_png(M.encode_png(whole)) == whole
    assert got[0].feature == got[1].feature


def test_html_sequence():
    items = M.parse_html("<p>One <b>two</b></p><figure><img src='sha256:aa'><figcaption>cap &amp; tion</figcaption></figure><script>x</script>tail")
    assert [(i["pos"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        (0, "text", "One two", None), (1, "media", "sha256:aa", "cap & tion"), (2, "text", "tail", None)]
    assert M.parse_html(None) == []


def simhash(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in H.near_duplicates(docs).collect()}
    fps = {i: simhash(t) for i, t in enumerate(TEXTS)}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    label = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            label[i] = min(label[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert label == {i: r.component_id for i, r in got.items()}
    assert H.keep_first(docs).count() == len(set(label.values())) and H.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("tile", [8, 10_000])
def test_gray_index_links(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    codes = np.unique(base[rng.integers(0, 6, 200)] ^ (1 << rng.integers(0, 60, 200)) ^ (1 << rng.integers(0, 60, 200)))
    f = spark.createDataFrame([(int(c),) for c in codes], "fp bigint")
    root = {r.node: r.root for r in H.components(H.near_links(f, bucket=16, tile=tile)).collect()}
    u = codes.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 3
    label = np.arange(len(codes))
    for _ in codes:
        label = np.array([label[n].min() for n in near])
    assert len({(int(a), root.get(int(c), int(c))) for a, c in zip(label, codes)}) == len(set(label)) == len({root.get(int(c), int(c)) for c in codes})


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.tokenizer_path())
    got = P.pack(docs).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    n = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            r, part = pieces[i, k // 4096], ids[k : k + 4096]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(part.tobytes()))
            n += 1
    assert n == len(got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= 4096
    assert P.pack(empty(spark)).count() == 0


def test_plan_is_near_the_least():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 4096)
    plan = P.make_plan(np.bincount(sizes, minlength=4097))
    assert sum(plan.used.values()) == len(sizes) and plan.sequences <= 1.01 * sizes.sum() / 4096 + 1


def test_license_scan(spark):
    texts = ["x y z. Released under the MIT License. Bye", "This work is licensed under the GNU General Public License, version 3.", "released under nothing", None, "",
             "Licensed under the Apache Licence, Version 2.0."]
    got = {r.doc_id: r.matches for r in S.scan(table(spark, texts)).collect()}
    assert [m.license for m in got[0]] == ["MIT"] and texts[0][got[0][0].char_start : got[0][0].char_end] == "Released under the MIT License"
    assert [m.license for m in got[1]] == ["GPL-3.0"] and got[1][0].coverage == 1.0
    assert got[2] == got[3] == got[4] == [] and [m.license for m in got[5]] == ["Apache-2.0"] and got[5][0].coverage < 1


def test_language_id(spark):
    rng = np.random.default_rng(1)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["que", "ado", "los", "ra"], "cc": ["ung", "sch", "ich", "zu"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(60)), lang, "s", 1, "e"))
    rows += [(900, None, "aa", "s", 0, "e"), (901, "123 !?", "aa", "s", 0, "e"), (902, "", None, None, 0, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    who = L.train(docs.where(L.doc_residue() != 2))
    got = {r.doc_id: r for r in L.identify(docs, who).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == lang and got[i].accepted for i, _, lang, *_ in rows[:240])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = L.keep_accepted(docs, who)
    assert kept.columns == docs.columns and kept.count() == 240
    assert L.identify(docs, L.train(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
