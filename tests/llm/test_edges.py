"""Odd tables for every operator: none, repeated rows, null ids, columns whose names clash, very long texts."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regulonspark.llm import language_id as L, license_scan as S, line_dedup as D, media_sequences as M, mixing as X, near_copies as N, packing as P
from regulonspark.llm import simhash as H, topk_nra as T, url_filter as U, warc_bundles as B, work

CLASH = ["_d", "_h", "removed_lines", "removed", "own", "of", "place", "many", "a", "b", "salt", "key", "size", "taken", "rows", "row", "ka", "kb", "cut", "fp", "root", "node", "_taken", "text_hash", "line_no"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in CLASH)
ONE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"
TWO = "pack my box with five dozen liquor jugs and then send it by the next train to the far north coast"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(CLASH))) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [(1, ONE, "p"), (1, ONE, "p"), (None, TWO, "q"), (None, TWO + "\nmore", None), (4, None, None), (5, "", "p"), (6, ONE + "\n" + TWO, "q")])


STAGES = [D.dedup_lines, X.mix_documents, H.keep_first, N.keep_first, lambda d: L.keep_accepted(d, L.train(d))]
REPORTS = [D.dedup_report, X.mix_plan, H.near_duplicates, P.pack, S.scan, M.document_media, lambda d: L.identify(d, L.train(d))]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_whatever_their_names(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert tuple(r)[5:] == tuple(range(len(CLASH)))
    assert stage(docs.where("false")).count() == 0


@pytest.mark.parametrize("report", REPORTS)
def test_reports_have_every_row(docs, report):
    out = report(docs).collect()
    ids = sorted((r.doc_id for r in out), key=repr)
    assert ids == sorted([1, 1, None, None, 4, 5, 6], key=repr)
    assert report(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_take_empty_tables(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.where("false"), "").count() == 0


@pytest.fixture(params=[work.SMALL, -1])
def either_join(request, monkeypatch):
    """Tables that are broadcast, and the same as if they were too large for it."""
    monkeypatch.setattr(work, "SMALL", request.param)


def test_lines_that_many_documents_share(spark, either_join):
    rows = [(i, f"{ONE}\nline {i} of its own kind w{i} x{i} y{i}", "s") for i in range(400)]
    got = {r.doc_id: r.removed_lines for r in D.dedup_report(table(spark, rows)).collect()}
    assert got == {i: [0] if i else [] for i in range(400)}


def test_very_long_texts(spark):
    """Texts over the size from which they are read in pieces give the same as in one."""
    words = [f"w{i % 5000}" for i in range(260_000)]
    long = " ".join(words)
    assert len(long) > 1 << 20
    docs = table(spark, [(1, long, "s"), (2, long, "s"), (3, ONE, "s")])
    got = {r.doc_id: r for r in H.near_duplicates(docs).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].fingerprint == f"{H.fingerprint(long) % 2**64:016x}"
    pieces = [r for r in P.pack(docs).collect() if r.doc_id == 1]
    one = P.WordTokenizer(P.tokenizer_path()).encode(long)
    assert sum(r.length for r in pieces) == len(one) // 4 + 1
    assert min(pieces, key=lambda r: r.piece).ids_crc32 == zlib.crc32(one[: 4 * P.LENGTH])
    who = L.train(docs)
    a, b = who.scorer.sums([long])[0], sum(who.scorer.sums([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]))
    assert a == pytest.approx(b)
    assert {r.doc_id: r.n_removed for r in D.dedup_report(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_record_ids_name_one_record_each(spark):
    rows = [(7, "u", h) for h in ("a", "b", "c", "a", "a", None)] + [(None, "u", "a"), (None, None, "z"), (8, "v", "a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    index = B.write_bundles(pages)
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.intact) for r in B.read_records(index).collect()), key=repr)
    assert got == sorted([(7, "response", None, True)] * 6 + [(None, "revisit", 7, True), (None, "response", None, True), (8, "revisit", 7, True)], key=repr)


def test_payloads_that_many_pages_share(spark, either_join):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 5 > 0, "").otherwise(F.col("id").cast("string")).alias("html"))
    got = B.read_records(B.write_bundles(pages)).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to): r["count"] for r in got} == {("response", None): 101, ("revisit", 1): 399}


@pytest.mark.parametrize("html, want", [
    ("<figure><figcaption>Cap</figcaption><img src=a></figure>", [("media", "a", "Cap")]),
    ("<figure><img src=a alt=x><img src=b><figcaption>both <b>of</b> them</figure>after", [("media", "a", "both of them"), ("media", "b", "both of them"), ("text", "after", None)]),
    ("<figure><figcaption>no media</figcaption></figure>", [("text", "no media", None)]),
    ("<figcaption>alone", [("text", "alone", None)]),
    ("<figure><img src=a><figcaption>never closed", [("media", "a", "never closed")]),
    ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("media", "a", "out"), ("media", "b", "in")]),
    ("<p>x<img src=a alt=>y", [("text", "x", None), ("media", "a", ""), ("text", "y", None)]),
])
def test_captions(html, want):
    got = M.parse_html(html)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in got] == want and [i["pos"] for i in got] == list(range(len(want)))


def test_media_of_pages_are_resolved_where_they_are_known(spark):
    pages = spark.createDataFrame([(1, "<p>t</p><img src='sha256:aa'><img src=b>"), (1, "<img src='sha256:aa'>"), (None, None)], "page_id bigint, html string")
    media = spark.createDataFrame([("aa", 5)], "digest string, payload_bytes bigint")
    found = M.resolve(M.sequences(pages, id_col="page_id"), media, id_col="page_id").collect()
    assert sorted((r.page_id, r.pos, r.digest, r.payload_bytes or 0) for r in found) == [(1, 0, "aa", 5), (1, 1, "aa", 5), (1, 2, "b", 0)]


def test_urls_that_many_rows_share(spark, either_join):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'http://a.com/' ELSE concat('http://h', id, '.net/fr/x') END").alias("url"),
                                    F.lit(1).alias("host"), F.lit(2).alias("verdict"))
    got = U.judge_urls(pages, U.rules_frame(spark)).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict): r["count"] for r in got} == {(None, "allow"): 200, ("com/", "allow"): 200, ("net/fr/", "block"): 200}
    none = U.judge_urls(pages, U.rules_frame(spark, []), default="block")
    assert none.columns == ["page_id", "host", "path", "rule", "verdict"] and none.where("rule is null and verdict = 'block'").count() == 600
    assert U.judge_urls(pages.where("false"), U.rules_frame(spark)).count() == 0


def test_vectors_of_an_empty_table(spark):
    assert T.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_media_that_many_documents_share(spark, either_join):
    docs = table(spark, [(i, "" if i % 4 else f"text {i}", "s") for i in range(200)])
    got = M.document_media(docs).groupBy("payload_sha256", "n_bytes").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 50 + [150]
