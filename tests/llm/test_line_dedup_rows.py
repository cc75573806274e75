"""Line dedup on rows with null or repeated ids."""

from __future__ import annotations

import pytest

from regulonspark.llm import line_dedup as D

COPY = "a line that an earlier document has already"


@pytest.mark.parametrize("shared", [None, 9])
def test_rows_that_share_an_id_lose_only_their_own_lines(spark, shared):
    texts = [(1, COPY), (shared, COPY + "\nsome tail of the first"), (shared, "words found nowhere else at all"), (shared, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id bigint, text string, n_chars bigint")
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed_lines) for r in D.dedup_report(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 0, []), (shared, 2, 1, [0]), (shared, 1, 0, []), (shared, 0, 0, [])], key=repr)
    out = sorted(((r.doc_id, r.text, r.n_chars) for r in D.dedup_lines(docs).collect()), key=repr)
    assert out == sorted([(1, COPY, len(COPY)), (shared, "some tail of the first", 22), (shared, texts[2][1], len(texts[2][1])), (shared, None, 0)], key=repr)
