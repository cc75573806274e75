"""The prefixes and sketches of line dedup against plain versions, and how Spark computes them."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from regulonspark.llm import line_dedup as D
from regulonspark.llm.work import ArrayVariable, written

FAST = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def test_prefixes_and_sketches_are_those_of_a_plain_version(spark):
    texts = [" ".join(f"w{i * k % 97}" for i in range(n)) for k, n in ((1, 3), (2, 40), (3, 79), (5, 80), (7, 81), (1, 97), (0, 9))]
    docs = spark.createDataFrame([(i, t + "\n\nthe tail") for i, t in enumerate(texts)], "doc_id bigint, text string")
    lines = written(D._lines(docs), "test-lines")
    with ArrayVariable(D._levels(lines), "TINYINT") as levels:
        made = D._distinct(lines, levels)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.a, r.b): (r.n, r.lo, r.hi, r.p, r.many) for r in made.collect()}
    # an argument of a lambda is interpreted with it, and so is a sort there
    assert "sort_array(" in plan and "slice(sort_array(" not in plan
    rows = [r for r in lines.collect() if r.hs]
    counts, many = Counter(h % D.COUNTERS for r in rows for h in r.hs), Counter((r.a, r.b) for r in rows)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = {}
    for r in rows:
        n = len(r.hs)
        ranked = sorted(min(127, math.floor(4 * math.log2(counts[h % D.COUNTERS] + 1))) << 56 | h for h in r.hs)
        fold = reduce(lambda s, h: s ^ 1 << (h & 63), r.hs, 0)
        hi = reduce(lambda s, h: s ^ (h >> 6 & 1) << (h & 63), r.hs, 0) if n > D.WIDE else 0
        want[r.a, r.b] = n, signed(fold ^ hi), signed(hi), [h & 0x7FFFFFFF for h in ranked[:n - math.ceil(n * D.NUM / D.DEN) + 1]], many[r.a, r.b]
    assert got == want and max(v[0] for v in want.values()) > D.WIDE


def test_the_session_keeps_its_own_settings(spark):
    docs = spark.createDataFrame([(1, "a line of words\na line of words")], "doc_id bigint, text string")
    for own in (None, "12"):
        spark.conf.unset(FAST) if own is None else spark.conf.set(FAST, own)
        before = spark.conf.get(FAST, None)
        assert [r.removed_lines for r in D.dedup_report(docs).collect()] == [[1]]
        assert spark.conf.get(FAST, None) == before
    spark.conf.unset(FAST)
