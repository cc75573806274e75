"""License notices that repeat, at every offset and distance."""

from __future__ import annotations

import pytest

from regulonspark.llm import license_scan as S


@pytest.mark.parametrize("text", sorted({t for _, t in S.TEMPLATES}, key=len)[:6])
def test_every_repeat_is_found(text):
    index = S.TemplateIndex()
    t = [x for _, x in S.TEMPLATES].index(text)
    n = len(S.template_words(text))
    for lead in range(20):
        for gap in (0, 1, 4):
            one = " ".join([*["zz"] * gap, text])
            got = [m for m in index.scan(" ".join([*["zz"] * lead, *[one] * 4]))]
            want = [lead + gap + (n + gap) * i for i in range(4)]
            assert [(m["template"], m["word_start"], m["word_end"]) for m in got] == [(t, w, w + n) for w in want]


def test_a_partial_notice_hides_no_whole_one():
    words = S.template_words(S.TEMPLATES[4][1])
    text = " ".join(words[:8] + words)
    assert [(m["template"], m["word_start"], m["coverage"]) for m in S.TemplateIndex().scan(text)] == [(4, 8, 1.0)]
