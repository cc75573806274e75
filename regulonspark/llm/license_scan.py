"""License scans with winnowed fingerprints and banded alignment.

Templates are cut into words; hashes of word k-grams are winnowed (of every w
neighbours the smallest is kept) and go to an inverted index: hash to
(template, place). A text is winnowed the same way, so that any run of
w + k - 1 words that it shares with a template shares a fingerprint; the
fingerprints name the candidates and the diagonals on which they may lie. On
each group of neighbouring diagonals a local alignment in a band finds the parts that
match; what lies before and after a part is aligned again while it is long enough for
another. The parts of a template are chained, in the order that they have in it and over up to
``GAP`` words of other text, and the chains that cover enough of the template are its matches,
with their spans. So insertions do not hide a licence, and repeated notices are all found.
Where matches overlap, that of more words counts, then that which covers more of its template.

A part needs a fingerprint, so k words in a row as in the template (w + k - 1 for certain).

The templates are a parameter of bounded size and go to every task; texts stay
where they are, so there is no shuffle. A text is scanned whole; only its runs of words that any template
has can match, so the alignment never sees the rest.

Defined results: a null or empty text has no match; every row gives one row
with an array of matches in text order; a template with fewer than k words
cannot be found and is refused; texts of any length are scanned in one pass;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Words of a gram and grams of a window.
K, WINDOW = 3, 2
#: Diagonals on either side, and the least share of a template that counts.
BAND, COVERAGE = 8, 0.8
#: Words of other text between two parts of a match at most, and the least share of a template that is a part.
GAP, PART = 200, 0.15
#: Most words of all templates together.
MOST_WORDS = 200_000
MATCH, MISS = 2, -1

# The texts of public licences.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. ")
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. ")
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Notices by which public licences are declared (licence id, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
     "THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
     "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
     "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

SCHEMA = "matches array<struct<license:string,template:int,coverage:double,matched_words:int,word_start:bigint,word_end:bigint,char_start:bigint,char_end:bigint>>"
_WORDS = re.compile(r"[^\W_]+")
_BLOCK = 1 << 16


def template_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class TemplateIndex:
    def __init__(self, templates=TEMPLATES, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.names = [name for name, _ in templates]
        words = [template_words(t) for _, t in templates]
        if any(len(w) < k for w in words) or sum(map(len, words)) > MOST_WORDS:
            raise ValueError(f"templates need {k} words or more, and {MOST_WORDS} together at most")
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws]) for ws in words]
        # a word's own hash makes the choice of the winnowed grams independent of the order of templates
        self.word_hash = np.array([0] + [xxhash.xxh64_intdigest(w, 1) for w in self.number], np.uint64)
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            for at, h in self.winnowed(ws):
                self.index.setdefault(h, []).append((t, at))

    def grams(self, words: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(words) - self.k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[words[i : i + len(h)]]
                h ^= h >> np.uint64(31)
        return h

    def winnowed(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(place, hash): the smallest hash of every window, the rightmost of equal ones; all if there is one window."""
        h = self.grams(words)
        if not len(h):
            return []
        w = min(self.window, len(h))
        view = np.lib.stride_tricks.sliding_window_view(h[::-1], w)[::-1]
        places = np.unique(np.arange(len(h) - w + 1) + w - 1 - view.argmin(1))
        return [(int(p), int(h[p])) for p in places]

    def align(self, t: int, text: np.ndarray, diagonal: int, band: int, lo: int, hi: int) -> tuple[int, int, int, int, int, int]:
        """(score, matched words, start, end, start and end in the template) of the best local alignment in text[lo:hi] near text place - template place = diagonal."""
        a = self.words[t].tolist()
        first, last = max(0, lo - diagonal - band), min(len(a), hi - diagonal + band)
        base = first + diagonal - band
        near = {j: int(text[j]) for j in range(max(lo, base), min(hi, last + diagonal + band + 1))}
        width = 2 * band + 1
        best = (0, 0, 0, 0, 0, 0)
        # cells by offset from the diagonal: (score, matched, start, template start)
        none = (0, 0, 0, 0)
        above = [none] * width
        for i in range(first, last):
            row = [none] * width
            word, j = a[i], i + diagonal - band - 1
            for o in range(width):
                j += 1
                if (other := near.get(j)) is None:
                    continue
                up = above[o]
                same = word == other
                if up[0] > 0:
                    cell = (up[0] + (MATCH if same else MISS), up[1] + same, up[2], up[3])
                else:
                    cell = (MATCH, 1, j, i) if same else none
                if o + 1 < width and (x := above[o + 1])[0] + MISS > cell[0]:
                    cell = (x[0] + MISS, *x[1:])
                if o and (x := row[o - 1])[0] + MISS > cell[0]:
                    cell = (x[0] + MISS, *x[1:])
                if cell[0] > 0:
                    row[o] = cell
                    if cell[0] > best[0]:
                        best = (cell[0], int(cell[1]), cell[2], j + 1, cell[3], i + 1)
            above = row
        return best

    def parts(self, t: int, text: np.ndarray, diagonal: int, band: int, least: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, end, start and end in the template, matched words) of the best part in the band, then of those before and after it."""
        n = len(self.words[t])
        left = [(max(0, diagonal - band), min(len(text), diagonal + n + band))]
        while left:
            lo, hi = left.pop()
            if hi - lo < least:
                continue
            score, hits, start, end, begin, stop = self.align(t, text, diagonal, band, lo, hi)
            if hits < least:
                continue
            yield start, end, begin, stop, hits
            left += [(lo, start), (end, hi)]

    def chains(self, t: int, parts: list[tuple[int, int, int, int, int]], coverage: float) -> Iterator[tuple[int, int, int]]:
        """(matched words, start, end) of the chains of parts that cover enough of the template, the best first; none shares text with another."""
        n = len(self.words[t])
        longest = max((p[1] - p[0] for p in parts), default=0)
        while parts:
            parts = sorted(parts)
            best = [(p[4], -1) for p in parts]
            for i, p in enumerate(parts):
                for j in range(i - 1, -1, -1):
                    q = parts[j]
                    if p[0] - q[0] > GAP + longest:
                        break
                    if q[1] <= p[0] <= q[1] + GAP and q[3] <= p[2] and best[j][0] + p[4] > best[i][0]:
                        best[i] = (best[j][0] + p[4], j)
            at = max(range(len(parts)), key=lambda i: (best[i][0], -parts[i][1]))
            hits, end = best[at][0], parts[at][1]
            if hits / n < coverage:
                return
            while best[at][1] >= 0:
                at = best[at][1]
            start = parts[at][0]
            yield hits, start, end
            parts = [p for p in parts if p[1] <= start or p[0] >= end]

    def scan_words(self, text: np.ndarray, band: int, coverage: float) -> Iterator[tuple[int, tuple[int, int, int, int, int]]]:
        """(template, part) of all parts in ``text``, a run of word numbers."""
        tried: set[tuple[int, int]] = set()
        for at, h in self.winnowed(text):
            for t, place in self.index.get(h, ()):
                cell = (t, (at - place) // (band + 1))
                if cell in tried:
                    continue
                tried.add(cell)
                # the band reaches as far from every diagonal of the cell
                middle, reach = cell[1] * (band + 1) + band // 2, band + (band + 1) // 2
                n = len(self.words[t])
                for part in self.parts(t, text, middle, reach, max(self.k, int(np.ceil(PART * n)))):
                    yield t, part

    def scan(self, text: str | None, band: int = BAND, coverage: float = COVERAGE) -> list[dict]:
        number = self.number.get
        text = text or ""
        lower = text.lower()
        if len(lower) != len(text):  # lower-casing moved places: map word by word
            lower = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        ids = np.fromiter((number(w, 0) for w in _WORDS.findall(lower)), np.int32)
        # runs of words that templates have, joined over gaps that a band can bridge
        places = np.flatnonzero(ids > 0)
        if len(places) < self.k:
            return []
        found: dict[int, set] = {}
        for run in np.split(places, np.flatnonzero(np.diff(places) > band) + 1):
            if len(run) < self.k:
                continue
            lo, hi = int(run[0]), int(run[-1]) + 1
            part = ids[lo:hi]
            if not (np.convolve(part > 0, np.ones(self.k, np.int64)) == self.k).any():
                continue
            for t, (start, end, begin, stop, hits) in self.scan_words(part, band, coverage):
                found.setdefault(t, set()).add((lo + start, lo + end, begin, stop, hits))
        whole = [(hits, hits / len(self.words[t]), t, start, end) for t, parts in found.items() for hits, start, end in self.chains(t, list(parts), coverage)]
        out: list[dict] = []
        spans = np.array([m.span() for m in _WORDS.finditer(lower)]) if whole else None
        for hits, share, t, start, end in sorted(whole, key=lambda m: (-m[0], -m[1], m[3], m[2])):
            if all(end <= o["word_start"] or start >= o["word_end"] for o in out):
                out.append({"license": self.names[t], "template": t, "coverage": float(min(1.0, share)), "matched_words": hits, "word_start": start,
                            "word_end": end, "char_start": int(spans[start][0]), "char_end": int(spans[end - 1][1])})
        return sorted(out, key=lambda m: (m["word_start"], m["template"]))


def scan(docs: DataFrame, templates=TEMPLATES, *, k: int = K, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, matches for every row of ``docs``."""
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, k, window))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("matched_words", pa.int32()),
                          *((n, pa.int64()) for n in ("word_start", "word_end", "char_start", "char_end"))])
        find = index.value.scan
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = pa.array([find(t, band, coverage) for t in part.column(1).to_pylist()], pa.list_(item))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
