"""Packing documents into sequences by fitting patterns of lengths to the histogram.

Documents become token ids and end with one id more; those longer than a
sequence are cut. What the driver sees is the histogram of piece lengths, of
as many entries as a sequence has tokens, whatever the corpus. On it:

1. Lengths are grouped in bins; every way to fill a sequence with at most
   three bins is a pattern; non-negative least squares fits how often each
   pattern repeats, so that the patterns together use up the histogram.
2. The repeat counts are rounded down and realised with actual lengths, the
   last piece of a pattern being the longest that still fits.
3. What remains is packed by best fit, longest first, into the gaps that the
   patterns left and then into new sequences.

The plan maps runs of ranks within a length to runs of sequences. Pieces are
ranked within their length by (hash bucket, row), with buckets that follow the most
frequent length, so one that a third of all pieces have is dealt over many tasks, and
each piece looks its place up.

Defined results: a null or empty text is the end id alone, one piece of length
1; repeated rows are packed as rows of their own; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read. Texts are tokenized whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .work import written

LENGTH = 4096
END_ID = 1
#: Bins of the fit and pieces of a pattern.
BINS, DEPTH = 128, 3
#: Hash buckets of a length at least, and pieces of one length that are ranked together, about, beyond which there are more.
BUCKETS, RANKED = 256, 50_000
#: Words that a task remembers the ids of, and the longest it remembers.
CACHE, CACHED_WORD = 150_000, 48
#: Characters that are tokenized at once.
_LONG = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Word to the ranks of its tokens, as bytes; forgets everything when it is full."""

    def __init__(self, piece):
        super().__init__()
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        ranks = array("I", self.piece(word.encode() + WordTokenizer.end)).tobytes()
        if len(word) <= CACHED_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ranks
        return ranks


class WordTokenizer:
    """Ids of texts, equal to those of the ``tokenizers`` library for its word vocabulary.

    That vocabulary never joins what white space separates. Chunks of plain
    Latin letters, digits and punctuation go through a byte-pair core that holds
    the same merges, with the end of a word as one more byte, and the words'
    results are remembered; blocks with anything else go through the library.
    """

    end = b"\xff"  # no byte of UTF-8 text
    _plain = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
    _parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {
            chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

        def as_bytes(token: str) -> bytes:
            stem = token.removesuffix("</w>")
            return bytes(alphabet[c] for c in stem) + self.end * (stem != token)

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + self.end] = len(ranks)
        for a, b in model["merges"]:
            ranks[as_bytes(a) + as_bytes(b)] = len(ranks)
        self.ids = np.zeros(len(ranks), "<u4")
        for token, i in model["vocab"].items():
            if token not in ("<|startoftext|>", "<|endoftext|>") and (at := ranks.get(as_bytes(token))) is not None:
                self.ids[at] = i
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known = _Known(core.encode_single_piece)

    @cached_property
    def full(self):
        """The library's tokenizer; tasks that meet plain text only never load it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if self._plain.fullmatch(text) and "<|" not in text:
            ranks = b"".join(map(self.known.__getitem__, self._parts.findall(text.lower())))
            return self.ids[np.frombuffer(ranks, "=u4")].tobytes()
        if (spaced := text.split(" ")) and len(spaced) > 1:
            # only the words between blanks that hold other characters are left to the library
            return b"".join(map(self.encode, _runs(spaced, self._plain)))
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _runs(words: list[str], plain: re.Pattern) -> Iterator[str]:
    """Neighbouring plain words joined again; the others, one by one."""
    run: list[str] = []
    for w in words:
        if plain.fullmatch(w) and "<|" not in w:
            run.append(w)
        else:
            if run:
                yield " ".join(run)
            run = []
            yield w
    if run:
        yield " ".join(run)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_blocks(text: str | None, tokenizer: WordTokenizer) -> Iterator[bytes]:
    """The ids of a text, block by block; blocks end at a blank or a line end."""
    text, at = text or "", 0
    while len(text) - at > _LONG:
        end = max(text.rfind(" ", at, at + _LONG), text.rfind("\n", at, at + _LONG))
        if end <= at:
            end = min((x for x in (text.find(" ", at + _LONG), text.find("\n", at + _LONG)) if x > 0), default=len(text))
        yield tokenizer.encode(text[at:end])
        at = end
    yield tokenizer.encode(text[at:])


def cut(text: str | None, tokenizer: WordTokenizer, length: int = LENGTH, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of ids) of one document."""
    step, out, held = 4 * length, [], b""
    for block in (b for part in (token_blocks(text, tokenizer), [np.array([end_id], "<u4").tobytes()]) for b in part):
        held += block
        while len(held) > step:  # a full piece is kept until more follows, so that the end is never alone by mistake
            out.append((len(out), len(out) * length, length, zlib.crc32(held[:step])))
            held = held[step:]
    out.append((len(out), len(out) * length, len(held) // 4, zlib.crc32(held)))
    return out


def pieces(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found, rows = [], []
                for i, text in enumerate(batch.column(1).slice(lo, 256).to_pylist()):
                    new = cut(text, tokenizer, length, end_id)
                    found += new
                    rows += [lo + i] * len(new)
                cols = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = np.where(passive, -np.inf, a.T @ (b - a @ x))
        best = int(gain.argmax())
        if gain[best] <= small:
            break
        passive[best] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or z[passive].min() > 0:
                break
            bad = passive & (z <= 0)
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x += step * (z - x)
            passive &= x > 1e-9
            x[~passive] = 0
        x = z
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill ``bins`` with at most ``depth`` parts, the largest first."""
    def fill(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for p in range(min(left, most), (left - 1) // parts, -1):
                yield from ((p, *rest) for rest in fill(left - p, p, parts - 1))
    return list(fill(bins, bins, depth))


class Plan:
    """Runs of ranks within a length, and where they go."""

    def __init__(self) -> None:
        self.sequences = 0
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, offset, copies in a sequence

    def add(self, runs: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences, each with ``copies`` pieces of every (length, copies)."""
        offset = 0
        for length, copies in runs:
            first = self.used.get(length, 0)
            self.rows.append((length, first, self.sequences, offset, copies))
            self.used[length] = first + copies * times
            offset += length * copies
        self.sequences += times

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return (rows[:, 0] << 48) + rows[:, 1], *rows.T


def _longest(counts: np.ndarray, low: int, high: int) -> int:
    """The longest length from low to high that is left, else 0."""
    found = np.flatnonzero(counts[max(low, 1) : high + 1])
    return int(found[-1]) + max(low, 1) if len(found) else 0


def make_plan(histogram: np.ndarray, length: int = LENGTH, bins: int = BINS, depth: int = DEPTH) -> Plan:
    """A plan for ``histogram[l]`` pieces of each length l."""
    counts = histogram.astype(np.int64).copy()
    width = -(-length // bins)
    groups = -(-length // width)
    opened: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def leave(runs: list[tuple[int, int]], times: int) -> None:
        if times:
            opened.setdefault(length - sum(a * b for a, b in runs), []).append((runs, times))

    bin_of = -(-np.arange(length + 1) // width)
    h = np.bincount(bin_of, counts, groups + 1)[1:]
    ways = patterns(groups, depth)
    a = np.zeros((groups, len(ways)))
    for k, way in enumerate(ways):
        for p in way:
            a[p - 1, k] += 1
    weight = np.arange(1, groups + 1) / groups  # what is left over counts by its tokens
    fit = nnls(a * weight[:, None], h * weight) if h.any() else np.zeros(len(ways))
    for k in np.argsort(-fit, kind="stable"):
        times = int(fit[k] + 1e-6)
        while times > 0:
            taken: list[int] = []
            left = length
            for n, p in enumerate(ways[k]):
                low, high = (p - 1) * width + 1, min(p * width, left)
                if n == len(ways[k]) - 1:
                    high = left
                for t in taken:
                    counts[t] -= 1
                got = _longest(counts, low, high)
                for t in taken:
                    counts[t] += 1
                if not got:
                    break
                taken.append(got)
                left -= got
            if len(taken) < len(ways[k]):
                break
            each = {t: taken.count(t) for t in taken}
            n = min(times, *(int(counts[t]) // m for t, m in each.items()))
            for t, m in each.items():
                counts[t] -= m * n
            leave(list(each.items()), n)
            times -= n

    for size in range(length, 0, -1):
        c = int(counts[size])
        if not c:
            continue
        for gap in sorted(g for g in opened if g >= size):
            m = gap // size
            while c and opened[gap]:
                runs, times = opened[gap].pop()
                full = min(times, c // m)
                leave([*runs, (size, m)], full)
                c -= full * m
                if full < times:
                    if c:
                        leave([*runs, (size, c)], 1)
                        leave(runs, times - full - 1)
                        c = 0
                    else:
                        leave(runs, times - full)
            if not c:
                break
        if c:
            m = length // size
            leave([(size, m)], c // m)
            if c % m:
                leave([(size, c % m)], 1)
    plan = Plan()
    for gap in sorted(opened):
        for runs, times in opened[gap]:
            plan.add(runs, times)
    return plan


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    cut_ = written(pieces(docs, path=path, length=length, end_id=end_id), "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for row in cut_.groupBy("length").count().collect():  # at most ``length`` rows
        histogram[row["length"]] = row["count"]
    buckets = max(BUCKETS, -(-int(histogram.max()) // RANKED))
    cut_ = cut_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut_.groupBy("length", "bucket").count()
    keys, _, first, sequence, offset, copies = make_plan(histogram, length).arrays()

    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).drop("count")
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (size << 48) + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
