"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Fingerprints: XXH64 of every word shingle, a majority vote per bit.
2. Equal fingerprints are one entry from here on, so exact copies cost nothing.
3. Routing: two fingerprints that differ in at most d bits agree on one of d + 1
   blocks of bits, so each entry goes to one bucket per block. The number of
   bits that name a bucket follows the number of entries, so that buckets stay
   at some thousands of entries; a bucket that is still too large is dealt over
   tiles by hash and every pair of its tiles becomes a task, which is exact and
   keeps every task bounded.
4. In a task the entries are sorted by Gray rank. Runs of neighbours form
   nodes with the bits that all their members share; runs of nodes form upper
   nodes with what their children share. Pairs of nodes are walked from the top;
   a pair whose shared bits already differ in more than d places is dropped
   with all its members, a pair whose members cannot differ in more is linked
   without looking at them. A task returns one edge per entry at most.
5. Components: large-star and small-star rounds over the edges, each written
   to the shared folder, until nothing changes.

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows stay, each with its component; null ids never become a
component id while a member has one; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read. Texts of any length are hashed in
pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice, tee

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, first_rows, row_keys, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Entries that a bucket has on average, and the most that a task takes from one tile.
BUCKET, TILE = 4096, 16384
#: Edges of a file.
EDGES = 500_000
#: Members of a node.
FAN = 16
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LONG = 1 << 20


def words_of(text: str | None) -> Iterable[bytes]:
    """Words of the lower-cased (A-Z) text; lazily for long texts."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return data.split() if len(data) < _LONG else (m.group() for m in _WORD.finditer(data))


def shingles_of(words: Iterable[bytes], k: int) -> Iterator[bytes]:
    """Shingles of k words; the whole sequence if it has fewer; none if it is empty."""
    if isinstance(words, list):
        if len(words) < k:
            return iter([b" ".join(words)] if words else [])
        return map(b" ".join, zip(*[words[i:] for i in range(k)]))
    words = iter(words)
    head = list(islice(words, k))
    if len(head) < k:
        return iter([b" ".join(head)] if head else [])
    runs = tee((w for part in (head, words) for w in part), k)
    for i, run in enumerate(runs):
        next(islice(run, i, i), None)
    return map(b" ".join, zip(*runs))


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash; a bit is set if it is in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    grams = shingles_of(words_of(text), k)
    digest = xxhash.xxh64_intdigest
    while True:
        h = np.fromiter((digest(g, seed) for g in islice(grams, 1 << 15)), np.uint64)
        if not len(h):
            break
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` but text, and fp (the fingerprint as a signed long)."""
    carried = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for lo in range(0, batch.num_rows, 128):
                fps += [fingerprint(t, k, seed) for t in batch.column(len(carried)).slice(lo, 128).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(fps, pa.int64())], names=[*carried, "fp"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{kinds}fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (shared-bit mask, pattern) over fingerprints in Gray order; leaves first."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.fan = fan
        masks, patterns = np.full(len(codes), ~np.uint64(0)), self.codes
        self.levels = [(masks, patterns)]
        while len(patterns) > fan:
            starts = np.arange(0, len(patterns), fan)
            first = np.repeat(patterns[starts], np.diff([*starts, len(patterns)]))
            shared = np.bitwise_and.reduceat(masks & ~(patterns ^ first), starts)
            masks, patterns = shared, patterns[starts] & shared
            self.levels.append((masks, patterns))

    def links(self, distance: int) -> np.ndarray:
        """For every entry, in the given order, the position of the first entry of its group."""
        n = len(self.codes)
        root = np.arange(n)
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 1 << 15:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            masks, patterns = self.levels[level]
            both = masks[i] & masks[j]
            apart = np.bitwise_count((patterns[i] ^ patterns[j]) & both)
            keep = apart <= distance
            i, j, both, apart = i[keep], j[keep], both[keep], apart[keep]
            if level == 0:
                root = _merged(root, i, j)
                continue
            width = self.fan**level
            # members of such a pair can't differ in more bits than allowed: link them all at once
            sure = apart + (64 - np.bitwise_count(both)) <= distance
            if sure.any():
                a, b = i[sure] * width, j[sure] * width
                for node in (i[sure], j[sure]):
                    member = node[:, None] * width + np.arange(width)
                    inside = member < n
                    root = _merged(root, np.repeat(node * width, inside.sum(1)), member[inside])
                root = _merged(root, a, b)
            i, j = i[~sure], j[~sure]
            # a pair of nodes that are one group already has nothing to add
            starts = np.arange(0, n, width)
            low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[open_], j[open_]
            below = len(self.levels[level - 1][0])
            step = np.arange(self.fan)
            x = (i[:, None, None] * self.fan + step[:, None]).repeat(self.fan, 2).ravel()
            y = (j[:, None, None] * self.fan + step).repeat(self.fan, 1).ravel()
            ok = (x < below) & (y < below) & ((x <= y) if level > 1 else (x < y))
            if len(x):
                stack.append((level - 1, x[ok], y[ok]))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[root]
        return out


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root after joining the groups of i and j; roots point at themselves."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j = i[open_], j[open_]
        if not len(i):
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (flat := root[root]).tobytes() != root.tobytes():
            root = flat
    return root


def near_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """Edges (a, b), a > b, that span the groups of fingerprints at most ``distance`` apart.

    ``fps`` has distinct longs in ``fp``.
    """
    blocks = distance + 1
    width = 64 // blocks
    n = fps.count()
    bits = max(0, min(width, int(np.ceil(np.log2(max(1, n) / bucket)))))
    if bits:
        parts = [F.struct(F.lit(k).alias("block"),
                          F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << bits) - 1)).alias("part"))
                 for k in range(blocks)]
    else:
        parts = [F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("part"))]
    routed = fps.select("fp", F.explode(F.array(*parts)).alias("at")).select("fp", "at.block", "at.part")
    large = routed.groupBy("block", "part").count().where(F.col("count") > tile)
    tiles = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    dealt = (
        routed.join(large, ["block", "part"], "left")
        .withColumn("tiles", tiles)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("fp", "block", "part", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = group["fp"].to_numpy()
        first = GrayIndex(codes.view(np.uint64)).links(distance)
        linked = first != np.arange(len(codes))
        a, b = codes[linked], codes[first[linked]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    found = dealt.groupBy("block", "part", "x", "y").applyInPandas(run, "a bigint, b bigint")
    return found.distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node that it reaches.

    Alternating large-star and small-star rounds. Counts and checksums are all
    that the driver sees.
    """
    edges = written(edges.where("a <> b").select("a", "b"), name, few=True)
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
        # (a round never has more than two edges for each before it, so the number of files can follow)
        before, edges = edges, written(small.where("a <> b").distinct().coalesce(1 + 2 * state[0] // EDGES), name)
        discard(before)


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """fp, first_id, root (a fingerprint that names the component) of every fingerprint of ``marked``."""
    entries = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    stars = components(near_links(entries.select("fp"), distance))
    return entries.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) per row of ``docs``."""
    marked = written(fingerprints(docs.select("doc_id", "text"), k, seed), "fingerprints")
    rooted = _rooted(marked, distance)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, distance: int = DISTANCE, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` without near-duplicates: of each group one row, that with the smallest id, null ids last.

    Rows are told by doc_id and text, so rows that share an id, or have none,
    are apart unless their texts are near.
    """
    marked = written(fingerprints(docs.select(*row_keys(), "doc_id", "text"), k, seed), "fingerprints")
    rooted = _rooted(marked, distance).select("fp", "root")
    return first_rows(docs, written(marked.join(rooted, "fp").select("ka", "kb", "doc_id", "root"), "labels"))
