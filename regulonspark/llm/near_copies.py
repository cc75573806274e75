"""SimHash near-dedup by a stated similarity: the Gray index first, then all that it does not reach.

Two documents match if the Jaccard similarity of their sets of word shingles (five words) is
at least 4/5, or if the sets are equal (so all documents without words match).
Groups are the connected components of these matches. Fingerprints at a small distance reach
only the nearest copies, so they decide which pairs are tried first, not what matches.

1. A pass over the texts counts shingles in hashed counters of fixed size; those
   that repeat most come last in the order of shingles (counter level, hash).
2. A second pass keeps of every document's n shingles the first
   n - ceil(4n/5) + 1. Two sets that match share one of these (prefix filter), so
   no match is missed whatever the order; it decides only how many pairs are met.
   With it go the set's fingerprint and parity sketches, one of 1024 bits and for large sets one that grows with the set. Equal sets are one entry from here on.
3. Semi-joins on those shingles keep entries that some other agrees with under
   the length and positional filters, and then under the first sketch; sketches never reject a
   match. They stop at the first such entry, so they never make pairs.
4. Matches are verified in three rounds, each followed by components: entries whose
   fingerprints the Gray index links, against the smallest of them; against the
   smallest entry of each shingle; then every pair that is
   still in two components. Large groups are one component after the first
   rounds, so their pairs are never made. Pairs that pass the second sketch are compared
   by their whole sets, made anew from the documents that have them.

Shingles are told by 64-bit hashes (31 bits of these where they only name candidates), sets by
a 64-bit hash of their shingles, rows by 128-bit hashes of doc_id and text. Texts of any length are processed whole; the
set of one text's shingles is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import SEED, components, near_links, shingles_of, words_of
from .work import discard, first_rows, passing, row_keys, written

SHINGLE = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Hashed counters of the order.
COUNTERS = 1 << 20
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Shingles up to which a set's size is carried exactly in the filters.
SIZED = (1 << 16) - 1
_WORDS = [f"w{i}" for i in range(SKETCH)]


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in shingles_of(words_of(text), k)), np.uint64))


def _name(hs: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hs.tobytes(), SEED)).view(np.int64))


def _fingerprint(hs: np.ndarray) -> int:
    """SimHash of a set of shingles; a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hs), 1 << 15):
        ones += np.unpackbits(hs[lo : lo + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hs)).view(">i8")[0])


def _sketch(hs: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Which of 64 * words hash classes have an odd number of shingles; the halves of a wider one, xored, are the narrower one."""
    odd = np.bincount((hs & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(hs: np.ndarray) -> np.ndarray:
    """A sketch of two bits or more a shingle; none if the narrow one has as many."""
    words = 1 << max(0, (2 * len(hs) - 1).bit_length() - 6)
    return _sketch(hs, words) if words > SKETCH else np.zeros(0, np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            yield part, [shingle_set(t, k) for t in part.column(column).to_pylist()]


def _levels(docs: DataFrame, k: int) -> np.ndarray:
    """A level per counter: 0 for all but those that stand out in some task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for _, sets in _sets(batches, k, 0):
            counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts > max(2.0, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["c", "n"])

    found = docs.select("text").mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.floor(F.log2(F.sum("n"))).cast("byte").alias("n")).toArrow()
    levels = np.zeros(COUNTERS, np.uint8)
    levels[found.column("c").to_numpy()] = found.column("n").to_numpy()
    return levels


def _marked(docs: DataFrame, k: int) -> DataFrame:
    """A table of every row: ka, kb, doc_id, s and n (name and size of its shingle set), fp (fingerprint), w0.. and wide (sketches), p (prefix)."""
    order = docs.sparkSession.sparkContext.broadcast(_levels(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = order.value
        for part, sets in _sets(batches, k, 3):
            prefixes = []
            for hs in sets:
                by = np.argsort(levels[(hs & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                prefixes.append((hs[by[: len(hs) + (-len(hs) * NUM // DEN) + 1]] & np.uint64(0x7FFFFFFF)).astype(np.int32))
            sketch = np.stack([_sketch(hs) for hs in sets])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(map(_name, sets), pa.int64()), pa.array([len(hs) for hs in sets], pa.int64()), pa.array(map(_fingerprint, sets), pa.int64()),
                 *(pa.array(sketch[:, i].copy()) for i in range(SKETCH)), pa.array(list(map(_wide, sets)), pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int32()))],
                names=["ka", "kb", "doc_id", "s", "n", "fp", *_WORDS, "wide", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    words = ", ".join(f"{w} bigint" for w in _WORDS)
    rows = docs.select(*row_keys(), "doc_id", "text").mapInArrow(run, f"ka bigint, kb bigint, doc_id {kind}, s bigint, n bigint, fp bigint, {words}, wide array<bigint>, p array<int>")
    return written(rows, "near-rows")


def _fetched(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """A table of s, hs (the whole set) for the rows ``wanted`` (s, ka, kb), one per set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k, 2):
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([hs.view(np.int64) for hs in sets], pa.list_(pa.int64()))], names=["ka", "kb", "hs"])

    with passing(wanted, "ka") as may:
        rows = docs.select(*row_keys(), "text").where(may).mapInArrow(run, "ka bigint, kb bigint, hs array<bigint>")
        # (rows that repeat an id and a text have the same keys)
        return written(rows.join(wanted, ["ka", "kb"]).groupBy("s").agg(F.first("hs").alias("hs")), "near-sets", few=True)


def _may_match(x: str, y: str):
    """Length and positional filters for entries that share a shingle, taken for the first that they share."""
    n, m = (F.shiftright(F.col(f"{r}.n_i"), 15) for r in (x, y))
    i, j = (F.col(f"{r}.n_i").bitwiseAND((1 << 15) - 1) for r in (x, y))
    return (F.least(n - i, m - j) * (NUM + DEN) >= (n + m) * NUM) | (n == SIZED) | (m == SIZED)


def _near(x: str, y: str):
    """Whether the sketches differ in no more bits than sets that match can."""
    n, m = (F.shiftright(F.col(f"{r}.n_i"), 15) for r in (x, y))
    apart = sum(F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in _WORDS)
    return ((n + m - apart) * (NUM + DEN) >= (n + m) * 2 * NUM) | (n == SIZED) | (m == SIZED)


def _with_partner(rows: DataFrame, condition) -> DataFrame:
    """Rows whose shingle ``t`` another entry of ``rows`` has under the condition, which names all columns.

    So both sides have the same columns, and one exchange.
    """
    return rows.alias("y").join(rows.alias("x"), (F.col("x.t") == F.col("y.t")) & condition, "left_semi")


def _wide_near() -> str:
    """SQL of whether the wide sketches ``a_wide`` and ``b_wide`` differ in no more bits than sets of ``a_n`` and ``b_n`` shingles that match can.

    One of twice the width is folded; where one has none, or is wider still, the pair passes.
    """
    def ok(x: str, y: str) -> str:
        apart = f"aggregate(zip_with({x}, {y}, (v, w) -> bit_count(v ^ w)), 0, (v, w) -> v + w)"
        return f"(a_n + b_n - {apart}) * {NUM + DEN} >= (a_n + b_n) * {2 * NUM}"

    def folded(x: str) -> str:
        return f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (v, w) -> v ^ w)"

    return (f"CASE WHEN size(a_wide) = 0 OR size(b_wide) = 0 THEN true WHEN size(a_wide) = size(b_wide) THEN {ok('a_wide', 'b_wide')} "
            f"WHEN size(a_wide) = 2 * size(b_wide) THEN {ok(folded('a_wide'), 'b_wide')} "
            f"WHEN size(b_wide) = 2 * size(a_wide) THEN {ok('a_wide', folded('b_wide'))} ELSE true END")


def _verified(pairs: DataFrame, entries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """A table of the ``pairs`` (a, b) that match."""
    x, y = (entries.select(F.col("s").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")) for c in "ab")
    near = written(pairs.join(x, "a").join(y, "b").where(F.expr(_wide_near())).select("a", "b"), "near-pairs", few=True)
    names = near.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    wanted = written(names.join(entries, "s").select("s", "row.ka", "row.kb"), "near-wanted", few=True)
    sets = _fetched(docs, wanted, k)
    x, y = (sets.select(F.col("s").alias(c), F.col("hs").alias(f"{c}_hs")) for c in "ab")
    both = F.size("a_hs") + F.size("b_hs")
    edges = written(near.join(x, "a").join(y, "b").where(F.size(F.array_intersect("a_hs", "b_hs")) * (NUM + DEN) >= both * NUM).select("a", "b"), "near-edges", few=True)
    discard(near, wanted, sets)
    return edges


def _gray_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of entries whose fingerprints the Gray index links, with the smallest of them."""
    entries = rows.select("s", "fp").distinct()
    links = components(near_links(entries.select("fp").distinct()))
    rooted = entries.join(links, F.col("fp") == F.col("node"), "left").select("s", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("s").alias("b"))
    return rooted.join(first, "root").where("s <> b").select(F.col("s").alias("a"), "b")


def near_components(docs: DataFrame, marked: DataFrame, k: int = SHINGLE) -> DataFrame:
    """A table of node, root: for every shingle set that matches another, the smallest name in its component."""
    entries = written(marked.groupBy("s").agg(*(F.first(c).alias(c) for c in ("n", "fp", *_WORDS, "wide", "p")), F.min(F.struct("ka", "kb")).alias("row")), "near-entries")
    size = F.call_function("shiftleft", F.least(F.col("n"), F.lit(SIZED)).cast("int"), F.lit(15))
    rows = entries.select("s", "n", F.posexplode("p").alias("i", "t")).select("t", "s", size.bitwiseOR(F.least(F.col("i"), F.lit((1 << 15) - 1))).alias("n_i"))
    live = written(_with_partner(rows, (F.col("x.s") != F.col("y.s")) & _may_match("x", "y")), "near-candidates", few=True)
    sketched = live.join(entries.select("s", "fp", *_WORDS), "s").select("t", "s", "n_i", "fp", *_WORDS)
    other = (F.col("x.s") != F.col("y.s")) | (F.col("x.fp") != F.col("y.fp"))  # (equal sets have equal fingerprints)
    rows = written(_with_partner(sketched, other & _may_match("x", "y") & _near("x", "y")), "near-rows")
    discard(live)
    roots = None
    for step in range(3):
        if step == 0:
            pairs = _gray_pairs(rows)
        else:
            rooted = rows.join(roots, F.col("s") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "s"))
            split = rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
            rest = written(rooted.join(split, "t"), "near-rest")
            other = rest if step == 2 else rest.groupBy("t").agg(F.min(F.struct("s", "n_i", "root", *_WORDS)).alias("x")).select("t", "x.*")
            met = rest.alias("y").join(other.alias("x"), (F.col("x.t") == F.col("y.t")) & (F.col("x.root") != F.col("y.root")) & _may_match("x", "y") & _near("x", "y"))
            pairs = met.select(F.greatest("x.s", "y.s").alias("a"), F.least("x.s", "y.s").alias("b")).distinct()
        edges = _verified(pairs, entries, docs, k)
        if roots is None:
            roots = written(components(edges), "near-roots", few=True)
        else:  # the new edges join components
            of = roots.withColumnsRenamed({"node": "of", "root": "top"})
            for c in "ab":
                edges = edges.join(of, F.col(c) == F.col("of"), "left").withColumn(c, F.coalesce("top", c)).drop("of", "top")
            joined = written(components(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "near-joined", few=True)
            up = joined.withColumnsRenamed({"node": "of", "root": "top"})
            moved = roots.join(up, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root"))
            fresh = joined.join(roots.select("node"), "node", "left_anti")
            before, roots = roots, written(moved.union(fresh), "near-roots", few=True)
            discard(before, joined, rest)
    discard(rows, entries)
    return roots


def keep_first(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per group of near copies: that with the smallest id, null ids last."""
    marked = _marked(docs, k)
    roots = near_components(docs, marked, k)
    labels = marked.join(roots, F.col("s") == F.col("node"), "left").select("ka", "kb", "doc_id", F.coalesce("root", "s").alias("root"))
    labels = written(labels, "near-labels")
    discard(marked, roots)
    return first_rows(docs, labels)
