"""Exact top-k inner products by no-random-access aggregation.

Per dimension a block of candidates has a list of its values in sorted order,
read one entry after another from both ends. Read to some depth, the list has
either shown a candidate's value or left it between the two values read last;
so every candidate's score has a lower and an upper bound, whose terms are the
query's weight times the value, or times the better or worse of those two.

1. All lists are read to the same depth first. What is known is then the same for
   all queries, so that their bounds for all candidates are four matrix products.
   The depth grows until few enough candidates can still be among the k best.
2. From there a query reads on by itself, the lists in which its weight is large
   further than the others, until no outsider's upper bound reaches the k-th best
   lower bound (one that only ties with it still counts).
3. The lists in which one of those left has not been seen yet are read until it is.
   The scores are then sums of entries read.

Vectors are never looked up: values count only where their list has been read to
their place, and every result tells which share of the entries that was.

Candidates and queries are dealt over blocks; each task has one block of either,
of a bounded number of rows, finds every query's k best there, and a ranking
over the block winners gives the result.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part; only vectors of equal length are compared; rows with
the query's own id are not its candidates; equal scores go to the smaller id,
then repeated rows of one id stay as rows; a null id takes no part. An empty table gives an
empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block at most, and candidate blocks that a table of some thousand rows is dealt over.
CANDIDATES, QUERIES, SPREAD = 16384, 8192, 24
#: Shares of the lists to which all are read, one after another.
DEPTHS = (1 / 2, 3 / 4, 7 / 8)
#: Queries whose bounds are held at once.
_CHUNK = 128
#: Beyond this the products are no longer exact in doubles.
_EXACT = float(1 << 53)


class SortedLists:
    """The lists of a block: for each dimension its values in order, and of each candidate how deep in the list it lies."""

    def __init__(self, block: np.ndarray):
        self.n, self.dims = block.shape
        order = block.argsort(axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(self.n)[:, None], axis=0)
        self.depth = np.minimum(place, self.n - 1 - place)  # entries that come before it from the nearer end
        self.values = np.take_along_axis(block, order, axis=0)
        self.block = block
        self.half = (self.n + 1) // 2  # read so far from both ends, a list is read whole

    def edges(self, read) -> tuple[np.ndarray, np.ndarray]:
        """The values that were read last from the low and from the high end; ``read`` entries from each."""
        at = np.broadcast_to(np.clip(read, 1, self.half) - 1, (self.dims,))
        dims = np.arange(self.dims)
        return self.values[at, dims], self.values[self.n - 1 - at, dims]

    def entries(self, read: np.ndarray) -> int:
        return int(np.minimum(2 * read, self.n).sum())


def _narrow(q: np.ndarray, rows: np.ndarray, lists: SortedLists, read: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``rows`` those that can be among the k best of query q, and how far each list had to be read to tell."""
    weight = np.abs(q)
    left = float((1 - read / lists.half).max())
    while len(rows) > k and (read < lists.half).any():
        # unread shares in inverse proportion to the weights lose least for what they save
        left /= 2
        share = np.minimum(1.0, left * weight.mean() / np.maximum(weight, 1e-300)) if left > 1 / 1024 else np.zeros(len(q))
        read = np.maximum(read, np.ceil((1 - share) * lists.half).astype(np.int64))
        low, high = lists.edges(read)
        seen = lists.depth[rows] < read
        known = np.where(seen, lists.block[rows] * q, 0.0).sum(1)
        least = known + np.where(seen, 0.0, np.minimum(q * low, q * high)).sum(1)
        most = known + np.where(seen, 0.0, np.maximum(q * low, q * high)).sum(1)
        rows = rows[most >= np.partition(least, len(rows) - k)[len(rows) - k]]
    return rows, read


def nra(queries: np.ndarray, block: np.ndarray, k: int, own: list[np.ndarray] | None = None, depths=DEPTHS) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(query number, positions in ``block``, scores, share of the list entries read) of all rows that are among a query's k best.

    Rows that tie with the k-th best are all among them; the rows of ``own``, a list per query, are not.
    ``queries`` and ``block`` hold integers as doubles.
    """
    lists = SortedLists(block)
    n = lists.n
    waiting = np.arange(len(queries))
    few = max(8 * k, n // 64)
    for depth in (*depths, 1.0):
        read = lists.half if depth == 1.0 else int(lists.half * depth)
        if not len(waiting):
            break
        if depth < 1.0 and (read < 1 or n <= 4 * k):
            continue
        low, high = lists.edges(read)
        seen = lists.depth < read
        floor, ceiling = np.where(seen, block, low).T, np.where(seen, block, high).T
        later = []
        for lo in range(0, len(waiting), _CHUNK):
            some = waiting[lo : lo + _CHUNK]
            up, down = np.maximum(queries[some], 0), np.minimum(queries[some], 0)
            least = up @ floor + down @ ceiling
            most = up @ ceiling + down @ floor
            for i, q in enumerate(some):
                if own is not None:
                    least[i, own[q]] = most[i, own[q]] = -np.inf
            kth = np.partition(least, max(0, n - k), axis=1)[:, max(0, n - k)]
            for i, q in enumerate(some):
                rows = np.flatnonzero((most[i] >= kth[i]) & (most[i] > -np.inf))
                if len(rows) > few and depth < 1.0:
                    later.append(q)
                    continue
                rows, far = _narrow(queries[q], rows, lists, np.full(lists.dims, read), k)
                # what is left is read up, list by list, but where the weight is nothing
                if len(rows):
                    far = np.where(queries[q] == 0, far, np.maximum(far, lists.depth[rows].max(0) + 1))
                yield int(q), rows, (block[rows] * queries[q]).sum(1), lists.entries(far) / (n * lists.dims)
        waiting = np.array(later, np.int64)


def _own_rows(qid: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each query the positions of the rows with its id."""
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    return [order[a:b] for a, b in zip(np.searchsorted(ordered, qid, "left"), np.searchsorted(ordered, qid, "right"))]


def block_winners(qid: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, score, read_share of each query's k best in the block, its own rows left out."""
    exact = np.abs(queries).max(initial=0) * np.abs(block).max(initial=0) * block.shape[1] < _EXACT
    own = _own_rows(qid, ids)
    if exact:
        found = nra(queries.astype(float), block.astype(float), k, own)
    else:  # too large for bounds in doubles: every list is read whole
        found = ((q, rows, block[rows] @ queries[q], 1.0) for q in range(len(queries)) for rows in [np.setdiff1d(np.arange(len(block)), own[q])])
    out = []
    for q, rows, score, share in found:
        score = score.astype(np.int64)
        pick = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(pick), qid[q]), ids[rows][pick], score[pick], np.full(len(pick), share)))
    names = ("query_id", "vec_id", "score", "read_share")
    if not out:
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "read_share" else "int64") for c in names})
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))


def top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
    candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score, read_share: the k largest integer inner products of each query.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by ``every``, candidates all rows. read_share is the share of the list
    entries that the query read in the block the row comes from.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    asks = F.col("id") % every == 0
    rows, asked = usable.agg(F.count("*"), F.count(F.when(asks, 1))).first()
    blocks = max(1, -(-rows // candidates), min(SPREAD, rows // 1024))
    groups = max(1, -(-asked // queries))
    known = usable.withColumn("h", F.xxhash64("id"))
    block = F.pmod("h", F.lit(blocks)).cast("int")
    group = F.pmod(F.shiftrightunsigned("h", 32), F.lit(groups)).cast("int")
    every_block, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, groups))
    stored = known.select(F.size("v").alias("dim"), block.alias("block"), every_group.alias("grp"), F.lit(False).alias("asks"), "id", "v")
    asking = known.where(asks).select(F.size("v").alias("dim"), every_block.alias("block"), group.alias("grp"), F.lit(True).alias("asks"), "id", "v")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks, ids = part["asks"].to_numpy(), part["id"].to_numpy()
        if asks.all() or not asks.any():
            return block_winners(ids[:0], np.zeros((0, 1), np.int64), ids[:0], np.zeros((0, 1), np.int64), k)
        v = np.stack(part["v"].to_numpy())
        return block_winners(ids[asks], v[asks], ids[~asks], v[~asks], k)

    # (a stated number of partitions, as Spark would merge these small ones and leave the work to one task)
    dealt = stored.union(asking).repartition(min(2 * blocks * groups, 20_000), "block", "grp", "dim")
    found = dealt.groupBy("block", "grp", "dim").applyInPandas(run, "query_id bigint, vec_id bigint, score bigint, read_share double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read_share")
