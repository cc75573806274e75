"""Line dedup by an exact set-similarity join, in DataFrame expressions only.

A line's tokens are its distinct lower-cased words. Two lines match if the
Jaccard similarity of their token sets is at least 4/5, or if they are equal.
A line is removed if any earlier line (smaller doc_id, then smaller line
number) matches it; of each group of equal lines the first is compared.

1. The texts are split once, into a table of lines with their distinct word hashes.
2. Rarity: word counts are added up in a fixed number of hashed counters, and
   kept as levels (4 per power of two) in a session variable of fixed size. The order of
   tokens is (level, hash), a total order in which rare words come first.
3. Every distinct line gives the rarest n - ceil(4n/5) + 1 of its n tokens.
   A semi-join on those tokens keeps the lines that some other line agrees
   with under the length, positional, and parity filters; it stops at the
   first such line, so it never makes pairs. (The positional filter, for the
   first shared token, implies the length filter. The parity filter compares
   sketches of 64 bits, or 128 for lines of more than 80 words; it never
   rejects a match.)
4. The token sets of what is left are fetched and matches are verified in two
   rounds: first against the earliest line of each token, which settles large
   groups with a row per line and token, then all others against every earlier line.
5. Line numbers to remove are gathered per document. Lines that are one of
   4096 or more of all are dealt over salts, so that no task gets such a group whole.

Words are compared by 56-bit hashes. Equal lines are told by 96-bit hashes; pairs
name their lines by the first 64 of these. A table is deleted as soon as all that
is made from it is written.

Defined results: blank lines have no tokens and are never removed; a null text
has no lines and stays null, an empty one has one blank line; a null doc_id
sorts last; rows that repeat a doc_id share their places, so that equal lines
at equal places stay in both, and lose only their own lines, as they are told
apart by a 64-bit hash of the text; an empty table gives an empty result. Columns
other than doc_id and text are untouched. Texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import ArrayVariable, dense, discard, passing, salted_join, session_setting, written

#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Hashed counters of the rarity order.
COUNTERS = 1 << 20
#: Lines of more words have the wider sketch; words up to which a line's size is carried exactly in the filters.
WIDE, SIZED = 80, (1 << 16) - 1
#: Columns in which values hardly repeat are written without a dictionary.
_PLAIN = "parquet.enable.dictionary#"
_BLANKS = "\t\x0b\x0c\r"
_HASH = (1 << 56) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, the line's hashes a and b, and hs: hashes of its distinct words.

    Lines are named after lower-casing, with a space for each other blank: equal ones have
    the same words. The outer form keeps the optimizer from adding a filter that would split
    every text twice. (The empty word, found where blanks meet, is none.)
    """
    # (two steps, so that nothing of the whole text is computed for each of its lines)
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.lower(_spaced(F.col("text"))), "\n").alias("lines")).select(
        "doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "line"))
    hs = F.transform(F.split("line", " "), lambda w: F.xxhash64(w).bitwiseAND(_HASH))
    return split.where("line IS NOT NULL").select(
        "doc_id", "text_hash", "line_no", F.xxhash64("line").alias("a"), F.hash("line", F.lit(7)).alias("b"),
        F.array_remove(F.array_distinct(hs), F.xxhash64(F.lit("")).bitwiseAND(_HASH)).alias("hs"))


def _spaced(text):
    """``text`` with a space for each blank but line ends."""
    spaced, found = text, F.lit(False)
    for c in _BLANKS:
        spaced, found = F.replace(spaced, F.lit(c), F.lit(" ")), found | F.contains(text, F.lit(c))
    return F.when(found, spaced).otherwise(text)


def _levels(lines: DataFrame) -> DataFrame:
    """One array: the rarity level of every counter. (Eight levels are one long until the last step.)"""
    counts = lines.select(F.explode_outer("hs").alias("h")).select(F.col("h").bitwiseAND(COUNTERS - 1).alias("c")).groupBy("c").count().where("c IS NOT NULL")
    level = F.least(F.lit(127), F.floor(4 * F.log2(F.col("count") + 1))).cast("long")
    packed = counts.select(F.shiftright("c", 3).alias("at"), F.call_function("shiftleft", level, (F.col("c").bitwiseAND(7) * 8).cast("int")).alias("v"))
    return dense(packed, COUNTERS >> 3).selectExpr(
        "flatten(transform(vs, v -> transform(sequence(0, 56, 8), s -> cast(shiftrightunsigned(v, s) & 127 AS tinyint)))) AS vs")


def _place(prefix: str = ""):
    """Sort key of a line's place; nulls last."""
    return F.struct(F.col(f"{prefix}doc_id").isNull().alias("none"), F.col(f"{prefix}doc_id").alias("doc_id"), F.col(f"{prefix}line_no").alias("line_no"))


def _distinct(lines: DataFrame, levels: str) -> DataFrame:
    """a, b of every distinct line with words; place (of the first), many (equal lines), n, lo, hi (its parity sketch), p (its prefix)."""
    # (Lambdas are interpreted node by node, so theirs are short: powers of two are looked up. The second step asks for ``ranked`` twice,
    # which keeps the sort out of a lambda's argument; ranks are never null, so that it sorts plain longs.)
    ranked = F.expr(f"sort_array(transform(hs, h -> coalesce(shiftleft(cast({levels}[h & {COUNTERS - 1}L] AS bigint), 56) | h, 0L)))")
    powers = f"array({', '.join(f'{1 << k}L' for k in range(63))}, shiftleft(1L, 63))"
    fold = f"aggregate(hs, 0L, (s, h) -> s ^ {powers}[h & 63L])"
    half = "aggregate(hs, 0L, (s, h) -> s ^ shiftleft(shiftrightunsigned(h, 6) & 1L, cast(h & 63 AS int)))"
    ordered = lines.where(F.size("hs") > 0).select(
        "a", "b", _place().alias("place"), F.expr(fold).alias("fold"),
        F.when(F.size("hs") > WIDE, F.expr(half)).otherwise(F.lit(0).cast("long")).alias("hi"), ranked.alias("ranked"))
    sets = ordered.select(
        "a", "b", "place", F.size("ranked").alias("n"), "fold", "hi",
        F.transform(F.slice("ranked", F.lit(1), F.size("ranked") - F.ceil(F.size("ranked") * NUM / DEN).cast("int") + 1),
                    lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")).alias("p"))
    return sets.groupBy("a", "b").agg(
        F.min("place").alias("place"), F.count("*").alias("many"), F.first("n").alias("n"),
        F.first(F.col("fold").bitwiseXOR(F.col("hi"))).alias("lo"), F.first("hi").alias("hi"), F.first("p").alias("p"))


def _may_match(x: str, y: str):
    """Length, positional and parity filters for rows that share a token.

    The positional filter takes the token for the first that the lines share, so
    that a pair that matches passes at that token at least. A pair with a line too
    large for its size to be carried passes.
    """
    n, m = (F.shiftright(F.col(f"{r}.n_i"), 15) for r in (x, y))
    i, j = (F.col(f"{r}.n_i").bitwiseAND((1 << 15) - 1) for r in (x, y))
    lo, hi = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("lo", "hi"))
    apart = F.when((n > WIDE) & (m > WIDE), F.bit_count(lo) + F.bit_count(hi)).otherwise(F.bit_count(lo.bitwiseXOR(hi)))
    both = n + m
    return (
        ((both - apart) * (NUM + DEN) >= both * 2 * NUM)
        & (F.least(n - i, m - j) * (NUM + DEN) >= both * NUM)
    ) | (n == SIZED) | (m == SIZED)


def _candidates(distinct: DataFrame) -> DataFrame:
    """t, a, n_i, lo, hi: prefix tokens (31-bit hashes) of distinct lines that another line may match; n_i has the size and the token's place."""
    size = F.call_function("shiftleft", F.least(F.col("n"), F.lit(SIZED)), F.lit(15))
    rows = distinct.select("a", "n", "lo", "hi", F.posexplode_outer("p").alias("i", "t")).select(
        "t", "a", size.bitwiseOR(F.least(F.col("i"), F.lit((1 << 15) - 1))).alias("n_i"), "lo", "hi")
    # (all columns are in the condition, so that both sides have the same ones and one exchange)
    return rows.alias("y").join(
        rows.alias("x"), (F.col("x.t") == F.col("y.t")) & (F.col("x.a") != F.col("y.a")) & _may_match("x", "y"), "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the later lines of ``pairs`` (a, xa) whose sets are similar enough."""
    own = sets.withColumnRenamed("hs", "own")
    other = sets.select(F.col("a").alias("xa"), F.col("hs").alias("other"))
    both = F.size("own") + F.size("other")
    return pairs.join(own, "a").join(other, "xa").where(
        F.size(F.array_intersect("own", "other")) * (NUM + DEN) >= both * NUM).select("a", "b").distinct()


def _later_matches(lines: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b of the distinct lines that match an earlier one, from two tables."""
    found = written(_candidates(distinct), "line-candidates", few=True)
    with passing(found, "a") as wanted:
        sets = written(lines.where(wanted).groupBy("a", "b").agg(F.first("hs").alias("hs")), "line-sets")
        rows = written(found.join(distinct.where(wanted).select("a", "place"), "a"), "line-rows")
    discard(found)
    pivot = rows.groupBy("t").agg(F.min(F.struct("place", "a", "n_i", "lo", "hi")).alias("x")).select("t", "x.*")

    def pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """The pairs as a table, so that what led to them is gone before their sets are fetched."""
        met = later.alias("y").join(
            earlier.alias("x"),
            (F.col("x.t") == F.col("y.t")) & (F.col("x.a") != F.col("y.a")) & _may_match("x", "y") & (F.col("x.place") < F.col("y.place")))
        return written(met.select("y.a", F.col("x.a").alias("xa")).distinct(), "line-pairs", few=True)

    first = pairs(rows, pivot)
    settled = written(_verified(first, sets), "line-matches", few=True)
    second = pairs(rows.join(settled.select("a"), "a", "left_anti"), rows)
    others = written(_verified(second, sets), "line-matches", few=True)
    discard(sets, rows, first, second)
    return settled, others


def line_matches(docs: DataFrame) -> DataFrame:
    """A table of doc_id, text_hash, removed_lines (numbers from 0, in order) of every document that loses lines."""
    lines = written(_lines(docs.select("doc_id", "text")), "line-words", **{"compression": "zstd", **dict.fromkeys((f"{_PLAIN}{c}" for c in ("a", "b", "hs.list.element")), "false")})
    with session_setting(docs.sparkSession, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", str(COUNTERS.bit_length() - 1)):
        counted = ArrayVariable(_levels(lines), "TINYINT")  # (all counters of a task fit into its first map)
    with counted as levels:
        distinct = written(_distinct(lines, levels), "line-distinct", **{"compression": "zstd", **dict.fromkeys((f"{_PLAIN}{c}" for c in ("a", "b", "lo", "p.list.element")), "false")})
    settled, others = _later_matches(lines, distinct)
    total = distinct.agg(F.sum("many")).first()[0] or 0
    judged = written(
        distinct.select("a", "b", "place", "many").join(settled.union(others).withColumn("similar", F.lit(True)), ["a", "b"], "left").where("many > 1 OR similar"),
        "line-judged", few=True)
    discard(distinct, settled, others)
    met = salted_join(lines.select("doc_id", "text_hash", "line_no", "a", "b"), judged, ["a", "b"], ["doc_id", "line_no"], total)
    gone = met.where(F.coalesce("similar", F.lit(False)) | (F.col("place") < _place()))
    removed = written(gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines")), "line-removed", few=True)
    discard(lines, judged)
    return removed


def _with_removed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of every row, and removed (the numbers of its lines to remove, or null)."""
    removed = line_matches(docs).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), F.col("removed_lines").alias("removed"))
    keyed = docs.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_hash"), *columns)
    return keyed.join(removed, F.col("own").eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("of_hash")), "left")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines for every row of ``docs``."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return _with_removed(docs, n_lines.alias("n_lines")).select(
        F.col("own").alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match earlier ones; ``n_chars``, if there, follows the text.

    Documents are never dropped: one that loses all its lines has an empty text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no name clashes
    text, changed = F.col("row")["text"], F.col("removed").isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    new = {"text": F.when(changed, kept).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return _with_removed(docs, row).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
