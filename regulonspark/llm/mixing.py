"""Mixing sources to target weights with hash-random keys and distributed prefix sums.

Every document gets a key that is a hash of its id. The key space is cut into
4096 equal ranges per source, so that even a source with a third of all rows
is dealt over thousands of ranges; within a range documents are sorted by key,
the ranges' word counts are summed, and the prefix sums over the ranges of a
source give each range its offset. Each source is then cut at its exact
budget: whole epochs first, then the documents in key order; the document at
the cut gives its leading words. Only DataFrame expressions are used. Targets are found in
one task with a row per source; sources are taken to be thousands at most.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own and sorts last; repeated rows are documents of
their own; rows with equal keys are ordered by id and size, and equal rows are
interchangeable; an empty table gives an empty result. A source without words
has target 0. Columns other than ``doc_id``, ``text`` and ``source`` are not
read by :func:`mix_plan` and are kept unchanged by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .work import WORD, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
SHARE = 1.5
#: The most that a source gives, as a multiple of its words.
MOST = 2.0
#: Hex digits of the key that number its range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Targets are proportional to the weights, stop at ``most`` times the
    source's size, and the excess is shared again by weight until none is
    above: with b the total, the level t at which sum(min(most * size,
    t * weight)) = b. Sources are sorted by the level at which they stop, so t
    is found with running sums over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    per = per.withColumn("stop", F.col("cap") / F.col("weight"))
    below = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    per = (
        per.withColumn("goal", F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(all_))
        .withColumn("cap_below", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.col("cap_below")) / F.col("weight_left"))
    )
    # the first source that stops at or above its level sets it for all that follow
    first = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", (-F.col("level")).alias("minus")))).over(all_)
    level = -first["minus"]
    return per.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, *, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, mix_key, size, source_size, target, taken for every row of ``docs``."""
    # (a table, so that words are counted once)
    sized = written(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("mix_key"),
    ).withColumn("range", F.substring("mix_key", 1, RANGE_DIGITS)), "mix-sizes")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("size"))
    targets = source_targets(ranges, weights, share, most)
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("range").alias("_r"), "offset", "source_size", "target")
    )
    inside = W.partitionBy("source", "range").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
        .withColumn("before", F.col("offset") + F.col("inside"))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(
        "doc_id", "source", "mix_key", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: one row per copy, the columns unchanged.

    A document that is taken k times and a part is k rows and one row with its
    leading words, joined by single spaces; of rows that repeat a doc_id with
    different texts each has its own count. ``n_chars``, where there is such a
    column, follows the text.
    """
    names = docs.columns

    def key(size):
        return F.md5(F.to_json(F.struct(F.col("doc_id"), F.col("source"), size.alias("size"))))

    plan = mix_plan(docs, **how).groupBy(key(F.col("size")).alias("key")).agg(
        F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("rows")).where("taken > 0")
    # the columns of docs go as one, so that no name clashes
    packed = docs.select(key(word_count(F.col("text"))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = packed.join(plan, "key")
    text = F.col("row")["text"]
    # rows that agree in id, source and size share their words evenly, the first ones take what is left over
    turn = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(text))) - 1
    mine = F.floor(F.col("taken") / F.col("rows")) + F.when(turn < F.col("taken") % F.col("rows"), 1).otherwise(0)
    joined = joined.withColumn("mine", mine.cast("long")).where("mine > 0")
    whole = F.floor(F.col("mine") / F.col("size")).cast("int")
    left = (F.col("mine") % F.col("size")).cast("int")
    sizes = F.concat(F.array_repeat(F.lit(-1), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))
    copies = joined.withColumn("cut", F.explode(sizes))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(1), F.greatest(F.col("cut"), F.lit(0))), " ")
    new = {"text": F.when(F.col("cut") < 0, text).otherwise(cut)}
    if "n_chars" in names:
        kept = F.col("row")["n_chars"]
        new["n_chars"] = F.when(F.col("cut") < 0, kept).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return copies.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])
