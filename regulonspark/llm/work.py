"""What the corpus operators share: arrays in session variables, joins that deal heavy keys, row keys."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard as discard, fresh_path as fresh_path, release as release, session_setting as session_setting, written as written

#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class ArrayVariable:
    """A session variable with the one array that ``frame`` holds, a constant in the plans that read it.

    For arrays of a fixed size only. It is dropped when the ``with`` block ends, so all
    that reads it has to be written inside.
    """

    def __init__(self, frame: DataFrame, element: str = "BIGINT"):
        self.spark, self.element = frame.sparkSession, element
        self.name = f"session.v{uuid.uuid4().hex}"
        self.table = written(frame, "variable")

    def __enter__(self) -> str:
        view = f"t{uuid.uuid4().hex}"
        self.table.createOrReplaceTempView(view)
        self.spark.sql(f"DECLARE VARIABLE {self.name} ARRAY<{self.element}>")
        self.spark.sql(f"SET VAR {self.name} = (SELECT * FROM {view})")
        self.spark.catalog.dropTempView(view)
        discard(self.table)
        return self.name

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {self.name}")


def dense(rows: DataFrame, size: int, width: int = 1 << 10) -> DataFrame:
    """One row with an array ``vs`` of ``size`` longs: the bits of all ``v`` of the rows numbered ``at``, else 0."""
    zeros = rows.sparkSession.range(size).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("v"))
    filled = rows.select("at", "v").union(zeros).groupBy("at").agg(F.bit_or("v").alias("v"))
    parts = filled.groupBy(F.shiftright("at", width.bit_length() - 1).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vs"))
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "vs"))), lambda x: x["vs"])).alias("vs"))


#: Bytes of a batch of rows that a Python worker gets at once; a batch ends with the row that reaches them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of about ``BATCH_BYTES``, unless it has a smaller bound.

    By number of rows alone (10,000) a batch of documents has tens of MB, which executors and workers hold
    several times over. A stage's frame runs after the stage has returned, so the setting stays.
    """
    now = int(re.match(r"-?\d+", spark.conf.get(_BATCH, None) or "0")[0])
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Keys of more than one in HEAVY of all rows are dealt over SALTS tasks; so there are HEAVY such keys at most.
HEAVY, SALTS = 4096, 64
#: Rows of a table that is sent to every executor at most.
SMALL = 10_000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], place: list[str], total: int) -> DataFrame:
    """``rows`` left-joined on ``keys`` with ``table``, without its column ``many``.

    ``table``, a written one, has a row per key, and in ``many`` how many rows of all
    ``total`` have the key. It is broadcast if it has few rows. Else heavy keys are repeated for every salt; a row's salt
    is a hash of its columns ``place``, so it is the same if a task runs again.
    """
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table.drop("many")), keys, "left")
    hot = F.broadcast(table.where(F.col("many") * HEAVY >= total).select(*keys, F.lit(True).alias("_hot")))  # HEAVY rows at most
    mine = F.when(F.col("_hot"), F.pmod(F.xxhash64(*place), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))
    # (merged, as Spark would judge the table by the size of its compressed file)
    dealt = table.drop("many").join(hot, keys, "left").withColumn("_salt", every).drop("_hot").hint("merge")
    return rows.join(hot, keys, "left").withColumn("_salt", mine).drop("_hot").join(dealt, [*keys, "_salt"], "left").drop("_salt")


def word_count(col):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys() -> list:
    """ka, kb: two hashes that tell rows by doc_id and text."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "ka"), (2, "kb"))]


#: Bits of the filter that keeps most rows out of a join.
FILTER_BITS = 1 << 23


@contextlib.contextmanager
def passing(names: DataFrame, column: str):
    """A condition on the hashes ``column`` (longs) that holds for all of ``names``, and for few others while they are not too many."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    with ArrayVariable(dense(names.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("v")), FILTER_BITS >> 6)) as bits:
        yield F.expr(f"(shiftrightunsigned(get({bits}, cast(pmod({column}, {FILTER_BITS}) >> 6 AS int)), cast(pmod({column}, {FILTER_BITS}) & 63 AS int)) & 1) = 1")


def first_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``labels``, a written table (ka, kb, doc_id, root): the smallest id, null ids last.

    Rows that are surely kept and not repeated pass a filter and stay where they are;
    the others meet the list of kept rows. (A variable's value is in the plan from the
    start, so the frame may be used when the variable is gone.)
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb")
    kept = written(labels.groupBy("root").agg(F.min(place).alias("at")).select("at.ka", "at.kb"), "kept", few=True)
    once = labels.groupBy("ka", "kb").agg(F.count("*").alias("times"))
    doubtful = once.join(kept.withColumn("kept", F.lit(True)), ["ka", "kb"], "left").where("times > 1 OR kept IS NULL")
    rows = docs.select(*row_keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with passing(doubtful.select("ka"), "ka") as may:
        sure, rest = rows.where(~may), rows.where(may)
    one = rest.join(kept, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return sure.select("row.*").union(one.select("row.*"))
