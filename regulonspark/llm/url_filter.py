"""URL rules behind a blocked Bloom filter.

A rule is a host and a path. It fits the host and all its subdomains where the
URL's path starts with the rule's path; the longest fitting rule decides. Each
URL has a few canonical keys (a suffix of its host at a label border, and a
prefix of its path as long as some rule's path). The keys are tested against a
blocked Bloom filter of all rules, of a size fixed by a parameter (hosts first, so
that paths are only cut for hosts that some rule may have); what passes
goes to an exact hash join with the rules, which removes the false positives.
Each host and path is judged once. The verdicts are joined to the rows, where hosts
and paths that very many rows share are dealt over many tasks.
All of it is DataFrame expressions.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and the default verdict. Equal URLs get equal verdicts, repeated rows
stay as they are, an empty table gives an empty result, an empty rule list
gives the default everywhere. Only ``id_col`` and ``url_col`` are read, so extra columns cannot clash.
Of rules that state the same host and path, ``block`` wins over ``allow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import HEAVY, salted_join, written

#: The rules of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(rule, ("host", "path", "verdict")))) for rule in rules]
    kind = "array<struct<host:string,path:string,verdict:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def _lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url):
    """(host, path) columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = _lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _hashed(blocks: int, *key):
    """Block number and 64-bit mask of a key: four bits of one word."""
    h = F.xxhash64(*key)
    block = F.pmod(h, F.lit(blocks)).cast("int")
    bits = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int") for s in (40, 46, 52, 58)]
    mask = F.lit(0).cast("long")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return block, mask


def bloom_words(rules: DataFrame, blocks: int, *key: str) -> DataFrame:
    """One row: the filter of the rules' columns ``key`` as an array of ``blocks`` 64-bit words."""
    block, mask = _hashed(blocks, *map(F.col, key))
    words = rules.select(block.alias("b"), mask.alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("w"))
    return packed.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0).cast("long")),
        ).alias("words")
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT_VERDICT,
    blocks: int = 4096,
) -> DataFrame:
    """id_col, host, path, rule, verdict for every row of ``pages``.

    ``blocks`` is the size of the Bloom filter in 64-bit words: the filter's
    32 KB are the same for any number of rules, beyond some 20,000 of which it
    should be raised (to 1,000,000 at most); a fuller filter passes more keys
    on to the exact join and never changes the result.
    """
    if not 1 <= blocks <= 1_000_000:
        raise ValueError("blocks must be from 1 to 1,000,000")
    rules = rules.where("host is not null and path is not null").groupBy(
        F.lower("host").alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    hosts, words = (bloom_words(rules, blocks, *key).scalar() for key in (["host"], ["host", "path"]))
    lengths = rules.agg(F.coalesce(F.array_sort(F.collect_set(F.length("path"))), F.array().cast("array<int>"))).scalar()

    def passes(filter_, *key):
        block, mask = _hashed(blocks, *key)
        return F.get(filter_, block).bitwiseAND(mask) == mask

    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    known = parts.groupBy("host", "path").agg(F.count("*").alias("many"))
    labels = F.split("host", r"\.")
    keys = (
        known.select("host", "path").withColumn("labels", labels)
        .withColumn("h", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("labels")),
            lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))))
        .where(passes(hosts, F.col("h")))
        .withColumn("n", F.explode(lengths))
        .where(F.col("n") <= F.length("path"))
        .withColumn("p", F.expr("left(path, n)"))
    )
    possible = keys.where(passes(words, F.col("h"), F.col("p"))).select("host", "path", "h", "p")
    exact = possible.join(
        rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    best = exact.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict")),
                 F.struct(F.length("h") + F.length("p"), F.length("h"))).alias("best"))
    total = pages.count()
    # (rows without a rule are in the table only where they are very many of one kind)
    judged = written(
        known.join(best, ["host", "path"], "left").where(F.col("best").isNotNull() | (F.col("many") * HEAVY >= total))
        .select("host", "path", "many", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-verdicts")
    return salted_join(parts, judged, ["host", "path"], ["_id"], total).select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
