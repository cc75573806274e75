"""The queries of this subpackage and, where SQL can express them, their SQL.

Each takes (spark, sf_dir), runs its operator with production parameters over
the whole table, and returns the whole result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    language_id,
    license_scan,
    line_dedup,
    media_sequences,
    mixing,
    packing,
    simhash,
    topk_nra,
    url_filter,
    warc_bundles,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(_table(spark, sf_dir, "embeddings")).drop("read_share")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_bundles.write_bundles(_table(spark, sf_dir, "pages"))
    return warc_bundles.read_records(index)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sequences.document_media(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    who = language_id.train(docs.where(language_id.doc_residue() != 2))
    return language_id.identify(docs, who)


OPERATORS = {f.__name__: f for f in (
    op1_line_dedup, op2_url_filter, op3_exact_topk, op4_warc, op5_mixing, op6_media_columns,
    op7_simhash, op8_packing, op9_license_scan, op10_language_id)}


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, **OPERATORS}


_OP1 = r"""
WITH lines AS (
  SELECT doc_id, CAST(no - 1 AS INTEGER) AS line_no, line
  FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line,
               UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL)
), sets AS (
  SELECT line, list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS s,
         min((doc_id, line_no)) AS first
  FROM lines GROUP BY line
), words AS (
  SELECT line, first, len(s) AS n, UNNEST(s) AS w FROM sets
), common AS (
  SELECT y.line AS line
  FROM words y JOIN words x ON x.w = y.w AND x.first < y.first
    AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY y.line, x.line, y.n, x.n
  HAVING 9 * count(*) >= 4 * (y.n + x.n)
), alike AS (SELECT DISTINCT line FROM common),
gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN sets s ON s.line = l.line
  WHERE len(s.s) > 0 AND (s.first < (l.doc_id, l.line_no) OR l.line IN (SELECT line FROM alike))
), per AS (SELECT doc_id, list_sort(list(DISTINCT line_no)) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
       CAST(coalesce(len(p.removed_lines), 0) AS INTEGER) AS n_removed,
       coalesce(p.removed_lines, CAST([] AS INTEGER[])) AS removed_lines
FROM documents d LEFT JOIN per p ON p.doc_id IS NOT DISTINCT FROM d.doc_id
"""

_OP2 = r"""
WITH rules(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), distinct_parts AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT d.host, d.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM distinct_parts d JOIN rules r ON (d.host = r.h OR d.host LIKE '%.' || r.h) AND starts_with(d.path, r.p)
  GROUP BY d.host, d.path
)
SELECT page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON b.host = p.host AND b.path = p.path
"""

_OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND c.dim = q.dim
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS stop FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM caps
), level AS (SELECT arg_min(level, (stop, -level)) AS level FROM levels WHERE level <= stop),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 'infinity'::DOUBLE) * w) AS target FROM caps
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size ELSE 0 END
            + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN (budget // source_size) * source_size ELSE 0 END) - before)) AS BIGINT) AS taken
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op2_url_filter": _OP2, "op3_exact_topk": _OP3, "op5_mixing": _OP5}
