"""Networks and matrices derived from the star schema, as SQL text for any engine."""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

_EDGES = ("SELECT CAST(l_suppkey AS STRING) AS regulator, CAST(l_partkey AS STRING) AS target, "
          "round(greatest(-1.0, least(1.0, (avg(l_discount) - 0.05) / 0.05)), 6) AS mor, sum(l_quantity) AS likelihood "
          "FROM {lineitem} %s GROUP BY l_suppkey, l_partkey")
#: Suppliers regulate parts.
N1 = _EDGES % ""
N2 = _EDGES % "WHERE l_linestatus = 'F'"
N3 = _EDGES % "WHERE l_linestatus = 'O'"
#: Ungrouped: repeated pairs.
N0 = ("SELECT CAST(l_suppkey AS STRING) AS regulator, CAST(l_partkey AS STRING) AS target, round(l_discount - 0.05, 6) AS mor, "
      "l_quantity AS likelihood FROM {lineitem}")
#: Revenue of parts by the customers' nation, sparse.
M1_SPARSE = ("SELECT CAST(c_nationkey AS STRING) AS sample, CAST(l_partkey AS STRING) AS feature, "
             "round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM {lineitem} "
             "JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, l_partkey")
#: Weights of that matrix's cells by part and nation; none for every eleventh part.
CELL_WEIGHTS = ("SELECT DISTINCT CAST(c_nationkey AS STRING) AS sample, CAST(l_partkey AS STRING) AS feature, "
                "1.0 - CAST(l_partkey % 7 AS DOUBLE) / 10 - CAST(c_nationkey % 3 AS DOUBLE) / 20 AS weight FROM {lineitem} "
                "JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey WHERE l_partkey % 11 > 0")
BRANDS = "SELECT CAST(p_partkey AS STRING) AS id, p_brand || '-' || CAST(p_size AS STRING) AS name FROM {part}"
ARACNE = ("SELECT CAST(l_suppkey AS STRING) AS regulator, CAST(l_partkey AS STRING) AS target, round(avg(l_extendedprice) / 1000, 6) AS mi, "
          "round(avg(l_discount) - 0.05, 6) AS scc, count(*) AS count FROM {lineitem} GROUP BY l_suppkey, l_partkey")


def spark_view(spark, sf_dir: str, sql: str):
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{%s}" % t, t)
    return sql


M1 = ("SELECT s.sample AS sample, f.feature AS feature, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT sample FROM m1s) s "
      "CROSS JOIN (SELECT DISTINCT feature FROM m1s) f LEFT JOIN m1s v ON v.sample = s.sample AND v.feature = f.feature")
M2 = ("SELECT CAST(vec_id AS STRING) AS sample, CAST(i - 1 AS STRING) AS feature, CAST(embedding[i] AS DOUBLE) AS value, CAST(label AS STRING) AS cluster "
      "FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")


def ctes(*names: str) -> str:
    """A WITH clause of the named views and what they need, for an engine that has the tables as views."""
    text = {"cw": CELL_WEIGHTS, "n1": N1, "n2": N2, "n3": N3, "n0": N0, "m1s": M1_SPARSE, "m1": M1, "m2": M2, "brands": BRANDS, "aracne": ARACNE}
    order = [n for n in text if n in names or (n == "m1s" and "m1" in names)]
    return "WITH " + ", ".join(f"{n} AS ({plain(text[n])})" for n in order)
