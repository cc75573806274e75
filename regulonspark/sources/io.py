"""Readers and writers of networks, matrices, lists and metacells."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import Network

NET_SCHEMA = "regulator string, target string, mor double, likelihood double"
GENE_NAMES = ("human_symbol", "mouse_symbol", "human_ensembl", "mouse_ensembl", "human_entrez", "mouse_entrez")
COLLECTIONS = ("h", "c2", "c5", "c6", "c7")
SPECIES = ("human", "mouse")
GROUP_NAMES = ("tfs", "cotfs", "sig", "surf")


def _kind(path: str, kind: str | None) -> str:
    kind = kind or re.sub(r"\.(gz|gzip|bz2)$", "", path.rstrip("/")).rpartition(".")[2]
    if kind not in ("csv", "tsv", "parquet", "parquet.gzip"):
        raise ValueError("networks are csv, tsv or parquet; pickles are refused because reading one runs its code")
    return kind.split(".")[0]


def read_network(spark: SparkSession, path: str, name: str = "net", kind: str | None = None) -> Network:
    """Four columns by position; the kind is the path's extension if not given."""
    kind = _kind(path, kind)
    if kind == "parquet":
        return Network(spark.read.parquet(path), name)
    sep = "," if kind == "csv" else "\t"
    return Network(spark.read.option("header", True).option("sep", sep).schema(NET_SCHEMA).option("enforceSchema", True).csv(path), name)


def write_network(net: Network, path: str, kind: str | None = None) -> None:
    kind = _kind(path, kind)
    w = net.edges.write.mode("overwrite")
    w.option("compression", "gzip").parquet(path) if kind == "parquet" else w.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)


def read_aracne(spark: SparkSession, path: str, **how) -> Network:
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    at = {c: i for i, c in enumerate(t.columns)}
    pick = [next(i for c, i in at.items() if c.split(".")[0] == n) for n in ("regulator", "target", "mi", "scc", "count")]
    t = t.toDF(*[f"c{i}" for i in range(len(at))])
    return Network.from_aracne(t.select(*[F.col(f"c{i}").cast(k) for i, k in zip(pick, ("string", "string", "double", "double", "bigint"))]), **how)


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", samples_in_columns: bool = True) -> DataFrame:
    """A text matrix with a name column as (sample, feature, value)."""
    from ..operators.common import from_wide

    t = spark.read.option("header", True).option("sep", sep).csv(path)
    long = from_wide(t, t.columns[0])
    return long.select(F.col("feature").alias("sample"), F.col("sample").alias("feature"), "value") if samples_in_columns else long


def read_gene_names(spark: SparkSession, path: str) -> DataFrame:
    """The translation table: six columns of text by name."""
    t = spark.read.option("header", True).csv(path)
    if missing := [c for c in GENE_NAMES if c not in t.columns]:
        raise ValueError(f"missing columns {missing}")
    return t.select(*GENE_NAMES)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


@dataclass(frozen=True)
class Options:
    """Species and paths of regulator lists: an immutable value, not a global."""

    species: str = "human"
    paths: dict[tuple[str, str], str] = field(default_factory=dict)

    def with_species(self, species: str) -> Options:
        if species not in SPECIES:
            raise ValueError(f"species are {SPECIES}")
        return replace(self, species=species)

    def with_path(self, group: str, species: str, path: str) -> Options:
        if group not in GROUP_NAMES or species not in SPECIES:
            raise ValueError(f"groups are {GROUP_NAMES}, species {SPECIES}")
        return replace(self, paths={**self.paths, (group, species): path})

    def regulators(self, spark: SparkSession, group: str, species: str | None = None, path: str | None = None) -> DataFrame:
        found = path or self.paths.get((group, species or self.species))
        if not found:
            raise ValueError(f"no path is set for {group} of {species or self.species}")
        return read_names(spark, found)

    def groups(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {g: read_names(spark, p) for (g, s), p in self.paths.items() if s == self.species}


def read_collections(spark: SparkSession, folder: str, collections) -> Network:
    """Gene-set collections from ``folder/<name>.parquet``, one or several, repeated pairs once."""
    wanted = [collections] if isinstance(collections, str) else list(collections)
    if bad := [c for c in wanted if c not in COLLECTIONS]:
        raise ValueError(f"unknown collections {bad}")
    nets = [Network(spark.read.parquet(f"{folder}/{c}.parquet"), c).edges for c in wanted]
    out = nets[0]
    for e in nets[1:]:
        out = out.unionByName(e)
    return Network(out, "+".join(wanted)).remove_duplicate_pairs()


def read_tissue_network(spark: SparkSession, folder: str, tissue: str, cell_type: str, catalog: DataFrame, mapping: DataFrame | None = None,
                        target: str | None = None) -> Network:
    """A published network by tissue and cell type, if ``catalog`` (tissue, cell_type, path) has it, in other names if asked."""
    row = catalog.where((F.col("tissue") == tissue) & (F.col("cell_type") == cell_type)).select("path").first()
    if row is None:
        raise ValueError(f"the catalog has no {cell_type} of {tissue}")
    net = Network(spark.read.parquet(f"{folder}/{row['path']}"), f"{tissue}-{cell_type}")
    if target and mapping is not None and target != "human_ensembl":
        net = net.translate_targets(mapping, "human_ensembl", target).translate_regulators(mapping, "human_ensembl", target)
    return net


def write_metacells(counts: DataFrame, path: str, kind: str = "tsv") -> None:
    """One folder per cluster with metacell, feature, count: tab- or comma-separated text, or Parquet."""
    w = counts.write.mode("overwrite").partitionBy("cluster")
    if kind == "parquet":
        w.parquet(path)
    elif kind in ("tsv", "csv"):
        w.option("sep", "\t" if kind == "tsv" else ",").option("header", True).csv(path)
    else:
        raise ValueError("metacells are written as tsv, csv or parquet")


def transfer_obs(result: DataFrame, obs: DataFrame) -> DataFrame:
    return result.join(obs, "sample", "left")
