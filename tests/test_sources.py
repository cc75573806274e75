"""Readers and writers, translation, groups and plot frames on files and frames of a few rows."""

from __future__ import annotations

import pytest

from regulonspark.operators import common as K, network as W, tools as T
from regulonspark.plans import plot_frames as V
from regulonspark.sources import io, store

NET = "regulator string, target string, mor double, likelihood double"
NAMES = "human_symbol string, mouse_symbol string, human_ensembl string, mouse_ensembl string, human_entrez string, mouse_entrez string"
GENES = [("TP53", "Trp53", "ENSG1", "ENSM1", "7157", "22059"), ("MYC", "Myc", "ENSG2", "ENSM2", "4609", "17869"), ("SHARED", "SHARED", "ENSG3", None, "-1", ""), ("TP53", "Dup", "ENSG9", None, None, None)]


def net(spark, rows):
    return W.Network(spark.createDataFrame(rows, NET))


def test_matrices_with_any_names(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("gene\tcell.1\tcell 2\nA.1\t1\t2.5\nsample\t3\t0\n")
    got = {(r.sample, r.feature): r.value for r in io.read_matrix(spark, str(p)).collect()}
    assert got == {("cell.1", "A.1"): 1, ("cell 2", "A.1"): 2.5, ("cell.1", "sample"): 3, ("cell 2", "sample"): 0}
    wide = spark.createDataFrame([("s", 1.0, 2.0)], "`id.x` string, `A.1` double, sample double")
    assert sorted(tuple(r) for r in K.from_wide(wide, "id.x").collect()) == [("s", "A.1", 1.0), ("s", "sample", 2.0)]
    assert {tuple(r) for r in K.from_vectors(spark.createDataFrame([(7, [1.0, 2.0])], "id int, v array<double>"), "id", "v").collect()} == {("7", "0", 1.0), ("7", "1", 2.0)}
    back = K.to_wide(K.from_wide(wide, "id.x"))
    assert set(back.columns) == {"sample", "A.1"} or set(back.columns) >= {"A.1"}


def test_sparse_matrices_get_their_zeros(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "sample string, feature string, value double")
    assert sorted(tuple(r) for r in K.densify(m).collect()) == [("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0), ("b", "y", 2.0)]


def test_counts_have_to_be_of_the_same_samples(spark):
    c = spark.createDataFrame([(1, "g", 3), (2, "g", 4)], "cell int, gene string, n int")
    got = K.counts_of(c, spark.createDataFrame([("1",), ("2",)], "s string"), "cell", "gene", "n")
    assert {tuple(r) for r in got.collect()} == {("1", "g", 3.0), ("2", "g", 4.0)}
    for others in (["1"], ["1", "2", "3"]):
        with pytest.raises(ValueError):
            K.counts_of(c, spark.createDataFrame([(o,) for o in others], "s string"), "cell", "gene", "n")


def test_aracne_files(spark, tmp_path):
    p = tmp_path / "net.tsv"
    p.write_text("regulator.values\ttarget.values\tmi.values\tscc.values\tcount.values\tlog.p.values\nr\ta\t0.5\t0.2\t3\t-1\nr\tb\t1.0\t-0.4\t2\t-1\nr\tc\t0.1\t0.1\t9\t-1\nq\ta\t0.8\t0.3\t1\t-1\n")
    got = {(r.regulator, r.target): (r.mor, r.likelihood) for r in io.read_aracne(spark, str(p), mi_threshold=0.2, regulon_size=1).edges.collect()}
    assert got == {("r", "a"): (0.2, 1.0), ("q", "a"): (0.3, 1.0)}
    names = spark.createDataFrame([("r", "R1"), ("a", "A1"), ("a", "A2")], "id string, name string")
    whole = io.read_aracne(spark, str(p), annotation=names, normalize_per_regulon=False).edges.collect()
    assert {(r.regulator, r.target): r.likelihood for r in whole} == {("R1", "A1"): 0.5, ("R1", "b"): 1.0, ("R1", "c"): 0.1, ("q", "A1"): 0.8}


def test_names_groups_and_options(spark, tmp_path):
    p = tmp_path / "tfs.txt"
    p.write_text("g1\n\ng2 \ng2\n")
    options = io.Options().with_path("tfs", "human", str(p))
    assert sorted(r.name for r in options.regulators(spark, "tfs").collect()) == ["g1", "g2", "g2"]
    assert sorted(r.name for r in options.regulators(spark, "surf", path=str(p)).collect()) == ["g1", "g2", "g2"]
    assert io.Options().paths == {} and options.with_species("mouse").species == "mouse"
    for bad in (lambda: options.with_species("fly"), lambda: options.with_path("x", "human", ""), lambda: options.regulators(spark, "sig")):
        with pytest.raises(ValueError):
            bad()
    rows = [("g1", "t1", 0.5, 1.0), ("g3", "t2", 0.5, 1.0), ("tfs", "t3", 0.5, 1.0)]
    grouped = W.Network(spark.createDataFrame(rows, NET), groups=options.groups(spark))
    assert [r.regulator for r in grouped.filter_regulators(keep="TFs").edges.collect()] == ["g1"]
    assert {r.regulator for r in grouped.filter_regulators(remove=["tfs"]).edges.collect()} == {"g3", "tfs"}
    assert grouped.filter_targets(remove=["t1", "t2"]).edges.first().target == "t3"


def test_collections_and_tissue_networks(spark, tmp_path):
    for name, rows in (("h", [("set1", "a", 1.0, 1.0), ("set1", "b", 1.0, 1.0)]), ("c5", [("set1", "a", 1.0, 0.5), ("set2", "c", 1.0, 1.0)])):
        spark.createDataFrame(rows, NET).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {(r.regulator, r.target): r.likelihood for r in io.read_collections(spark, str(tmp_path), ["h", "c5"]).edges.collect()} == {
        ("set1", "a"): 1.0, ("set1", "b"): 1.0, ("set2", "c"): 1.0}
    assert io.read_collections(spark, str(tmp_path), "h").edges.count() == 2
    with pytest.raises(ValueError):
        io.read_collections(spark, str(tmp_path), "c9")
    spark.createDataFrame([("ENSG1", "ENSG2", 0.5, 1.0), ("ENSG1", "ENSG8", 0.5, 1.0)], NET).write.parquet(f"{tmp_path}/lung.parquet")
    catalog = spark.createDataFrame([("lung", "T cell", "lung.parquet")], "tissue string, cell_type string, path string")
    genes = spark.createDataFrame(GENES, NAMES)
    got = io.read_tissue_network(spark, str(tmp_path), "lung", "T cell", catalog, genes, "human_symbol")
    assert [(r.regulator, r.target) for r in got.edges.collect()] == [("TP53", "MYC")]
    assert io.read_tissue_network(spark, str(tmp_path), "lung", "T cell", catalog).edges.count() == 2
    with pytest.raises(ValueError):
        io.read_tissue_network(spark, str(tmp_path), "lung", "B cell", catalog)


def test_translation(spark, tmp_path):
    p = tmp_path / "names.csv"
    p.write_text("extra," + ",".join(io.GENE_NAMES) + "\n" + "\n".join(",".join(["x", *(dict(zip([c.split()[0] for c in NAMES.split(", ")], g))[n] or "" for n in io.GENE_NAMES)]) for g in GENES) + "\n")
    genes = io.read_gene_names(spark, str(p))
    assert genes.columns == list(io.GENE_NAMES) and genes.count() == 4
    (tmp_path / "few.csv").write_text("human_symbol\nA\n")
    with pytest.raises(ValueError):
        io.read_gene_names(spark, str(tmp_path / "few.csv"))
    genes = spark.createDataFrame(GENES, NAMES)
    names = spark.createDataFrame([(0, "MYC"), (1, "none"), (2, "SHARED"), (3, "TP53"), (4, "MYC")], "at int, name string")
    one = T.translate(names, genes, "human_symbol", "human_entrez", order="at")
    assert sorted((r.at, r.translated) for r in one.collect()) == [(0, "4609"), (3, "7157")]
    every = T.translate(names, genes, "human_symbol", "mouse_symbol", order="at", eliminate=False, remove_duplicates=False)
    assert sorted((r.at, r.translated or "") for r in every.collect()) == [(0, "Myc"), (1, ""), (2, "SHARED"), (3, "Dup"), (4, "Myc")]
    both = net(spark, [("TP53", "MYC", 0.5, 1.0), ("MYC", "other", 0.5, 1.0), ("SHARED", "TP53", 0.1, 1.0)])
    assert sorted((r.regulator, r.target) for r in both.translate_regulators(genes, "human_symbol", "human_entrez").edges.collect()) == [("4609", "other"), ("7157", "MYC")]
    assert sorted((r.regulator, r.target) for r in both.translate_targets(genes, "human_symbol", "mouse_ensembl").edges.collect()) == [("SHARED", "ENSM1"), ("TP53", "ENSM2")]


def test_kind_of_names_is_that_of_the_first_found(spark):
    genes = spark.createDataFrame(GENES, NAMES)

    def kind(*names):
        f = spark.createDataFrame(list(enumerate(names)), "at int, name string")
        return T.detect_name_type(f, genes, order="at").first().name_type

    assert kind("none", "TP53", "SHARED") == "human_symbol" and kind("SHARED", "TP53") == "mouse_symbol"
    assert kind("ENSG2") == "human_ensembl" and kind("17869", "TP53") == "mouse_entrez" and kind("none") is None


def test_networks_from_incidence_and_nested(spark):
    t = spark.createDataFrame([("r", "a", 1), ("r", "b", 0), ("q", "a", 1)], "r string, t string, p int")
    assert {(r.regulator, r.target, r.mor, r.likelihood) for r in W.Network.from_incidence(t).edges.collect()} == {("r", "a", 1.0, 1.0), ("q", "a", 1.0, 1.0)}
    nested = {r.regulator: [tuple(e) for e in r.edges] for r in net(spark, [("r", "b", 0.1, 2.0), ("r", "a", 0.2, 1.0)]).regulons().collect()}
    assert nested == {"r": [("a", 0.2, 1.0), ("b", 0.1, 2.0)]}
    with pytest.raises(ValueError):
        W.Network(t)


def test_metacell_files_and_sample_annotation(spark, tmp_path):
    c = spark.createDataFrame([("x", 0, "A.1", 3.0), ("y", 0, "B", 1.0)], "cluster string, metacell int, feature string, count double")
    for kind in ("tsv", "csv", "parquet"):
        io.write_metacells(c, f"{tmp_path}/{kind}", kind)
        r = spark.read.parquet(f"{tmp_path}/{kind}") if kind == "parquet" else spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(f"{tmp_path}/{kind}")
        assert {(x["cluster"], x["feature"], float(x["count"])) for x in r.collect()} == {("x", "A.1", 3.0), ("y", "B", 1.0)}
    with pytest.raises(ValueError):
        io.write_metacells(c, f"{tmp_path}/z", "pickle")
    got = io.transfer_obs(spark.createDataFrame([("s", 1.0)], "sample string, nes double"), spark.createDataFrame([("s", "k")], "sample string, kind string"))
    assert got.first().kind == "k"


def test_written_tables_come_and_go(spark):
    t = store.written(spark.range(5), "five")
    assert t.count() == 5
    store.discard(t)
    with pytest.raises(Exception):
        spark.read.schema(t.schema).parquet(t.stored_at).count()


def test_plot_frames(spark):
    m = "sample string, feature string, value double"
    act = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 25.0), ("t", "a", -3.0), ("t", "b", 0.0)], m)
    obs = spark.createDataFrame([("s", "x"), ("t", "y")], "sample string, kind string")
    xy = spark.createDataFrame([("s", 0.0), ("t", 1.0)], "sample string, x double")
    got = V.plot_frame(act, act, variables=["b", "none"], obs=obs, coordinates=xy).collect()
    assert {(r.sample, r.variable, r.value, r.kind, r.x) for r in got} == {("s", "b", 25.0, "x", 0.0), ("s", "b_gExpr", 25.0, "x", 0.0), ("t", "b", 0.0, "y", 1.0), ("t", "b_gExpr", 0.0, "y", 1.0)}
    assert {r.variable for r in V.plot_frame(None, act).collect()} == {"a", "b"}
    edges = spark.createDataFrame([("a", "g", 0.5, 1.0), ("b", "g", -0.1, 1.0), ("c", "h", 1.0, 1.0)], NET)
    nodes, links = V.network_frames(edges, act, spark.createDataFrame([("s", "g", 2.0), ("t", "g", 4.0)], m), spark.createDataFrame([("a",), ("b",)], "r string"))
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"a", "b", "g"} and n["g"].value == 3.0 and n["g"].mor == pytest.approx(0.2) and n["b"].colour == 1.0 and n["a"].value == -1.0
    assert {(r.src, r.dst) for r in links.collect()} == {("a", "g"), ("b", "g")}
