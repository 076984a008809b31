import math

import pytest
from pyspark.sql import functions as F

from crowdnet.operators import networks, query
from crowdnet.sources import store, text

NAMES = ["G1", "G2", "G3", "G4"]


@pytest.fixture
def net(spark):
    return spark.createDataFrame([(1, 0, 1, 0.5, 1.0), (2, 0, 0, 1.25, 2.0), (3, 1, 2, 4.0, 3.0)], "i long, j long, direction int, score double, rank double")


@pytest.fixture
def names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "node long, name string")


def test_network_round_trip(spark, net, names, tmp_path):
    path = str(tmp_path / "net")
    store.write_network(store.Network(names, net, networks.strength(net), {"algorithm": "x"}), path)
    back = store.read_network(spark, path)
    assert sorted(back.edges.collect()) == sorted(net.collect()) and back.meta == {"algorithm": "x", "version": store.VERSION}
    assert {r["key"]: r["value"] for r in back.header().collect()} == {"algorithm": "x", "version": store.VERSION, "nodes": "4", "edges": "3", "dense": "false"}
    assert store.centrality_lines(back).count() == 8
    less = back.subset("score < 1").reheadered()
    store.write_network(less, path + "2")
    again = store.read_network(spark, path + "2")
    assert [tuple(r) for r in again.nodes.orderBy("node").collect()] == [(0, "G1"), (1, "G2")] and again.edges.count() == 1 and again.centrality is None
    assert again.header().filter("key = 'dense'").first()["value"] == "true"


@pytest.mark.parametrize(("kind", "diagonal"), [("sym-mat", False), ("low-tri", False), ("low-tri", True), ("up-tri", False), ("up-tri", True), ("aracne", False), ("edge-list", False)])
def test_written_formats_read_back(spark, net, names, tmp_path, kind, diagonal):
    path = str(tmp_path / "m")
    lines = text.matrix_lines(net, names, kind, diagonal, precision=3)
    lines.orderBy("i").select("value").coalesce(1).write.text(path)
    if kind == "sym-mat":
        back = text.full_matrix(spark, path)
    elif kind in ("low-tri", "up-tri"):
        back = text.triangle(spark, path, kind.split("-")[0].replace("low", "lower").replace("up", "upper"), diagonal).withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b")})
    else:
        back = (text.gene_rows if kind == "aracne" else text.edge_list)(spark, path, names)
    got = {(r["a"], r["b"]): r["w"] for r in back.collect()}
    want = {(r["i"], r["j"]): r["score"] for r in net.collect()}
    assert {k: v for k, v in got.items() if k[0] > k[1] and not math.isnan(v)} == want
    if kind == "low-tri":
        assert len(got) == 6


def test_gaps_are_filled(spark, net):
    got = text.filled(net.select(F.col("j").alias("a"), F.col("i").alias("b"), F.col("score").alias("w")), 4, -1.0).collect()
    assert len(got) == 6 and sorted((r["a"], r["b"]) for r in got if r["w"] == -1) == [(2, 1), (3, 0), (3, 2)]
    rows = {r["i"]: r["values"] for r in query.matrix_rows(net, spark.range(4).withColumnRenamed("id", "node"), "upper", True, 0.0).collect()}
    assert rows == {0: [0.0, 0.5, 1.25, 0.0], 1: [0.0, 0.0, 4.0], 2: [0.0, 0.0], 3: [0.0]}


def test_lines_of_many_networks(spark, names, net):
    wide = net.select("i", "j", "direction", F.col("score").alias("s_x"), F.col("rank").alias("r_x"), F.lit(None).cast("double").alias("s_y"), F.lit(None).cast("double").alias("r_y"), F.lit("t").alias("tag"))
    got = [r["value"] for r in text.wide_lines(wide, names, ["x", "y"], ["tag"], dense=networks.strength(net).select("node", "degree")).orderBy("i", "j").collect()]
    assert got == ["G2\tG1\tDirected\t0.5;1.0\tnan;nan\tt\t2;2", "G3\tG1\tUndirected\t1.25;2.0\tnan;nan\tt\t1;2", "G2\tG4\tDirected\t4.0;3.0\tnan;nan\tt\t2;1"]
    assert text.wide_titles(["x"], ["tag"], ["degree"]) == "Source\tTarget\tType\tx_score;x_rank\ttag\tdegree_source;degree_target"
    assert text.wide_lines(wide, None, ["x"]).filter("i = 3").first()["value"] == "1\t3\tDirected\t4.0;3.0"


def test_tree_paths_are_filled_to_the_deepest(spark, tmp_path):
    path = tmp_path / "tree"
    path.write_text('# a comment\n1:1 0.5 "A" 0\n1:2:1 0.2 "B" 1\n2 0.1 "C d" 2\n')
    got = text.resolved(spark, str(path))
    assert got.columns == ["name", "level1", "level2", "level3"]
    assert sorted(map(tuple, got.collect())) == [("A", "1", "1", "NA"), ("B", "1", "2", "1"), ("C d", "2", "NA", "NA")]


def test_directed_strength(spark, net):
    got = {r["node"]: (r["out_strength"], r["in_strength"], r["strength"]) for r in query.directed_strength(net).collect()}
    assert got == {0: (1.25, 1.75, 3.0), 1: (4.5, 0.0, 4.5), 2: (1.25, 1.25, 2.5), 3: (0.0, 4.0, 4.0)}
