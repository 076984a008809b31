import random

import pytest
from pyspark.sql import functions as F

from crowdnet import commands
from crowdnet.sources import store

GENES = ["G1", "G2", "G3", "G4", "G5"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    path = tmp_path_factory.mktemp("in")
    (path / "genes").write_text("\n".join(GENES) + "\n")
    (path / "lm").write_text("0\n1\t2\n3\t4\t5\n6\t7\t8\t9\n")
    rng = random.Random(2)
    (path / "el").write_text("".join(f"{a}\t{b}\t{rng.randrange(1, 30)}\n" for a in GENES for b in GENES if a != b))
    (path / "m").write_text("\n".join("\t".join(str(5 * i + j) for j in range(5)) for i in range(5)) + "\n")
    return path


@pytest.fixture(scope="module")
def nets(spark, files):
    genes = str(files / "genes")
    x = commands.import_network(spark, str(files / "lm"), genes, "x", "lm")
    y = commands.import_network(spark, str(files / "el"), genes, "y", "el", reverse=True, drop_zero=True)
    z = commands.import_network(spark, str(files / "m"), genes, **{k: v for k, v in commands.import_preset("genie3").items()})
    return x, y, z


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("i", "j").collect()]


def test_published_import_of_a_lower_triangle(nets):
    got = values(commands.pick(nets[0]), "i", "j", "direction", "score", "rank")
    assert got == [(i, j, 1, float(k), k + 1.0) for k, (i, j) in enumerate((i, j) for i in range(5) for j in range(i))]
    with pytest.raises(ValueError, match="format"):
        commands.import_network(nets[0].nodes.sparkSession, "", "", "q", "none")


def test_consensus_and_views(spark, nets, tmp_path):
    net = commands.index(commands.aggregate(list(nets), keep=True), str(tmp_path / "net"))
    assert commands.algorithms(net) == ["x", "y", "GENIE3", "irp"] and commands.pick(net).count() == 10 and commands.pick(net, 2).count() == 10
    with pytest.raises(ValueError, match="index"):
        commands.pick(net, 5)
    whole = commands.view(net, column_headers=True).collect()
    assert whole[0]["value"].startswith("Source\tTarget\tType\tx_score;x_rank") and len(whole) == 11
    assert commands.view(net, threshold=0.5).count() == commands.pick(net).filter("score > 0.5").count()
    assert commands.view(net, threshold=3, threshold_rank=True, index=1).count() == 2
    assert commands.view(net, filter="s0 > 3 & r0 < 8").count() == 3 and commands.view(net, lines=4).count() == 4
    assert [r["value"].split("\t")[:2] for r in commands.view(net, nodelist=["g1:g3"], case_insensitive=True).collect()][0] in (["G3", "G1"], ["G1", "G3"])
    assert commands.view(net, no_names=True, nodelist=["G2"]).count() == 4
    assert commands.view_subset(net, "score > 0.5").edges.count() < net.edges.count()
    assert commands.top(net, 3).count() == 3 and commands.neighbours(net, 2).count() == 10 and commands.neighbours(net, 1, genes=["g5"], case_insensitive=True).count() == 1
    with pytest.raises(ValueError, match="G9"):
        commands.neighbours(net, genes=["G9"], strict=True)
    assert commands.sample(net, fraction=0.5).count() == 5 and commands.sample(net, nedges=12, replacement=True).count() == 12
    assert commands.describe(net).count() == 4 and commands.describe(net, bins=5).groupBy("alg").agg(F.sum("n")).count() == 4
    with_stats = commands.stats(net, metrics=("PR", "STR", "CLO", "BTW", "EV", "KTZ", "LPC", "SEC", "EBC"))
    assert with_stats.centrality.columns == ["node", "PR", "STR", "CLO", "BTW", "EV", "KTZ", "LPC"] and with_stats.centrality.count() == 5
    assert with_stats.edges.filter("SEC IS NOT NULL").count() == 10 and with_stats.edges.filter("alg = 'irp' AND EBC IS NULL").count() == 0
    assert commands.view(with_stats, dense=True, column_headers=True).first()["value"].endswith("LPC_source;LPC_target")
    assert commands.graphstats(net).count() == 9 and commands.threshold(net, nsteps=4).count() == 5 and commands.backbone(net).count() == 10
    assert commands.asp(net, use_rank=True).count() == 25
    assert store.centrality_lines(with_stats).count() == 35
    assert commands.version()


def test_formats_and_comparisons(spark, nets, files):
    net = commands.aggregate(list(nets))
    for source, target in (("sym-mat", "low-tri"), ("edge-list", "aracne"), ("edge-list", "up-tri-diag")):
        infile = {"sym-mat": "m", "edge-list": "el"}[source]
        assert commands.convert(spark, str(files / infile), str(files / "genes"), source, target).count() in (4, 5)
    assert commands.adjacency(net, fmt="lm", index=1).count() == 4
    assert [r["value"] for r in commands.convert(spark, str(files / "lm"), str(files / "genes"), "low-tri", "low-tri", precision=0).orderBy("i").collect()] == ["0", "1\t2", "3\t4\t5", "6\t7\t8\t9"]
    same = commands.compare(net, net, 1, 1).collect()
    assert len(same) == 10 and all(r["flag"] == 0 and r["rank"] == 2 * r["rank_a"] for r in same)
    assert {r["flag"] for r in commands.compare(nets[0], nets[1], nodes=True).collect()} == {0}
    gold = spark.createDataFrame([(1, 0), (4, 3)], "i long, j long")
    assert commands.roc(net, gold, all=True).count() == 4 and commands.roc(net, gold, fraction=0.5).count() >= 1
    assert commands.tau(net, net, index_a=1, index_b=1).filter("tau < 1").count() == 0


def test_published_comparison_with_orthologs(spark):
    """Two networks of renamed genes, as published; one rank is printed there without its second digit."""
    ranks = [("2", "1", 7), ("3", "1", 5), ("3", "2", 2), ("4", "1", 1), ("4", "2", 4), ("5", "1", 3), ("5", "2", 6)]
    other = [8, 6, 3, 1, 5, 4, 7]

    def network(letter, rows):
        names = sorted({letter + v for r in rows for v in r[:2]})
        at = {n: k for k, n in enumerate(names)}
        edges = [(at[letter + a], at[letter + b], "n", 0, 1.0, float(r)) for a, b, r in rows]
        return store.Network(spark.createDataFrame([(k, n) for n, k in at.items()], "node long, name string"), spark.createDataFrame(edges, "i long, j long, alg string, direction int, score double, rank double"), None, {"algorithms": "n"})

    x, y = network("A", ranks), network("B", [(a, b, r) for (a, b, _), r in zip(ranks, other, strict=True)] + [("7", "6", 2)])
    words = spark.createDataFrame([(f"A{k}", f"B{k}") for k in range(1, 6)], "old string, new string")
    got = {(r["i"], r["j"]): (round(r["score"], 6), r["rank"], r["flag"], r["rank_a"], r["rank_b"]) for r in commands.compare(x, y, translate=words).collect()}
    want = {(f"A{a},B{a}", f"A{b},B{b}"): (round(1 - (r + s - 2) / 13, 6), r + s, 0, r, s) for (a, b, r), s in zip(ranks, other, strict=True)} | {("B7", "B6"): (1.0, 2, 2, 0, 2)}
    assert got == want and got["A3,B3", "A1,B1"][:2] == (0.307692, 11)
    nodes = {r["node"]: r["flag"] for r in commands.compare(x, y, translate=words, nodes=True).collect()}
    assert nodes == {**{f"A{k},B{k}": 0 for k in range(1, 6)}, "B6": 2, "B7": 2}


def test_inference_commands(spark, tmp_path):
    rng = random.Random(3)
    expr = spark.createDataFrame([(s, g, rng.gauss(0, 1) + (s % 3) * (g < 2)) for s in range(40) for g in range(5)], "sample int, gene int, value double")
    for method in ("pearson", "spearman", "bicor"):
        assert commands.correlation(expr, method, absolute=True).filter("score >= 0").count() == 10
    assert commands.pcor(expr, targets=[1]).count() == 4 and commands.tomsimilarity(expr, sft=2).count() == 10
    path = str(tmp_path / "mi")
    raw = {(r["i"], r["j"]): r["score"] for r in commands.mi(expr, bins=4, mi_path=path).collect()}
    assert raw == {(r["i"], r["j"]): r["score"] for r in commands.mi(expr.limit(0), mi_path=path).collect()}
    for mode in ("CLR", "ARACNE"):
        assert commands.mi(expr, mode, bins=4, mi_path=path).count() == 10
    assert commands.infer(expr, "genie3", targets=[0], models=3).count() == 4
    with pytest.raises(ValueError, match="mode"):
        commands.mi(expr, "none", mi_path=path)
