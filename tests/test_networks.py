import random

import pytest
from pyspark.sql import functions as F

from crowdnet.functions import filters
from crowdnet.operators import association, components, consensus, networks, query, ranking


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def brute_midrank(values):
    order = sorted(values)
    return [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_midrank_matches_brute_force(spark, partitions):
    rng = random.Random(partitions)
    values = [float(rng.randrange(20)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, w double").repartition(3)
    got = {r["id"]: r["rank"] for r in ranking.midrank(df, "w", partitions=partitions).collect()}
    assert [got[i] for i in range(200)] == brute_midrank(values)
    assert sum(got.values()) == 200 * 201 / 2


def test_midrank_by_group_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", None)], "alg string, w double")
    assert rows(ranking.midrank(df, "w", ["alg"], ascending=False).filter("w IS NOT NULL"), "alg", "rank") == [("a", 1.0), ("a", 2.0), ("b", 1.5), ("b", 1.5)]


def test_import_of_a_lower_triangle(spark):
    cells = [(i, j) for i in range(5) for j in range(i)]
    raw = spark.createDataFrame([(i, j, float(k)) for k, (i, j) in enumerate(cells)], "a int, b int, w double")
    got = rows(ranking.import_edges(raw), "i", "j", "direction", "score", "rank")
    assert got == [(i, j, 1, float(k), k + 1.0) for k, (i, j) in enumerate(cells)]


def test_import_keeps_the_better_direction_and_drops_loops(spark):
    raw = spark.createDataFrame([(1, 2, 5.0), (2, 1, 7.0), (3, 1, 4.0), (1, 3, 4.0), (2, 2, 9.0), (3, 2, 0.0)], "a int, b int, w double")
    got = rows(ranking.import_edges(raw, reverse=True, drop_zero=True), "i", "j", "direction", "score", "rank")
    assert got == [(2, 1, 1, 7.0, 1.0), (3, 1, 0, 4.0, 2.0)]


def test_empty_network(spark):
    raw = spark.createDataFrame([], "a int, b int, w double")
    assert ranking.import_edges(raw).count() == 0
    assert components.components(raw).count() == 0


def test_aggregation_ignores_the_order_of_rows(spark):
    rng = random.Random(3)
    edges = [(alg, i, j, 1, float(rng.randrange(1, 12))) for alg in "xyz" for i in range(6) for j in range(i) if rng.random() < 0.8]
    df = spark.createDataFrame(edges, "alg string, i int, j int, direction int, rank double")
    for method in consensus.AGGREGATORS:
        a = consensus.aggregate(df, method, 3, 6)
        b = consensus.aggregate(df.orderBy(F.rand(1)).repartition(5), method, 3, 6)
        assert rows(a, "i", "j", "value", "rank") == rows(b, "i", "j", "value", "rank")


def test_top_two_is_the_mean_of_the_two_best(spark):
    df = spark.createDataFrame([("x", 1, 0, 1, 9.0), ("y", 1, 0, 1, 2.0), ("z", 1, 0, 1, 4.0), ("x", 2, 0, 1, 1.0)], "alg string, i int, j int, direction int, rank double")
    assert rows(consensus.aggregate(df, "top2", 3, 3), "i", "j", "value") == [(1, 0, 3.0)]


def test_filter_language(spark):
    df = spark.createDataFrame([(1, 0.5, 3.0), (2, 0.9, 50.0), (3, 0.5000000001, 7.0)], "id int, s double, r double")
    pick = lambda text, **kw: [x[0] for x in rows(df.filter(filters.parse(text, [F.col("s")], [F.col("r")], **kw)), "id")]
    assert pick("s0 > 0.4 & r0 < 10") == [1, 3]
    assert pick("s0 = 0.5") == [1, 3]
    assert pick("r0 - 3 > 0 | s0 < 0.1") == [2, 3]
    assert pick("(r0 + 1) * 2 > 100") == [2]
    assert pick("r0 - 10 > 0", compat=True) == [1, 3]
    for bad in ("s0 >", "(s0 > 1", "s0 ? 1", "s0 1"):
        with pytest.raises(ValueError):
            filters.parse(bad, [F.col("s")], [F.col("r")])


def test_compare_of_translated_networks(spark):
    """Eight pairs: seven in both networks under translated names, one in the second only."""
    a = [("A2", "A1", 7.0), ("A3", "A1", 5.0), ("A3", "A2", 2.0), ("A4", "A1", 1.0), ("A4", "A2", 4.0), ("A5", "A1", 3.0), ("A5", "A2", 6.0)]
    b = [("B2", "B1", 8.0), ("B3", "B1", 6.0), ("B3", "B2", 3.0), ("B4", "B1", 1.0), ("B4", "B2", 5.0), ("B5", "B1", 4.0), ("B5", "B2", 7.0), ("B7", "B6", 2.0)]
    x, y = (spark.createDataFrame(n, "i string, j string, rank double") for n in (a, b))
    names = spark.createDataFrame([(f"B{k}", f"A{k}") for k in range(1, 6)], "old string, new string")
    got = {(r["i"], r["j"]): (round(r["score"], 6), r["rank"], r["flag"]) for r in networks.compare(x, networks.translate(y, names)).collect()}
    assert got[("A2", "A1")] == (0.0, 15.0, 0) and got[("A3", "A1")] == (0.307692, 11.0, 0) and got[("B7", "B6")] == (1.0, 2.0, 2)
    assert len(got) == 8
    assert {r["flag"] for r in networks.compare(x, x).collect()} == {0}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    for n, m in ((30, 12), (60, 70), (40, 39)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 39 else [(k, k + 1) for k in range(39)]
        parent = {v: v for e in edges for v in e}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = rows(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
        assert got == sorted((v, find(v)) for v in parent)


def test_kendall_of_a_network_with_itself(spark):
    net = spark.createDataFrame([(2, 1, 0.5), (3, 1, 0.7), (3, 2, 0.1), (4, 1, 0.9)], "i int, j int, score double")
    assert {r["tau"] for r in networks.kendall(net, net).collect() if r["tau"] is not None} == {1.0}


def test_samples_are_exact(spark):
    net = spark.createDataFrame([(i, j, 1.0) for i in range(20) for j in range(i)], "i int, j int, score double")
    assert len(set(rows(query.sample(net, 17), "i", "j"))) == 17
    assert query.sample(net, 1000).count() == 190
    assert query.sample(net, 300, replacement=True).count() == 300


def test_correlation_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 5))
    expr = spark.createDataFrame([(s, g, float(m[s, g])) for s in range(12) for g in range(5)], "sample int, gene int, value double")
    want = np.corrcoef(m.T)
    for r in association.pearson(expr).collect():
        assert abs(r["score"] - want[r["i"], r["j"]]) < 1e-9
    for kind in ("unsigned", "signed", "hybrid"):
        assert all(-1e-9 <= r["score"] <= 1 + 1e-9 for r in association.tom(association.pearson(expr), 2, kind).collect())


def test_strong_components_match_reachability(spark):
    rng = random.Random(31)
    for n, m in ((8, 10), (20, 30), (30, 25)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        reach = {v: {v} for e in edges for v in e}
        for _ in range(n):
            for a, b in edges:
                reach[a] |= reach[b]
        for _ in range(n):
            for a, b in edges:
                reach[a] |= reach[b]
        want = {v: min(u for u in own if v in reach[u]) for v, own in reach.items()}
        got = {r["node"]: r["component"] for r in components.strong_components(spark.createDataFrame(edges, "source int, target int")).collect()}
        assert got == want
    assert components.strong_components(spark.createDataFrame([], "source int, target int")).count() == 0


def test_pairs_are_dealt_in_bounded_parts(spark, tmp_path, monkeypatch):
    """No task gets much more than ROWS rows, and the pairs are written once for all that read them."""
    from crowdnet import scratch
    from crowdnet.plans import datasets

    rng = random.Random(4)
    lines = [(o, s, k) for o in range(400) for k, s in enumerate(rng.choices(range(30), k=rng.randrange(1, 6)))]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(scratch, "ROWS", 100)
    net = datasets.shipped_together(spark, str(tmp_path))
    want = {}
    for o in range(400):
        own = sorted({s for x, s, _ in lines if x == o})
        for a, i in enumerate(own):
            for j in own[:a]:
                want[i, j] = want.get((i, j), 0) + 1
    assert {(r["i"], r["j"]): r["score"] for r in net.collect()} == want
    assert len(net.inputFiles()) > 2 * len(lines) // 200 and "Exchange" not in net._jdf.queryExecution().toString()


def test_the_backbone_is_filtered_after_its_scores(spark):
    net = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 9.0), (3, 1, 2.0)], "i int, j int, score double")
    scored = {(r["i"], r["j"]) for r in networks.backbone(net).collect() if r["nc_score"] - r["nc_sdev"] * 0.1 > 0}
    kept = networks.backbone(net, 0.1)
    assert {(r["i"], r["j"]) for r in kept.collect()} == scored and scored
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and len(line) > 400]
