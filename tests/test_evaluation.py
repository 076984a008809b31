import math
import random
from itertools import combinations

import numpy as np
import pytest

from crowdnet.operators import clusters, networks, query, ranking, thresholds


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def random_net(rng, n, share):
    return [(j, i, float(rng.randrange(1, 12)), float(k + 1)) for k, (i, j) in enumerate(combinations(range(n), 2)) if rng.random() < share]


NET = "i int, j int, score double, rank double"


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    values = [(rng.randrange(8), k, rng.randrange(5)) for k in range(200)]
    d = spark.createDataFrame(values, "a int, b int, v int").repartition(3)
    got = {r["b"]: (r["place"], r["s"], r["m"]) for r in ranking.running(d, ["a", "b"], {"s": "v"}, {"m": "v"}, "place").collect()}
    seen, s, m = 0, 0, 99
    for a, b, v in sorted(values):
        seen, s, m = seen + 1, s + v, min(m, v)
        assert got[b] == (seen, s, m)


def test_tau_matches_all_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 3, 30, 65):
        for levels in (2, 5, 1000):
            x, y = rng.integers(0, levels, n).astype(float), rng.integers(0, levels, n).astype(float)
            sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            nx, ny = (np.abs(v).sum() for v in (sx, sy))
            want = (sx * sy).sum() / math.sqrt(nx * ny) if nx and ny else None
            got = networks.tau_b(x, y)
            assert got is None if want is None else abs(got - want) < 1e-12


def brute_measures(edges):
    nodes = {v for e in edges for v in e[:2]}
    near = {v: set() for v in nodes}
    for i, j, *_ in edges:
        near[i].add(j)
        near[j].add(i)
    degree = [len(x) for x in near.values()]
    triangles = sum(1 for a, b, c in combinations(sorted(nodes), 3) if b in near[a] and c in near[a] and c in near[b])
    triples = sum(k * (k - 1) // 2 for k in degree)
    counts = {k: degree.count(k) for k in degree}
    x, y = [math.log10(k + 1) for k in counts], [math.log10(c + 1) for c in counts.values()]
    r2 = float(np.corrcoef(x, y)[0, 1] ** 2) if len(set(x)) > 1 and len(set(y)) > 1 else None
    return len(nodes), len(edges), r2, 3 * triangles / triples if triples else None


@pytest.mark.parametrize("by_rank", [False, True])
def test_sweep_matches_brute_force(spark, by_rank):
    rng = random.Random(3)
    net = random_net(rng, 14, 0.6)
    lo, hi = (0.0, 40.0) if by_rank else (1.0, 11.0)
    got = thresholds.sweep(spark.createDataFrame(net, NET), lo, hi, 5, by_rank).orderBy("step").collect()
    for k, r in enumerate(got):
        cut = hi - k * (hi - lo) / 5 if by_rank else lo + k * (hi - lo) / 5
        n, e, r2, t = brute_measures([x for x in net if (x[3] < cut if by_rank else x[2] > cut)])
        assert abs(r["cut"] - cut) < 1e-9 and (r["nodes"], r["edges"]) == (n, e)
        for a, b in ((r["r2"], r2), (r["transitivity"], t)):
            assert a is None and b is None or abs(a - b) < 1e-9
    best = thresholds.suggested(spark.createDataFrame(got, "step int, cut double, nodes long, edges long, r2 double, transitivity double")).collect()
    assert sum(r["suggested"] for r in best) == 1
    total = lambda r: r["nodes_rank"] + r["r2_rank"] + r["transitivity_rank"]
    assert total(next(r for r in best if r["suggested"])) == min(map(total, best))


def test_report_of_a_network_with_lonely_nodes(spark):
    net = spark.createDataFrame([(2, 1, 1.0), (3, 1, 2.0), (3, 2, 5.0), (4, 3, 1.0), (6, 5, 2.0)], "i int, j int, score double")
    got = {r["metric"]: r["value"] for r in thresholds.graph_report(net, spark.range(1, 8).withColumnRenamed("id", "node")).collect()}
    assert (got["nodes"], got["edges"], got["components"]) == (7, 5, 3)
    assert got["clustering_coefficient"] == 3 / 5 and got["average_degree"] == 10 / 7 and got["average_weighted_degree"] == 22 / 7
    far = {(1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 3): 3, (2, 4): 4, (3, 4): 1, (5, 6): 2}
    assert got["diameter"] == 4 and abs(got["average_path_length"] - 2 * sum(far.values()) / (2 * len(far) + 7)) < 1e-12


def test_curves_and_areas(spark):
    rng = random.Random(5)
    edges = [(k + 1, 0, rng.random(), rng.choice([True, False, None])) for k in range(60)]
    d = spark.createDataFrame(edges, "i int, j int, score double, truth boolean")
    got = networks.roc(d).orderBy("place").collect()
    order = sorted(edges, key=lambda e: -e[2])
    pos, neg = sum(e[3] is True for e in edges), sum(e[3] is False for e in edges)
    tp = fp = 0
    curve = []
    for k, e in enumerate(order, 1):
        tp, fp = tp + (e[3] is True), fp + (e[3] is False)
        curve.append((tp / pos, fp / neg, tp / k))
        assert (got[k - 1]["tp"], got[k - 1]["fp"]) == (tp, fp)
    auc = sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(curve, curve[1:], strict=False))
    aupr = sum((b[0] - a[0]) * (a[2] + b[2]) / 2 for a, b in zip(curve, curve[1:], strict=False))
    r = networks.areas(d).first()
    assert abs(r["auc"] - auc) < 1e-12 and abs(r["aupr"] - aupr) < 1e-12
    tfs = spark.createDataFrame([(3,), (4,)], "node int")
    assert networks.roc(d, tfs=tfs).count() == 2 and networks.roc(d, most=10).count() == 10 and networks.roc(d, points=6).count() == 6


def test_enrichment_matches_sums_of_combinations(spark):
    rng = random.Random(6)
    first = [(f"a:{rng.randrange(3)}", m) for m in range(60)]
    second = [(f"r:{rng.randrange(2)}:{rng.randrange(3)}", m) for m in range(60) if rng.random() < 0.8]
    got = {(r["first"], r["second"]): r for r in clusters.enrichment(*[spark.createDataFrame(x, "path string, member int") for x in (first, second)], alpha=None, least=5, most=30).collect()}

    def sets(mapping):
        own = {}
        for path, m in mapping:
            parts = path.split(":")
            for k in range(len(parts)):
                own.setdefault(":".join(parts[: k + 1]), set()).add(m)
        return {k: v for k, v in own.items() if 5 <= len(v) <= 30}

    x, y = sets(first), sets(second)
    tests = {}
    for a, mine in x.items():
        for b, theirs in y.items():
            top = b
            while ":" in top and top.rsplit(":", 1)[0] in y:
                top = top.rsplit(":", 1)[0]
            pop = y[top]
            nt, npat, mt, mpat = len(mine & theirs), len(mine & pop), len(theirs), len(pop)
            tests[a, b] = sum(math.comb(mt, k) * math.comb(mpat - mt, npat - k) for k in range(nt, min(mt, npat) + 1)) / math.comb(mpat, npat)
    n = len(tests)
    order = sorted(tests.values())
    assert got.keys() == {k for k, p in tests.items() if x[k[0]] & y[k[1]]}
    for k, r in got.items():
        assert abs(r["p"] - tests[k]) < 1e-9
        assert abs(r["p_adj"] - min(1.0, min(n / i * p for i, p in enumerate(order, 1) if p >= tests[k] - 1e-12))) < 1e-9
    only = clusters.listing(clusters.members(spark.createDataFrame(first, "path string, member int"), 5, 30)).collect()
    assert {r["cluster"]: r["members"].split(",") for r in only} == {k: sorted(map(str, v)) for k, v in x.items()}


def test_lookup_by_names(spark):
    names = spark.createDataFrame([(0, "A"), (1, "b"), (2, "C"), (3, "d")], "node int, name string")
    net = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (2, 1, 3.0), (3, 2, 4.0)], "i int, j int, score double")
    assert rows(query.lookup(net, names, ["A", "C:b", "b:C"]), "i", "j") == [(1, 0), (2, 0), (2, 1)]
    assert rows(query.lookup(net, names, ["a", "zz"]), "i", "j") == [] and rows(query.lookup(net, names, ["D:c"], case_insensitive=True), "i", "j") == [(3, 2)]
    with pytest.raises(ValueError, match="zz"):
        query.lookup(net, names, ["A:zz"], strict=True)
    with pytest.raises(ValueError, match="itself"):
        query.lookup(net, names, ["A:A"])


def test_orthologs_fan_out(spark):
    net = spark.createDataFrame([(2, 1, 1.0), (3, 1, 2.0)], "i int, j int, score double")
    words = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "y"), (3, "x")], "old int, new string")
    assert rows(networks.orthologs(net, words), "i", "j", "score") == [("y", "x", 2.0), ("z", "x", 1.0)]
    assert {tuple(r) for r in networks.translate(net.withColumn("i", net.i.cast("string")).withColumn("j", net.j.cast("string")), words.withColumn("old", words.old.cast("string"))).select("i", "j").collect()} == {("y", "x"), ("x", "x")}
