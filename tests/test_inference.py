from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdnet.operators import association, centrality, ensembles, perturbations, tiles

#: The published sample of ten rows of five genes.
SAMPLE = np.array([
    [0.4254475, 0.0178292, 0.9079888, 0.4482474, 0.1723238], [0.4424002, 0.0505248, 0.8693676, 0.4458513, 0.1733112], [1.0568470, 0.2084539, 0.4674478, 0.5050774, 0.2448833],
    [1.1172264, 0.0030010, 0.3176543, 0.3872039, 0.2537921], [0.9710677, 0.0010565, 0.3546514, 0.4745322, 0.2077183], [1.1393856, 0.1220468, 0.4024654, 0.3484362, 0.1686139],
    [1.0648694, 0.1405077, 0.4817628, 0.4748571, 0.1826433], [0.8761173, 0.0738140, 1.0582917, 0.7303661, 0.0536562], [1.2059661, 0.1534070, 0.7608608, 0.6558457, 0.1577311],
    [1.0006755, 0.0789863, 0.8036309, 0.8389751, 0.0883061],
])


def table(spark, x):
    return spark.createDataFrame([(s, g, float(x[s, g])) for s in range(x.shape[0]) for g in range(x.shape[1])], "sample int, gene int, value double")


def matrix_of(df, n):
    out = np.full((n, n), np.nan)
    for r in df.collect():
        assert r["i"] > r["j"]
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["score"]
    return out


def same(a, b):
    low = np.tril_indices(len(a), -1)
    return np.allclose(a[low], b[low], atol=1e-9)


@pytest.mark.parametrize("tile", [2, 100])
def test_tiles_hold_every_pair_once(spark, tile, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", tile)
    expr = table(spark, SAMPLE)
    v = association.vectors(expr)
    got = tiles.all_pairs(v, tiles.dot, tile=tile)
    assert got.count() == 10 and same(matrix_of(got, 5), SAMPLE.T @ SAMPLE)
    far = tiles.all_pairs(v, lambda a, b: a[:, :1] - b[:, 0], ordered=True, tile=tile)
    assert same(np.tril(matrix_of(far, 5)), np.tril(SAMPLE[0][:, None] - SAMPLE[0]))


def test_correlations_of_the_published_sample(spark):
    expr = association.validated(table(spark, SAMPLE), genes=5)
    assert same(matrix_of(association.pearson(expr), 5), np.corrcoef(SAMPLE.T))
    ranks = SAMPLE.argsort(axis=0).argsort(axis=0)
    assert same(matrix_of(association.spearman(expr), 5), np.corrcoef(ranks.T))
    with pytest.raises(ValueError, match="variance"):
        association.validated(expr.withColumn("value", F.when(F.col("gene") == 1, 3.0).otherwise(F.col("value"))))
    with pytest.raises(ValueError, match="finite"):
        association.validated(expr.withColumn("value", F.when(F.col("sample") == 1, float("nan")).otherwise(F.col("value"))))
    with pytest.raises(ValueError, match="genes"):
        association.validated(expr, genes=6)


def test_partial_correlations(spark):
    z = (SAMPLE - SAMPLE.mean(axis=0)) / SAMPLE.std(axis=0, ddof=1)
    n = len(z)
    r = np.corrcoef(SAMPLE.T)
    products = z[:, :, None] * z[:, None, :]
    variance = n / (n - 1) ** 3 * ((products - products.mean(axis=0)) ** 2).sum(axis=0)
    off = ~np.eye(5, dtype=bool)
    lam = min(1.0, max(0.0, variance[off].sum() / (r[off] ** 2).sum()))
    assert abs(association.shrinkage(z) - lam) < 0.03  # the estimate is made with weights of 1 / n
    lam = association.shrinkage(z)
    inverse = np.linalg.inv((1 - lam) * r + lam * np.eye(5))
    want = -inverse / np.sqrt(np.diag(inverse))[:, None] / np.sqrt(np.diag(inverse))
    assert same(matrix_of(association.partial_correlation(table(spark, SAMPLE)), 5), want)
    wide = np.random.default_rng(1).normal(size=(6, 9))
    z = (wide - wide.mean(axis=0)) / wide.std(axis=0, ddof=1)
    lam = association.shrinkage(z)
    inverse = np.linalg.inv((1 - lam) * np.corrcoef(wide.T) + lam * np.eye(9))
    assert np.allclose(association.partial_matrix(z)[0, 1], -inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1]))


def test_spline_information(spark):
    for bins, order in ((3, 3), (7, 3), (4, 2), (5, 1)):
        w = association.spline_weights(SAMPLE[:, 0], bins, order)
        assert w.shape == (bins, 10) and np.allclose(w.sum(axis=0), 1) and (w >= 0).all()
    bins = 4
    w = [association.spline_weights(SAMPLE[:, g], bins) for g in range(5)]
    h = lambda p: -sum(v * np.log2(v) for v in np.ravel(p) if v > 0)
    want = np.zeros((5, 5))
    for a, b in combinations(range(5), 2):
        joint = sum(np.outer(w[a][:, s], w[b][:, s]) for s in range(10)) / 10
        want[a, b] = want[b, a] = h(w[a].mean(axis=1)) + h(w[b].mean(axis=1)) - h(joint)
    assert same(matrix_of(association.spline_mi(table(spark, SAMPLE), bins), 5), want)
    counts = [association.bin_count(SAMPLE[:, g]) for g in range(5)]
    assert association.usual_bins(table(spark, SAMPLE)) == int(np.median(counts))
    assert association.percentile(np.arange(1.0, 11.0), 50) == 5.5 and association.percentile(np.arange(1.0, 11.0), 1) == 1.0


def test_spline_information_reads_samples_in_parts(spark, monkeypatch):
    """The same in small parts; blocks of long vectors are small, and no weights are sent between tasks."""
    expr = table(spark, planted(60, 6))
    whole = matrix_of(association.spline_mi(expr, 5), 6)
    monkeypatch.setattr(association, "WEIGHTS", 50)
    monkeypatch.setattr(tiles, "CELLS", 120)
    got = association.spline_mi(expr, 5)
    assert same(matrix_of(got, 6), whole) and "mapInArrow" not in got._jdf.queryExecution().toString()


def test_topological_overlap_and_weakest_links(spark):
    r = np.corrcoef(SAMPLE.T)
    cor = association.pearson(table(spark, SAMPLE))
    a = ((1 + r) / 2) ** 4
    np.fill_diagonal(a, 0)
    k = a.sum(axis=0)
    want = (a @ a + a) / (np.minimum(k[:, None], k) + 1 - a)
    assert same(matrix_of(association.tom(cor, 4, "signed"), 5), want)
    assert association.fitting_power(cor, "signed") in range(2, 31, 2)
    mi = cor.withColumn("score", F.abs("score"))
    m = np.abs(r)
    low = [[any(m[a, b] < m[a, c] and m[a, b] < m[b, c] for c in range(5) if c not in (a, b)) for b in range(5)] for a in range(5)]
    assert same(matrix_of(association.dpi(mi), 5), np.where(low, 0, m))


def planted(n=120, genes=8, seed=3):
    """Gene 1 follows gene 0, gene 3 follows genes 2 and 4; the others are noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, genes))
    x[:, 1] = 2 * x[:, 0] + 0.3 * x[:, 1]
    x[:, 3] = x[:, 2] - 1.5 * x[:, 4] + 0.3 * x[:, 3]
    return x


KERNELS = {
    "genie3": {"models": 30}, "elnet": {"models": 20, "regulators": (4, 7)}, "tigress": {"models": 10}, "plsnet": {"models": 60, "components": 2, "regulators": 6}, "llr": {"models": 30, "regulators": (4, 7)},
    "svm": {"models": 8, "regulators": (4, 7), "samples": (40, 50)}, "narromi": {},
}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_ensembles_find_a_planted_network(spark, name):
    kernel = ensembles.KERNELS[name](**KERNELS[name])
    expr = table(spark, planted())
    got = ensembles.regress(expr, kernel, targets=[1, 3, 7], seed=5).collect()
    score = {(r["source"], r["target"]): abs(r["score"]) for r in got}
    assert len(score) == 21
    assert max((s for s in range(8) if s != 1), key=lambda s: score[s, 1]) == 0
    assert max((s for s in range(8) if s != 3), key=lambda s: score[s, 3]) in (2, 4)
    again = ensembles.regress(expr.repartition(3), kernel, targets=[3], seed=5).collect()
    assert {(r["source"], r["target"]): abs(r["score"]) for r in again} == {k: v for k, v in score.items() if k[1] == 3}


def test_kernels_of_support_vectors_and_bounds(spark):
    x = planted(60)
    for kernel in ("linear", "poly", "rbf", "sigmoid"):
        for kind in ("epsilon", "nu"):
            w = ensembles.svm(models=2, kernel=kernel, kind=kind, samples=(20, 30))(x[:, 1:], x[:, 0], np.random.default_rng(1))
            assert w.shape == (7,) and (0 <= w).all() and (w <= 1).all()
    with pytest.raises(ValueError, match="kernel"):
        ensembles.svm(models=1, kernel="none")(x[:, 1:], x[:, 0], np.random.default_rng(1))
    assert ensembles.votes(np.array([0.0, -3.0, 1.0])).tolist() == [0, 1, 0]
    sig = ensembles.significance(np.array([0.0, 0.2, 0.5, 1.0, 0.1]))
    assert sig[3] == sig[2] == sig.min() and sig[0] == sig.max() and (0 < sig).all() and (sig < 1).all()
    beta = ensembles.least_deviations(x[:, [0, 2]], 2 * x[:, 0])
    assert abs(beta[0] - 2) < 1e-3 and abs(beta[1]) < 1e-3
    lam, slopes, c = ensembles.lasso_path(x[:, 1:], x[:, 0], 5, 0.01)
    assert np.allclose(slopes[0], 0, atol=1e-9) and (np.diff(lam) < 0).all() and np.abs(x[:, 1:] @ slopes[-1] + c[-1] - x[:, 0]).mean() < 0.3


def test_models_read_samples_in_blocks(monkeypatch):
    """The same weights whatever the blocks, and no copy of all rows and columns."""
    x = planted(90)
    kernels = {"genie3": {"models": 5}, "elnet": {"models": 3}, "tigress": {"models": 3}, "llr": {"models": 5}, "svm": {"models": 3}}
    weigh = lambda: {k: ensembles.KERNELS[k](**o)(x[:, 1:], x[:, 0], np.random.default_rng(3)) for k, o in kernels.items()}
    whole = weigh()
    monkeypatch.setattr(ensembles, "BLOCK", 7)
    monkeypatch.setattr(ensembles, "AT_ONCE", 10)
    monkeypatch.setattr(ensembles.Part, "take", lambda self: pytest.fail("all samples are copied"))
    assert all(np.allclose(v, whole[k], atol=1e-9) for k, v in weigh().items())


def test_the_support_vector_query_has_all_its_models(spark, monkeypatch):
    from crowdnet.plans import workloads

    asked = []
    monkeypatch.setitem(ensembles.KERNELS, "svm", lambda models=1000, **_: asked.append(models) or (lambda x, y, rng: np.zeros(x.shape[1])))
    workloads.QUERIES["infer_svm"](spark, "/root/testdata/sf0.001")
    assert asked == [1000]


def test_linear_support_vectors_without_a_matrix_of_samples():
    for seed in range(4):
        x = planted(80, seed=seed)
        z, y = x[:, 1:] / x[:, 1:].std(axis=0), x[:, 0] / x[:, 0].std()
        want = ensembles.svr_coefficients(z @ z.T, y, 1.0, 0.1, rounds=20_000, tolerance=1e-9) @ z
        assert np.allclose(ensembles.linear_epsilon_svr(z, y), want, atol=2e-3)


def test_fold_changes_of_experiments(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9, 4))
    # experiment 1: two controls, two of treatment a, and a at a later time; experiment 2: a control and a double treatment
    meta = [(0, 1, [], None, 1), (1, 1, [], None, 2), (2, 1, ["a"], 0.0, 1), (3, 1, ["a"], 0.0, 2), (4, 1, ["a"], 5.0, 1), (5, 2, [], 0.0, 1), (6, 2, ["a", "b"], 0.0, 1), (7, 2, ["a"], 0.0, 1), (8, 3, ["c"], 0.0, 1)]
    changed = {6: [1]}
    chips = spark.createDataFrame([(*m, changed.get(m[0], [])) for m in meta], "sample int, experiment int, perturbations array<string>, time double, repeat int, changed array<int>")
    got = matrix_of(perturbations.anoverence(table(spark, x), chips, weight=2.5), 4)
    tests = [([2, 3], [0, 1], []), ([4], [0, 1], []), ([4], [2, 3], []), ([6], [5], [1]), ([6], [7], [1]), ([7], [5], [])]
    for i in range(4):
        for j in range(i):
            n = total = between = squares = 0.0
            for chips_, base, heavy in tests:
                w = s = 0.0
                for g, second in ((i, False), (j, True)):
                    for k in chips_:
                        f, p = x[k, g] - x[base, g].mean(), 2.5 if second and g in heavy else 1.0
                        w, s, squares = w + p, s + p * f, squares + p * f * f
                n, total, between = n + w, total + s, between + s * s / w
            assert abs(got[i, j] - (between - total**2 / n) / (squares - total**2 / n)) < 1e-9
    means = perturbations.replicates(table(spark, x), spark.createDataFrame([(0, "c"), (1, "c"), (2, "t")], "sample int, condition string"))
    assert abs(means.filter("condition = 'c' AND gene = 2").first()["value"] - x[:2, 2].mean()) < 1e-12


def test_fold_changes_of_many_experiments(spark, monkeypatch):
    """More chips than one table on the driver held, dealt by experiment and by blocks of genes."""
    monkeypatch.setattr(perturbations, "CHIPS", 3_000)
    monkeypatch.setattr(perturbations, "GENES", 2)
    n = 20_010
    value = lambda s, g: ((s * 7 + g * s * s) % 11).cast("double")
    samples = spark.range(n).select(F.col("id").alias("sample"))
    expr = samples.select("sample", F.explode(F.array(*[F.lit(g) for g in range(4)])).alias("gene")).withColumn("value", value(F.col("sample"), F.col("gene")))
    s = F.col("sample")
    chips = samples.select("sample", F.floor(s / 3).alias("experiment"), F.when(s % 3 < 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("perturbations"), F.lit(0.0).alias("time"), F.when(s % 3 == 1, 2).otherwise(1).alias("repeat"), F.array().cast("array<int>").alias("changed"))
    got = matrix_of(perturbations.anoverence(expr, chips), 4)
    k = np.arange(n)
    x = np.stack([(k * 7 + g * k * k) % 11 for g in range(4)]).reshape(4, -1, 3).astype(float)
    f = x[:, :, 2] - x[:, :, :2].mean(axis=2)
    for i in range(4):
        for j in range(i):
            both = f[[i, j]]
            base = both.sum() ** 2 / both.size
            assert abs(got[i, j] - ((both.sum(axis=0) ** 2 / 2).sum() - base) / ((both**2).sum() - base)) < 1e-9
    means = perturbations.replicates(expr, samples.select("sample", F.lit("c").alias("condition")))
    assert abs(means.filter("gene = 1").first()["value"] - x[1].mean()) < 1e-9


def test_differential_networks(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(60, 5)), rng.normal(size=(60, 5))
    b[:, 1] = b[:, 0]
    ways = spark.createDataFrame([("p", g) for g in (0, 1, 2)] + [("q", g) for g in (2, 3, 4, 99)] + [("alone", 4)], "pathway string, gene int")
    got = {(r["pathway"], r["gene"]): r for r in perturbations.differential(table(spark, a), table(spark, b), ways, permutations=40, seed=2).collect()}
    assert got.keys() == {("p", None), *[("p", g) for g in (0, 1, 2)], ("q", None), *[("q", g) for g in (2, 3, 4)]}
    want, each = perturbations.distance(np.corrcoef(a[:, :3].T), np.corrcoef(b[:, :3].T), 2.0)
    assert abs(got["p", None]["distance"] - want) < 1e-9 and abs(got["p", 1]["distance"] - each[1]) < 1e-9
    assert got["p", None]["p_value"] <= 0.05 and got["q", None]["p_value"] > 0.05
    x, y = (spark.createDataFrame([(1, 0, s), (2, 1, 1.0)], "i int, j int, score double") for s in (3.0, 1.0))
    assert abs(perturbations.network_distance(x, y).first()["distance"] - (2 * 4 / 3) ** 0.5) < 1e-12
    assert perturbations.rank_sum_p(1.0, np.array([2.0, 3.0, 4.0])) == 0.25


def paths_of(edges, n):
    """All shortest paths of every pair, by trying simple paths."""
    near = {v: {} for v in range(n)}
    for i, j, w in edges:
        near[i][j] = near[j][i] = 1 / w

    def walk(path, length, goal):
        if path[-1] == goal:
            yield length, tuple(path)
            return
        for v, d in near[path[-1]].items():
            if v not in path:
                yield from walk([*path, v], length + d, goal)

    for a, b in combinations(range(n), 2):
        found = list(walk([a], 0.0, b))
        if found:
            best = min(length for length, _ in found)
            yield [p for length, p in found if length <= best * (1 + 1e-9)]


def test_betweenness_matches_all_paths(spark):
    edges = [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (3, 2, 1.0), (4, 3, 2.0), (4, 2, 0.5), (6, 5, 1.0), (3, 0, 0.4)]
    nodes, links = centrality.betweenness(spark.createDataFrame(edges, "i int, j int, score double"))
    want_node, want_edge = dict.fromkeys(range(7), 0.0), {(i, j): 0.0 for i, j, _ in edges}
    for paths in paths_of(edges, 7):
        for p in paths:
            for v in p[1:-1]:
                want_node[v] += 1 / len(paths)
            for a, b in zip(p, p[1:], strict=False):
                want_edge[max(a, b), min(a, b)] += 1 / len(paths)
    assert {r["node"]: round(r["betweenness"], 9) for r in nodes.collect()} == {k: round(v, 9) for k, v in want_node.items()}
    assert {(r["i"], r["j"]): round(r["betweenness"], 9) for r in links.collect()} == {k: round(v, 9) for k, v in want_edge.items()}


@pytest.mark.parametrize("bounds", [{}, {"STEPS": 5}, {"COMPONENT_EDGES": 4}])
def test_distances_are_summed_by_component(spark, bounds, monkeypatch):
    from crowdnet.operators.components import components

    for name, value in bounds.items():
        monkeypatch.setattr(centrality, name, value)
    edges = [(1, 0, 1.0), (2, 0, 1.5), (3, 1, 1.0), (3, 2, 0.0), (4, 3, 2.0), (4, 2, 0.5), (6, 5, 1.0), (3, 0, 0.4), (7, 4, 3.0), (9, 8, 2.0), (10, 9, 0.25), (10, 8, 9.0)]
    net = spark.createDataFrame(edges, "i int, j int, score double")
    d = np.full((11, 11), np.inf)
    np.fill_diagonal(d, 0)
    for i, j, w in edges:
        d[i, j] = d[j, i] = w
    for k in range(11):
        d = np.minimum(d, d[:, k, None] + d[k])
    got = centrality.distance_summary(net, components(net, a="i", b="j")).first()
    there = d[np.isfinite(d)]
    assert got["pairs"] == len(there) and abs(got["total"] - there.sum()) < 1e-9 and got["largest"] == there.max()


def test_spanning_edges_match_all_trees(spark):
    edges = [(1, 0, 2.0), (2, 0, 1.0), (2, 1, 1.0), (3, 2, 4.0), (3, 1, 0.5), (5, 4, 3.0)]

    def trees():
        for own in combinations(edges[:5], 3):
            part = list(range(4))
            for i, j, _ in own:
                part = [part[j] if p == part[i] else p for p in part]
            if len(set(part)) == 1:
                yield own

    weight = {t: np.prod([w for _, _, w in t]) for t in trees()}
    got = {(r["i"], r["j"]): r["spanning"] for r in centrality.spanning_edges(spark.createDataFrame(edges, "i int, j int, score double")).collect()}
    for i, j, w in edges[:5]:
        assert abs(got[i, j] - sum(v for t, v in weight.items() if (i, j, w) in t) / sum(weight.values())) < 1e-9
    assert abs(got[5, 4] - 1) < 1e-9
    near = {(r["i"], r["j"]): r["spanning"] for r in centrality.approximate_spanning_edges(spark.createDataFrame(edges, "i int, j int, score double"), 2000, seed=4).collect()}
    assert near.keys() == got.keys() and all(abs(near[k] - v) < 5 * (v * (1 - v) / 2000) ** 0.5 + 1e-9 for k, v in got.items())


def test_rounds_end_when_nothing_moves(spark):
    from crowdnet.operators import networks

    d = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 3.0), (3, 2, 1.0)], "i int, j int, score double")
    a = np.zeros((4, 4))
    for i, j, w in d.collect():
        a[i, j] = a[j, i] = w
    values = lambda df, c: np.array([r[c] for r in df.orderBy("node").collect()])
    vec = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert np.allclose(values(centrality.eigenvector(d, 200, tolerance=1e-6), "eigenvector"), vec, atol=1e-4)
    assert np.allclose(values(centrality.katz(d, 200, 0.05, tolerance=1e-8), "katz"), np.linalg.solve(np.eye(4) - 0.05 * a, np.ones(4)), atol=1e-6)
    p = np.linalg.solve(np.eye(4) - 0.85 * (a / a.sum(axis=0)), np.full(4, 0.15 / 4))
    assert np.allclose(values(networks.pagerank(d, 100, tolerance=1e-5), "pagerank"), p, atol=1e-4)
    close = {r["node"]: r["closeness"] for r in centrality.approximate_closeness(d, share=1.0).collect()}
    exact = {r["node"]: r["closeness"] for r in centrality.closeness(centrality.distances(d)).collect()}
    assert all(abs(close[k] - exact[k]) < 1e-9 for k in exact)
