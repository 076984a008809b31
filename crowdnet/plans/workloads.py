"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdnet.functions import filters
from crowdnet.operators import association, centrality, clusters, components, consensus, ensembles, networks, perturbations, query, ranking, thresholds
from crowdnet.plans import datasets as D
from crowdnet.scratch import Scratch
from crowdnet.sources import store, text
from crowdnet.streaming import strength as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


NET = "SELECT i, j, direction, value, rank, round(score, 9) AS score FROM net"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best edges of the consensus of four trade networks, with the nations' names."""
    best = query.top(D.fused(spark, sf), 10)
    names = D.table(spark, sf, "nation")
    a, b = (names.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in "ij")
    return rounded(best.join(a, "i").join(b, "j").select("name_i", "name_j", "direction", "rank", "score"), score=9)


QUERIES["consensus_top10"] = flagship
ORACLES["consensus_top10"] = f"WITH {D.fused_sql()} SELECT x.n_name AS name_i, y.n_name AS name_j, direction, rank, round(score, 9) AS score FROM (SELECT * FROM net ORDER BY score DESC, i, j LIMIT 10) t JOIN nation x ON t.i = x.n_nationkey JOIN nation y ON t.j = y.n_nationkey"


@register("import_el_midrank", f"WITH {D.IMPORT_SQL} SELECT alg, i, j, direction, score, rank FROM imp")
def _(spark, sf):
    return D.imported(spark, sf)


@register("import_ascending_undirected", f"""WITH {D.FLOW_SQL}, c AS (SELECT greatest(a, b) AS i, least(a, b) AS j, min(w) AS score FROM flow WHERE a <> b AND alg = 'avg_disc' GROUP BY 1, 2)
SELECT i, j, 0 AS direction, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM c""")
def _(spark, sf):
    return ranking.import_edges(D.flow(spark, sf).filter("alg = 'avg_disc'"), undirected=True)


_CENTERED = "ff AS (SELECT a, b, cnt - (SELECT median(cnt) FROM f0) AS w FROM f0)"


@register("import_drop_zero_abs", f"""WITH {D.FLOW_SQL}, {_CENTERED},
c AS (SELECT greatest(a, b) AS i, least(a, b) AS j, max(w) FILTER (a > b) AS w1, max(w) FILTER (a < b) AS w2 FROM ff WHERE a <> b AND w <> 0 GROUP BY 1, 2),
d AS (SELECT i, j, CASE WHEN w1 = w2 THEN 0 WHEN w2 IS NULL OR w1 > w2 THEN 1 ELSE 2 END AS direction, CASE WHEN w2 IS NULL OR w1 >= w2 THEN w1 ELSE w2 END AS score FROM c)
SELECT *, rank() OVER (ORDER BY abs(score) DESC) + (count(*) OVER (PARTITION BY abs(score)) - 1) / 2.0 AS rank FROM d""")
def _(spark, sf):
    f = D.flow(spark, sf).filter("alg = 'cnt'")
    middle = f.agg(F.median("w").alias("m"))
    return ranking.import_edges(f.crossJoin(F.broadcast(middle)).select("a", "b", (F.col("w") - F.col("m")).alias("w")), absolute=True, reverse=True, drop_zero=True)


for _method in consensus.AGGREGATORS:
    QUERIES[f"agg_{_method}"] = lambda spark, sf, m=_method: rounded(D.fused(spark, sf, m), score=9)
    ORACLES[f"agg_{_method}"] = f"WITH {D.fused_sql(_method)} {NET}"


@register("agg_best_two", f"WITH {D.IMPORT_SQL} SELECT i, j, list(alg ORDER BY rank, alg)[1] AS t1, list(alg ORDER BY rank, alg)[2] AS t2 FROM imp GROUP BY i, j")
def _(spark, sf):
    return consensus.best_two(D.imported(spark, sf))


@register("agg_direction_vote", f"WITH {D.IMPORT_SQL} SELECT i, j, {D.VOTE_SQL} AS direction FROM imp GROUP BY i, j")
def _(spark, sf):
    return D.imported(spark, sf).groupBy("i", "j").agg(consensus.direction_vote().alias("direction"))


def _net_sql(select: str, method: str = "irp") -> str:
    return f"WITH {D.fused_sql(method)}, {D.EDGES_SQL.format(name='net')} {select}"


@register("view_threshold", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net WHERE score > 0.75"))
def _(spark, sf):
    return rounded(query.threshold(D.fused(spark, sf), 0.75).select("i", "j", "score", "rank"), score=9)


@register("view_threshold_rank", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net WHERE rank < 40"))
def _(spark, sf):
    return rounded(query.threshold(D.fused(spark, sf), 40, by_rank=True).select("i", "j", "score", "rank"), score=9)


_WIDE = "w AS (SELECT i, j, " + ", ".join(f"max(score) FILTER (alg = '{a}') AS s_{a}, max(rank) FILTER (alg = '{a}') AS r_{a}" for a in D.ALGS) + " FROM imp GROUP BY i, j)"
_FILTER = "(s1 > 4 & r1 < 200) | r3 - r2 > 20 & s0 * 2 < 0.11"


@register("view_filter_expr", f"WITH {D.IMPORT_SQL}, {_WIDE} SELECT * FROM w WHERE (s_cnt > 4 AND r_cnt < 200) OR (r_revenue - r_qty > 20 AND s_avg_disc * 2 < 0.11)")
def _(spark, sf):
    w = query.wide(D.imported(spark, sf), D.ALGS)
    return w.filter(filters.parse(_FILTER, [F.col(f"s_{a}") for a in D.ALGS], [F.col(f"r_{a}") for a in D.ALGS]))


@register("view_nodelist", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net WHERE i IN (3, 7) OR j IN (3, 7)"))
def _(spark, sf):
    return rounded(query.incident(D.fused(spark, sf).select("i", "j", "score", "rank"), spark.createDataFrame([(3,), (7,)], "node int")), score=9)


@register("view_pair", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net WHERE i = 7 AND j = 3"))
def _(spark, sf):
    return rounded(D.fused(spark, sf).filter("i = greatest(3, 7) AND j = least(3, 7)").select("i", "j", "score", "rank"), score=9)


@register("view_limit", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net WHERE score > 0.5 ORDER BY i, j LIMIT 20"))
def _(spark, sf):
    return rounded(query.threshold(D.fused(spark, sf), 0.5).orderBy("i", "j").limit(20).select("i", "j", "score", "rank"), score=9)


@register("top_edges", _net_sql("SELECT i, j, round(score, 9) AS score, rank FROM net ORDER BY score DESC, i, j LIMIT 15"))
def _(spark, sf):
    return rounded(query.top(D.fused(spark, sf), 15).select("i", "j", "score", "rank"), score=9)


@register("top_supplier_pairs", f"WITH {D.COSHIP_SQL} SELECT i, j, score FROM co ORDER BY score DESC, i, j LIMIT 25")
def _(spark, sf):
    return query.top(D.shipped_together(spark, sf), 25)


@register("neighbours_topn", _net_sql("SELECT node, other, round(score, 9) AS score, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS place FROM net_s) WHERE place <= 3"))
def _(spark, sf):
    return rounded(query.neighbours(D.fused(spark, sf).select("i", "j", "score", "rank"), 3), score=9)


@register("neighbours_genes", _net_sql("SELECT node, other, round(score, 9) AS score, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, other) AS place FROM net_s WHERE node IN (1, 2, 20)) WHERE place <= 4"))
def _(spark, sf):
    return rounded(query.neighbours(D.fused(spark, sf).select("i", "j", "score", "rank"), 4, by_rank=True, nodes=spark.createDataFrame([(1,), (2,), (20,)], "node int")), score=9)


@register("neighbours_unique", _net_sql("SELECT DISTINCT greatest(node, other) AS i, least(node, other) AS j, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS place FROM net_s) WHERE place <= 3"))
def _(spark, sf):
    return rounded(query.neighbours(D.fused(spark, sf).select("i", "j", "score", "rank"), 3, unique=True), score=9)


@register("adjacency_long", _net_sql("SELECT node AS i, other AS j, round(score, 9) AS score FROM net_s"))
def _(spark, sf):
    return rounded(query.adjacency(D.fused(spark, sf)), score=9)


@register("adjacency_lower_tri", _net_sql("SELECT x.n_nationkey AS i, list(coalesce(round(score, 6), 0.0) ORDER BY y.n_nationkey) AS values FROM nation x JOIN nation y ON y.n_nationkey < x.n_nationkey LEFT JOIN net ON net.i = x.n_nationkey AND net.j = y.n_nationkey GROUP BY 1"))
def _(spark, sf):
    net = rounded(D.fused(spark, sf).select("i", "j", "score"), score=6)
    return query.lower_triangle(net, D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), fill=0.0)


@register("describe_scores", f"WITH {D.IMPORT_SQL} SELECT alg, count(score) AS n, min(score) AS lo, max(score) AS hi, round(avg(score), 6) AS mean, " + ", ".join(f"round(quantile_cont(score, {p}), 6) AS q{int(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM imp GROUP BY alg")
def _(spark, sf):
    return rounded(query.describe(D.imported(spark, sf)), mean=6, q05=6, q25=6, q50=6, q75=6, q95=6)


@register("describe_histogram", f"WITH {D.IMPORT_SQL}, s AS (SELECT alg, min(score) AS lo, max(score) AS hi FROM imp GROUP BY alg) SELECT alg, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / (hi - lo) * 25), 24) END AS INTEGER) AS bin, count(*) AS n FROM imp JOIN s USING (alg) GROUP BY 1, 2")
def _(spark, sf):
    return query.histogram(D.imported(spark, sf))


_SHIP = D.COSHIP_SQL + ", co_s AS (SELECT i AS node, j AS other, score FROM co UNION ALL SELECT j, i, score FROM co), st AS (SELECT node, sum(score) AS strength, count(*) AS degree FROM co_s GROUP BY node)"


@register("node_strength", f"WITH {_SHIP} SELECT * FROM st")
def _(spark, sf):
    return networks.strength(D.shipped_together(spark, sf))


_BACKBONE = _SHIP + """, t AS (SELECT 2 * sum(score) AS t FROM co),
b0 AS (SELECT co.i, co.j, co.score AS w, x.strength AS a, y.strength AS b, t.t FROM co JOIN st x ON x.node = co.i JOIN st y ON y.node = co.j, t),
b1 AS (SELECT *, a * b / t / t AS p, t / (a * b) AS k, a * b * (t - a) * (t - b) / (t * t * (t - 1)) / (t * t) AS v FROM b0),
b2 AS (SELECT *, p * p / v * (1 - p) - p + w AS alpha, t - w + p / v * (1 - p * p) - (1 - p) AS beta FROM b1),
b3 AS (SELECT *, alpha / (alpha + beta) AS e, 2 * (k + w * (1 / (a * b) - t * (a + b) / (a * b * a * b))) / ((k * w + 1) * (k * w + 1)) AS slope FROM b2),
bb AS (SELECT i, j, w AS score, (k * w - 1) / (k * w + 1) AS nc_score, sqrt(e * (1 - e) * t * slope * slope) AS nc_sdev FROM b3)"""


@register("backbone_scores", f"WITH {_BACKBONE} SELECT i, j, score, round(nc_score, 6) AS nc_score, round(nc_sdev, 6) AS nc_sdev FROM bb")
def _(spark, sf):
    return rounded(networks.backbone(D.shipped_together(spark, sf)), nc_score=6, nc_sdev=6)


@register("backbone_filtered", f"WITH {_BACKBONE} SELECT i, j, score FROM bb WHERE nc_score - nc_sdev * 1.28 > 0")
def _(spark, sf):
    return networks.backbone(D.shipped_together(spark, sf), 1.28).select("i", "j", "score")


def _two(spark, sf):
    """The better two fifths of the edges of two networks."""

    def keep(alg: str) -> DataFrame:
        d = D.one(spark, sf, alg).select("i", "j", "score", "rank")
        return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).filter("5 * rank <= 2 * n").drop("n")  # one row

    return keep("revenue"), keep("avg_disc")


_TWO = D.IMPORT_SQL + ", x AS (SELECT i, j, score, rank FROM imp WHERE alg = 'revenue' AND 5 * rank <= 2 * (SELECT count(*) FROM imp WHERE alg = 'revenue')), y AS (SELECT i, j, score, rank FROM imp WHERE alg = 'avg_disc' AND 5 * rank <= 2 * (SELECT count(*) FROM imp WHERE alg = 'avg_disc'))"
_COMPARE = "z0 AS (SELECT i, j, CASE WHEN y.rank IS NULL THEN 1 WHEN x.rank IS NULL THEN 2 ELSE 0 END AS flag, coalesce(x.rank, 0.0) AS rank_a, coalesce(y.rank, 0.0) AS rank_b FROM x FULL JOIN y USING (i, j)), z AS (SELECT *, rank_a + rank_b AS rank FROM z0)"


@register("compare_edges", f"WITH {_TWO}, {_COMPARE} SELECT *, round(1 - (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()), 9) AS score FROM z")
def _(spark, sf):
    return rounded(networks.compare(*_two(spark, sf)), score=9)


@register("compare_nodes", f"WITH {_TWO}, xn AS (SELECT DISTINCT unnest([i, j]) AS node FROM x), yn AS (SELECT DISTINCT unnest([i, j]) AS node FROM y) SELECT n_nationkey AS node, CASE WHEN xn.node IS NOT NULL AND yn.node IS NOT NULL THEN 0 WHEN xn.node IS NOT NULL THEN 1 WHEN yn.node IS NOT NULL THEN 2 ELSE 3 END AS flag FROM nation LEFT JOIN xn ON xn.node = n_nationkey LEFT JOIN yn ON yn.node = n_nationkey")
def _(spark, sf):
    return networks.compare_nodes(*_two(spark, sf), D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")))


@register("compare_orthologs", f"WITH {_TWO.replace('y AS (', 'y0 AS (')}, y AS (SELECT greatest(24 - i, 24 - j) AS i, least(24 - i, 24 - j) AS j, score, rank FROM y0), {_COMPARE} SELECT *, round(1 - (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()), 9) AS score FROM z")
def _(spark, sf):
    x, y = _two(spark, sf)
    dictionary = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("old"), (24 - F.col("n_nationkey")).alias("new"))
    return rounded(networks.compare(x, networks.translate(y, dictionary)), score=9)


_GOLD = "gold AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey)"


def _gold(spark, sf):
    return networks.together(D.table(spark, sf, "nation").select(F.col("n_regionkey").alias("set"), F.col("n_nationkey").alias("node")))


@register("gold_pairs", f"WITH {_GOLD} SELECT * FROM gold")
def _(spark, sf):
    return _gold(spark, sf)


@register("gold_negatives", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def _(spark, sf):
    n = D.table(spark, sf, "nation")
    return networks.negatives(n.select(F.col("n_nationkey").alias("node")), _gold(spark, sf))


_ROC = f"{D.fused_sql()}, {_GOLD}, e AS (SELECT net.*, CASE WHEN gold.i IS NULL THEN 0 ELSE 1 END AS t FROM net LEFT JOIN gold USING (i, j)), r AS (SELECT row_number() OVER o AS place, CAST(sum(t) OVER o AS BIGINT) AS tp, CAST(sum(1 - t) OVER o AS BIGINT) AS fp, sum(t) OVER () AS pos, sum(1 - t) OVER () AS neg FROM e WINDOW o AS (ORDER BY abs(score) DESC, i, j ROWS UNBOUNDED PRECEDING)), roc AS (SELECT place, tp, fp, tp / pos AS tpr, fp / neg AS fpr, tp / place AS ppv FROM r)"


def _judged(spark, sf):
    return networks.judged(D.fused(spark, sf).select("i", "j", "score"), _gold(spark, sf))


def _curve(spark, sf):
    return networks.roc(_judged(spark, sf))


@register("roc_curve", f"WITH {_ROC} SELECT place, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(ppv, 9) AS ppv FROM roc")
def _(spark, sf):
    return rounded(_curve(spark, sf), tpr=9, fpr=9, ppv=9)


@register("roc_auc", f"WITH {_ROC}, l AS (SELECT *, lag(tpr) OVER (ORDER BY place) AS t0, lag(fpr) OVER (ORDER BY place) AS f0, lag(ppv) OVER (ORDER BY place) AS p0 FROM roc) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS auc, round(sum((tpr - t0) * (ppv + p0) / 2), 9) AS aupr FROM l")
def _(spark, sf):
    return rounded(networks.areas(_judged(spark, sf)), auc=9, aupr=9)


@register("roc_recall_cut", f"WITH {_ROC} SELECT min(place) AS place FROM roc WHERE tpr >= 0.5")
def _(spark, sf):
    return networks.recall_cut(_curve(spark, sf), 0.5)


@register("tau_per_node", f"""WITH {D.IMPORT_SQL}, xs AS (SELECT i AS node, j AS other, score FROM imp WHERE alg = 'revenue' UNION ALL SELECT j, i, score FROM imp WHERE alg = 'revenue'),
ys AS (SELECT i AS node, j AS other, score FROM imp WHERE alg = 'qty' UNION ALL SELECT j, i, score FROM imp WHERE alg = 'qty'),
d AS (SELECT node, other, coalesce(xs.score, 0) AS x, coalesce(ys.score, 0) AS y FROM xs FULL JOIN ys USING (node, other)),
p AS (SELECT a.node, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.node = b.node AND a.other < b.other),
s AS (SELECT node, sum(sx * sy) AS s, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM p GROUP BY node)
SELECT node, round(CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(CAST(nx * ny AS DOUBLE)) END, 9) AS tau FROM s""")
def _(spark, sf):
    return rounded(networks.kendall(D.one(spark, sf, "revenue"), D.one(spark, sf, "qty")), tau=9)


@register("reheader", _net_sql(", t AS (SELECT i, j, score FROM net WHERE score > 0.95), n AS (SELECT DISTINCT unnest([i, j]) AS node FROM t), k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM n) SELECT a.id AS i, b.id AS j, round(score, 9) AS score FROM t JOIN k a ON a.node = t.i JOIN k b ON b.node = t.j"))
def _(spark, sf):
    return rounded(query.reheader(query.threshold(D.fused(spark, sf), 0.95).select("i", "j", "score")), score=9)


@register("resolve_paths", "SELECT n_name AS name, string_split(n_regionkey || ':' || n_nationkey, ':')[1] AS level1, string_split(n_regionkey || ':' || n_nationkey, ':')[2] AS level2 FROM nation")
def _(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.split(F.concat_ws(":", "n_regionkey", "n_nationkey"), ":").alias("path"))
    return text.levels(n)


@register("sample_exact")
def _(spark, sf):
    return query.sample(D.shipped_together(spark, sf), 30, seed=1)


@register("sample_replacement")
def _(spark, sf):
    return query.sample(D.shipped_together(spark, sf), 50, seed=1, replacement=True)


_DENSE = D.COSHIP_SQL + ", l AS (SELECT i, j, score FROM co WHERE score > (SELECT avg(score) FROM co)), e AS (SELECT i AS node, j AS other, score FROM l UNION ALL SELECT j, i, score FROM l)"


def _above_mean(spark, sf):
    net = D.shipped_together(spark, sf)
    return net.crossJoin(F.broadcast(net.agg(F.avg("score").alias("mean")))).filter("score > mean").select("i", "j", "score")  # one row


@register("components", f"""WITH RECURSIVE {_DENSE}, s AS (SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.node) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def _(spark, sf):
    return components.components(_above_mean(spark, sf), a="i", b="j")


@register("triangles_transitivity", f"WITH {_DENSE}, t AS (SELECT count(*) AS triangles FROM l a JOIN l b ON a.j = b.i JOIN l c ON c.i = a.i AND c.j = b.j), k AS (SELECT CAST(coalesce(sum(d * (d - 1) // 2), 0) AS BIGINT) AS triples FROM (SELECT n, count(*) AS d FROM (SELECT i AS n FROM l UNION ALL SELECT j FROM l) GROUP BY n)) SELECT triangles, triples, round(CASE WHEN triples > 0 THEN 3 * triangles / triples END, 9) AS transitivity FROM t, k")
def _(spark, sf):
    return rounded(networks.triangles(_above_mean(spark, sf)), transitivity=9)


@register("degree_counts", f"WITH {_DENSE} SELECT d AS degree, count(*) AS nodes FROM (SELECT n, count(*) AS d FROM (SELECT i AS n FROM l UNION ALL SELECT j FROM l) GROUP BY n) GROUP BY d")
def _(spark, sf):
    return networks.degree_counts(_above_mean(spark, sf))


_CUTS = f"""{D.COSHIP_SQL}, b AS (SELECT floor(avg(score)) AS lo, max(score) AS hi FROM co), c AS (SELECT CAST(k AS INTEGER) AS step, CASE WHEN k = 10 THEN hi ELSE lo + k * ((hi - lo) / 10) END AS cut FROM b, range(11) t(k)),
l AS (SELECT step, i, j FROM c JOIN co ON score > cut), dg AS (SELECT step, n, count(*) AS d FROM (SELECT step, i AS n FROM l UNION ALL SELECT step, j FROM l) GROUP BY 1, 2),
hg AS (SELECT step, d, count(*) AS c FROM dg GROUP BY 1, 2), t3 AS (SELECT x.step, count(*) AS t FROM l x JOIN l y ON x.step = y.step AND x.j = y.i JOIN l z ON z.step = x.step AND z.i = x.i AND z.j = y.j GROUP BY 1),
ft AS (SELECT step, sum(c) AS nodes, sum(c * d) / 2 AS edges, sum(c * d * (d - 1)) / 2 AS triples, CASE WHEN min(d) < max(d) AND min(c) < max(c) THEN pow(corr(log10(d + 1), log10(c + 1)), 2) END AS r2 FROM hg GROUP BY 1),
sw AS (SELECT c.step, cut, CAST(coalesce(nodes, 0) AS BIGINT) AS nodes, CAST(coalesce(edges, 0) AS BIGINT) AS edges, r2, CASE WHEN triples > 0 THEN 3 * coalesce(t, 0) / triples END AS transitivity FROM c LEFT JOIN ft USING (step) LEFT JOIN t3 USING (step))"""


def _sweep(spark, sf):
    net = D.shipped_together(spark, sf)
    lo, hi = net.agg(F.floor(F.avg("score")).cast("double"), F.max("score")).first()
    return thresholds.sweep(net, lo, hi, 10)


@register("threshold_sweep", f"WITH {_CUTS} SELECT step, cut, nodes, edges, round(r2, 9) AS r2, round(transitivity, 9) AS transitivity FROM sw")
def _(spark, sf):
    return rounded(_sweep(spark, sf), r2=9, transitivity=9)


@register("threshold_suggested", f"""WITH {_CUTS}, rk AS (SELECT step, CAST(dense_rank() OVER (ORDER BY nodes DESC) - 1 AS INTEGER) AS nodes_rank, CAST(dense_rank() OVER (ORDER BY edges DESC) - 1 AS INTEGER) AS edges_rank,
CAST(dense_rank() OVER (ORDER BY round(r2, 9) DESC NULLS LAST) - 1 AS INTEGER) AS r2_rank, CAST(dense_rank() OVER (ORDER BY round(abs(0.5 - transitivity), 9) NULLS LAST) - 1 AS INTEGER) AS transitivity_rank FROM sw)
SELECT *, row_number() OVER (ORDER BY nodes_rank + r2_rank + transitivity_rank, step DESC) = 1 AS suggested FROM rk""")
def _(spark, sf):
    return thresholds.suggested(_sweep(spark, sf)).select("step", "nodes_rank", "edges_rank", "r2_rank", "transitivity_rank", "suggested")


_HOPS = "".join(f", p{k} AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM p{k - 1} UNION ALL SELECT p.source, e.other, p.d + e.score FROM p{k - 1} p JOIN e ON p.node = e.node) GROUP BY 1, 2)" for k in range(1, 5))


@register("graphstats", f"""WITH RECURSIVE {_DENSE}, k AS (SELECT node, count(*) AS d, sum(score) AS s FROM e GROUP BY 1), alls AS (SELECT s_suppkey AS node, coalesce(d, 0) AS d, coalesce(s, 0) AS s FROM supplier LEFT JOIN k ON k.node = s_suppkey),
sp AS (SELECT min(d) AS lo, max(d) AS hi FROM alls), hb AS (SELECT CASE WHEN hi > lo THEN CAST(floor((d - lo) / (hi - lo) * 199 + 0.5) AS BIGINT) ELSE 0 END AS id, count(*) AS c FROM alls, sp GROUP BY 1),
fx AS (SELECT lo + t.id * (hi - lo) / 199 AS x, coalesce(c, 0) AS c FROM range(200) t(id) LEFT JOIN hb ON hb.id = t.id, sp), ff AS (SELECT CASE WHEN min(c) < max(c) THEN pow(corr(log10(x), log10(c + 1)), 2) END AS fit FROM fx WHERE x > 0),
tr AS (SELECT count(*) AS t FROM l a JOIN l b ON a.j = b.i JOIN l c ON c.i = a.i AND c.j = b.j), r AS (SELECT DISTINCT node, node AS seen FROM e UNION SELECT e.other, r.seen FROM r JOIN e ON e.node = r.node),
cm AS (SELECT count(DISTINCT m) AS parts FROM (SELECT node, min(seen) AS m FROM r GROUP BY 1)), al AS (SELECT count(*) FILTER (d = 0) AS alone, count(*) AS n, sum(d) AS d, sum(s) AS s, sum(d * (d - 1)) / 2 AS triples FROM alls),
p0 AS (SELECT DISTINCT node AS source, node, CAST(0 AS DOUBLE) AS d FROM e){_HOPS}, pp AS (SELECT max(d) AS dia, sum(d) AS far, count(*) AS pairs FROM p4)
SELECT CAST(place AS INTEGER) AS place, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 1 AS place, 'nodes' AS metric, n AS value FROM al UNION ALL SELECT 2, 'edges', d / 2 FROM al UNION ALL SELECT 3, 'components', parts + alone FROM cm, al UNION ALL SELECT 4, 'clustering_coefficient', 3 * t / triples FROM tr, al
UNION ALL SELECT 5, 'scale_free_fit', fit FROM ff UNION ALL SELECT 6, 'average_degree', d / n FROM al UNION ALL SELECT 7, 'average_weighted_degree', s / n FROM al UNION ALL SELECT 8, 'diameter', dia FROM pp UNION ALL SELECT 9, 'average_path_length', far / (pairs + alone) FROM pp, al)""")
def _(spark, sf):
    return rounded(thresholds.graph_report(_above_mean(spark, sf), D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))), value=6)


_CLUSTERS = """cx AS (SELECT n_regionkey || ':' || n_nationkey AS path, c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey),
cy AS (SELECT c_mktsegment || ':' || CAST(c_custkey % 4 AS VARCHAR) AS path, c_custkey AS member FROM customer),
{names}"""


def _members_sql(name: str, least: int, most: int) -> str:
    return f"""{name}0 AS (SELECT DISTINCT string_split(path, ':')[1] AS cluster, member FROM c{name} UNION SELECT DISTINCT path, member FROM c{name}),
{name} AS (SELECT * FROM {name}0 WHERE cluster IN (SELECT cluster FROM {name}0 GROUP BY 1 HAVING count(*) BETWEEN {least} AND {most}))"""


_MAPS = _CLUSTERS.format(names=_members_sql("x", 10, 400) + ",\n" + _members_sql("y", 10, 400))


def _maps(spark, sf):
    c, n = D.table(spark, sf, "customer"), D.table(spark, sf, "nation")
    first = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(":", "n_regionkey", "n_nationkey").alias("path"), F.col("c_custkey").alias("member"))
    return first, c.select(F.concat_ws(":", "c_mktsegment", F.col("c_custkey") % 4).alias("path"), F.col("c_custkey").alias("member"))


@register("cluster_members", f"WITH {_MAPS} SELECT cluster, string_agg(CAST(member AS VARCHAR), ',' ORDER BY CAST(member AS VARCHAR)) AS members FROM x GROUP BY 1")
def _(spark, sf):
    return clusters.listing(clusters.members(_maps(spark, sf)[0], 10, 400))


@register("cluster_enrichment_bh", f"""WITH {_MAPS}, tops AS (SELECT DISTINCT cluster, CASE WHEN string_split(cluster, ':')[1] IN (SELECT cluster FROM y) THEN string_split(cluster, ':')[1] ELSE cluster END AS top FROM y),
pr AS (SELECT a.cluster AS first, b.cluster AS second FROM (SELECT DISTINCT cluster FROM x) a, (SELECT DISTINCT cluster FROM y) b),
ct AS (SELECT first, second, (SELECT count(*) FROM x WHERE x.cluster = first) AS first_size, (SELECT count(*) FROM y WHERE y.cluster = second) AS mt, (SELECT count(*) FROM y WHERE y.cluster = top) AS mpat,
  (SELECT count(*) FROM x JOIN y USING (member) WHERE x.cluster = first AND y.cluster = second) AS nt, (SELECT count(*) FROM x JOIN y USING (member) WHERE x.cluster = first AND y.cluster = top) AS npat FROM pr JOIN tops ON tops.cluster = second),
ks AS (SELECT *, unnest(range(nt, least(mt, npat) + 1)) AS k FROM ct),
lg AS (SELECT *, lgamma(mt + 1) - lgamma(k + 1) - lgamma(mt - k + 1) + CASE WHEN npat - k <= mpat - mt THEN lgamma(mpat - mt + 1) - lgamma(npat - k + 1) - lgamma(mpat - mt - npat + k + 1) END - lgamma(mpat + 1) + lgamma(npat + 1) + lgamma(mpat - npat + 1) AS e FROM ks),
ps AS (SELECT first, second, any_value(first_size) AS first_size, any_value(mt) AS mt, any_value(mpat) AS mpat, any_value(nt) AS nt, any_value(npat) AS npat, sum(coalesce(exp(e), 0)) AS p FROM lg GROUP BY 1, 2),
rk AS (SELECT *, count(*) OVER () / row_number() OVER (ORDER BY p, first, second) * p AS raw, row_number() OVER (ORDER BY p, first, second) AS r FROM ps),
bh AS (SELECT *, least(1, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rk)
SELECT first, second, first_size, mt AS second_size, mt, nt, mpat, npat, round(nt / mt, 9) AS share, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM bh WHERE nt > 0""")
def _(spark, sf):
    return rounded(clusters.enrichment(*_maps(spark, sf), alpha=None, least=10, most=400), share=9, p=6, p_adj=6)


_PR = 3


def _pagerank_sql() -> str:
    out = f"WITH {D.COSHIP_SQL}, s AS (SELECT i AS node, j AS other, score FROM co UNION ALL SELECT j, i, score FROM co), q AS (SELECT node, other, score / sum(score) OVER (PARTITION BY node) AS share FROM s), n AS (SELECT count(DISTINCT node) AS n FROM s), p0 AS (SELECT DISTINCT node, 1.0::DOUBLE / n AS p FROM s, n)"
    for k in range(_PR):
        out += f", p{k + 1} AS (SELECT other AS node, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(share * p) AS p FROM q JOIN p{k} USING (node), n GROUP BY other)"
    return out + f" SELECT node, round(p, 9) AS pagerank FROM p{_PR}"


@register("pagerank_k", _pagerank_sql())
def _(spark, sf):
    return rounded(networks.pagerank(D.shipped_together(spark, sf), _PR), pagerank=9)


@register("zscore", f"WITH {D.EXPR_SQL} SELECT sample, gene, round((value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene), 6) AS value FROM expr")
def _(spark, sf):
    return rounded(association.zscore(D.expression(spark, sf)).withColumn("gene", F.col("gene").cast("long")), value=6)


_COR = "cor AS (SELECT a.gene AS i, b.gene AS j, corr(a.value, b.value) AS score FROM {e} a JOIN {e} b ON a.sample = b.sample AND a.gene > b.gene GROUP BY 1, 2)"
_PEARSON = f"{D.EXPR_SQL}, {_COR.format(e='expr')}"


def _long_genes(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("i", "j")})


@register("pearson", f"WITH {_PEARSON} SELECT i, j, round(score, 6) AS score FROM cor")
def _(spark, sf):
    return rounded(_long_genes(association.pearson(D.expression(spark, sf))), score=6)


@register("spearman", f"WITH {D.EXPR_SQL}, rk AS (SELECT sample, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS value FROM expr), {_COR.format(e='rk')} SELECT i, j, round(score, 6) AS score FROM cor")
def _(spark, sf):
    return rounded(_long_genes(association.spearman(D.expression(spark, sf))), score=6)


@register("gaussian_mi", f"WITH {_PEARSON} SELECT i, j, round(-0.5 * ln(1 - score * score), 6) AS score FROM cor")
def _(spark, sf):
    return rounded(_long_genes(association.gaussian_mi(association.pearson(D.expression(spark, sf)))), score=6)


_SOFT = {"unsigned": "pow(abs(score), 2)", "signed": "pow((1 + score) / 2, 2)", "hybrid": "CASE WHEN score > 0 THEN pow(score, 2) ELSE 0 END"}
for _kind, _expr in _SOFT.items():
    QUERIES[f"tom_{_kind}"] = lambda spark, sf, k=_kind: rounded(_long_genes(association.tom(association.pearson(D.expression(spark, sf)), 2, k)), score=6)
    ORACLES[f"tom_{_kind}"] = f"""WITH {_PEARSON}, a AS (SELECT i, j, {_expr} AS w FROM cor), s AS (SELECT i AS n, j AS o, w FROM a UNION ALL SELECT j, i, w FROM a), k AS (SELECT n, sum(w) AS k FROM s GROUP BY n),
l AS (SELECT x.n AS i, y.o AS j, sum(x.w * y.w) AS l FROM s x JOIN s y ON x.o = y.n AND x.n > y.o GROUP BY 1, 2)
SELECT a.i, a.j, round((coalesce(l, 0) + w) / (least(p.k, q.k) + 1 - w), 6) AS score FROM a LEFT JOIN l ON l.i = a.i AND l.j = a.j JOIN k p ON p.n = a.i JOIN k q ON q.n = a.j"""

_MI = _PEARSON + ", mi AS (SELECT i, j, -0.5 * ln(1 - score * score) AS score FROM cor), ms AS (SELECT i AS n, j AS o, score FROM mi UNION ALL SELECT j, i, score FROM mi)"


def _mi(spark, sf):
    return association.gaussian_mi(association.pearson(D.expression(spark, sf)))


@register("clr", f"WITH {_MI}, z AS (SELECT n, sum(score) / 64 AS m, sqrt((sum(score * score) - sum(score) * sum(score) / 64) / 63) AS sd FROM ms GROUP BY n) SELECT i, j, round(sqrt(pow(greatest((score - a.m) / a.sd, 0), 2) + pow(greatest((score - b.m) / b.sd, 0), 2)), 6) AS score FROM mi JOIN z a ON a.n = i JOIN z b ON b.n = j")
def _(spark, sf):
    return rounded(_long_genes(association.clr(_mi(spark, sf), 64)), score=6)


@register("aracne_dpi", f"WITH {_MI}, l AS (SELECT x.n AS i, y.o AS j, max(least(x.score, y.score)) AS over FROM ms x JOIN ms y ON x.o = y.n AND x.n > y.o GROUP BY 1, 2) SELECT mi.i, mi.j, round(CASE WHEN over > score THEN 0 ELSE score END, 6) AS score FROM mi LEFT JOIN l USING (i, j)")
def _(spark, sf):
    return rounded(_long_genes(association.dpi(_mi(spark, sf))), score=6)


_NET = "WITH RECURSIVE " + D.fused_sql() + ", e AS (SELECT i AS node, j AS other, score FROM net UNION ALL SELECT j, i, score FROM net)"


@register("laplacian_centrality", _NET + """, s AS (SELECT node, sum(score) AS s FROM e GROUP BY 1)
SELECT s.node, round(any_value(s.s * s.s) + sum(2 * t.s * e.score + e.score * e.score), 6) AS laplacian FROM s JOIN e ON s.node = e.node JOIN s t ON t.node = e.other GROUP BY s.node""")
def _laplacian(spark, sf):
    return rounded(centrality.laplacian(D.fused(spark, sf)), laplacian=6)


def _unrolled(rounds: int, step: str) -> str:
    """CTEs x1... each made from the one before."""
    return ", x0 AS (SELECT DISTINCT node, CAST(1.0 AS DOUBLE) AS x FROM e)" + "".join(f", x{k} AS MATERIALIZED (SELECT other AS node, {step} AS x FROM e JOIN x{k - 1} p ON e.node = p.node GROUP BY other)" for k in range(1, rounds + 1))


@register("eigenvector_k", _NET + _unrolled(6, "sum(e.score * p.x)") + " SELECT node, round(x / sqrt(sum(x * x) OVER ()), 6) AS eigenvector FROM x6")
def _eigenvector(spark, sf):
    return rounded(centrality.eigenvector(D.fused(spark, sf), 6), eigenvector=6)


@register("katz_k", _NET + _unrolled(5, "1.0 + 0.02 * sum(e.score * p.x)") + " SELECT node, round(x, 6) AS katz FROM x5")
def _katz(spark, sf):
    return rounded(centrality.katz(D.fused(spark, sf), 6, 0.02), katz=6)


_LINKS = ", l AS (SELECT node, other, 1 / abs(CASE WHEN score = 0 THEN 1e-8 ELSE score END) AS len FROM e), d0 AS (SELECT DISTINCT node AS source, node, CAST(0 AS DOUBLE) AS d FROM l)" + "".join(
    f", d{k} AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT p.source, l.other, p.d + l.len FROM d{k - 1} p JOIN l ON p.node = l.node) GROUP BY 1, 2)" for k in range(1, 13)
)


@register("shortest_paths", _NET + _LINKS + " SELECT source, node, round(d, 6) AS distance FROM d12")
def _paths(spark, sf):
    return rounded(centrality.distances(D.fused(spark, sf)), distance=6)


@register("closeness", _NET + _LINKS + " SELECT source AS node, round(count(*) / sum(d) * count(*) / (SELECT count(DISTINCT source) - 1 FROM d12), 6) AS closeness FROM d12 WHERE source <> node GROUP BY 1")
def _closeness(spark, sf):
    return rounded(centrality.closeness(centrality.distances(D.fused(spark, sf))), closeness=6)


@register("path_summary", _NET + _LINKS + " SELECT round(max(d), 6) AS diameter, round(avg(d), 6) AS mean_path FROM d12")
def _path_summary(spark, sf):
    return rounded(centrality.path_summary(centrality.distances(D.fused(spark, sf))), diameter=6, mean_path=6)


@register("bicor", "WITH " + D.EXPR_SQL + """, m AS (SELECT gene, median(value) AS mid FROM expr GROUP BY 1), x AS (SELECT sample, gene, value - mid AS x FROM expr JOIN m USING (gene)),
a AS (SELECT gene, median(abs(x)) AS mad FROM x GROUP BY 1), w AS (SELECT sample, gene, CASE WHEN abs(x / (9 * mad)) < 1 THEN x * pow(1 - (x / (9 * mad)) * (x / (9 * mad)), 2) ELSE 0 END AS x FROM x JOIN a USING (gene)),
n AS (SELECT gene, sqrt(sum(x * x)) AS norm FROM w GROUP BY 1), z AS (SELECT sample, gene, x / norm AS x FROM w JOIN n USING (gene))
SELECT p.gene AS i, q.gene AS j, round(sum(p.x * q.x), 6) AS score FROM z p JOIN z q ON p.sample = q.sample AND p.gene > q.gene GROUP BY 1, 2""")
def _bicor(spark, sf):
    return rounded(association.bicor(D.expression(spark, sf)), score=6)


@register("lookup_names", _net_sql(f"SELECT i, j, round(score, 9) AS score, rank FROM net WHERE (i = 3 OR j = 3) OR (i = 7 AND j = 5)"))
def _lookup(spark, sf):
    names = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    three, five, seven = (names.filter(F.col("node") == k).first()["name"].lower() for k in (3, 5, 7))
    return rounded(query.lookup(D.fused(spark, sf).select("i", "j", "score", "rank"), names, [three, f"{five}:{seven}"], case_insensitive=True, strict=True), score=9)


@register("strength_directed", _net_sql(""", d AS (SELECT i AS s, j AS t, score FROM net WHERE direction <> 2 UNION ALL SELECT j, i, score FROM net WHERE direction <> 1), b AS (SELECT s AS node, score AS o, 0 AS n FROM d UNION ALL SELECT t, 0, score FROM d)
SELECT node, round(sum(o), 6) AS out_strength, round(sum(n), 6) AS in_strength, round(sum(o + n), 6) AS strength FROM b GROUP BY 1"""))
def _directed(spark, sf):
    return rounded(query.directed_strength(D.fused(spark, sf)), out_strength=6, in_strength=6, strength=6)


@register("agg_kept_directions", f"WITH {D.fused_sql('top2')}, k AS (SELECT i, j, list(alg ORDER BY rank, alg)[1] AS t1, list(alg ORDER BY rank, alg)[2] AS t2, " + ", ".join(f"max(direction) FILTER (alg = '{a}') AS d_{a}" for a in D.ALGS) + " FROM imp GROUP BY 1, 2) SELECT i, j, direction, rank, t1, t2, " + ", ".join(f"d_{a}" for a in D.ALGS) + " FROM net JOIN k USING (i, j)")
def _kept(spark, sf):
    out = consensus.aggregate(D.imported(spark, sf), "top2", len(D.ALGS), D.NODES, keep=D.ALGS)
    return out.select("i", "j", "direction", "rank", "t1", "t2", *[f"d_{a}" for a in D.ALGS])


def _names(spark, sf):
    return D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))


_CELLS = "cl AS (SELECT x.n_nationkey AS i, x.n_name AS name, y.n_nationkey AS j, y.n_name AS other, CASE WHEN x.n_nationkey = y.n_nationkey OR score IS NULL THEN 'NaN' ELSE printf('%.8f', round(score, 6)) END AS v FROM nation x, nation y LEFT JOIN net ON net.i = greatest(x.n_nationkey, y.n_nationkey) AND net.j = least(x.n_nationkey, y.n_nationkey))"
for _kind, _lines in {
    "sym-mat": "SELECT i, string_agg(v, chr(9) ORDER BY j) AS value FROM cl GROUP BY i",
    "low-tri": "SELECT i, string_agg(v, chr(9) ORDER BY j) AS value FROM cl WHERE j < i GROUP BY i",
    "up-tri": "SELECT i, repeat(chr(9), i) || string_agg(v, chr(9) ORDER BY j) AS value FROM cl WHERE j > i GROUP BY i",
    "aracne": "SELECT i, any_value(name) || chr(9) || string_agg(other || chr(9) || v, chr(9) ORDER BY j) AS value FROM cl GROUP BY i",
    "edge-list": "SELECT i, j, name || chr(9) || other || chr(9) || v AS value FROM cl WHERE v <> 'NaN'",
}.items():
    QUERIES[f"convert_{_kind.replace('-', '_')}"] = lambda spark, sf, k=_kind: text.matrix_lines(rounded(D.fused(spark, sf).select("i", "j", "score"), score=6), _names(spark, sf), k)
    ORACLES[f"convert_{_kind.replace('-', '_')}"] = _net_sql(f", {_CELLS} {_lines}")


@register("network_round_trip", _net_sql("SELECT x.n_name AS name_i, y.n_name AS name_j, direction, rank, round(score, 9) AS score FROM net JOIN nation x ON x.n_nationkey = i JOIN nation y ON y.n_nationkey = j WHERE score > 0.5"))
def _round_trip(spark, sf):
    """A network written with its header, nodes and measures, and a part of it read back by name."""
    path = Scratch(spark).path("network")
    net = D.fused(spark, sf).select("i", "j", "direction", "rank", "score")
    store.write_network(store.Network(_names(spark, sf), net, networks.strength(net), {"name": "trade"}), path)
    back = store.read_network(spark, path).subset("score > 0.5")
    a, b = (back.nodes.select(F.col("node").alias(e), F.col("name").alias(f"name_{e}")) for e in "ij")
    return rounded(back.edges.join(a, "i").join(b, "j").select("name_i", "name_j", "direction", "rank", "score"), score=9)


@register("tau_orthologs", f"""WITH {D.IMPORT_SQL}, m AS (SELECT n_nationkey AS old, (n_nationkey + k * 5) % 25 AS new FROM nation, range(2) t(k)),
y0 AS (SELECT greatest(a.new, b.new) AS i, least(a.new, b.new) AS j, max(score) AS score FROM imp JOIN m a ON a.old = i JOIN m b ON b.old = j WHERE alg = 'qty' AND a.new <> b.new GROUP BY 1, 2),
xs AS (SELECT i AS node, j AS other, score FROM imp WHERE alg = 'revenue' UNION ALL SELECT j, i, score FROM imp WHERE alg = 'revenue'), ys AS (SELECT i AS node, j AS other, score FROM y0 UNION ALL SELECT j, i, score FROM y0),
d AS (SELECT node, other, coalesce(xs.score, 0) AS x, coalesce(ys.score, 0) AS y FROM xs FULL JOIN ys USING (node, other)),
p AS (SELECT a.node, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.node = b.node AND a.other < b.other), s AS (SELECT node, sum(sx * sy) AS s, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM p GROUP BY node)
SELECT node, round(CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(CAST(nx * ny AS DOUBLE)) END, 9) AS tau FROM s""")
def _tau_orthologs(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("old"))
    both = n.select("old", F.col("old").alias("new")).union(n.select("old", (F.col("old") + 5) % 25))
    out = networks.kendall(D.one(spark, sf, "revenue"), networks.orthologs(D.one(spark, sf, "qty").select("i", "j", "score"), both))
    return rounded(out.withColumn("node", F.col("node").cast("long")), tau=9)


@register("tom_power_fits", f"""WITH {_PEARSON}, pw AS (SELECT 2 * p AS power FROM range(1, 16) t(p)), sk AS (SELECT power, n, sum(pow((1 + score) / 2, power)) AS k FROM pw, (SELECT i AS n, score FROM cor UNION ALL SELECT j, score FROM cor) GROUP BY 1, 2),
sp AS (SELECT power, min(k) AS lo, max(k) AS hi FROM sk GROUP BY 1), bn AS (SELECT power, lo, hi, CASE WHEN hi > lo THEN greatest(least(ceil((k - lo) / ((hi - lo) / 10)) - 1, 9), 0) ELSE 0 END AS bin, count(*) AS n FROM sk JOIN sp USING (power) GROUP BY 1, 2, 3, 4)
SELECT CAST(power AS INTEGER) AS power, round(CASE WHEN min(n) < max(n) AND min(bin) < max(bin) THEN abs(corr(ln(lo + (bin + 0.5) * (hi - lo) / 10), ln(n))) END, 6) AS fit FROM bn GROUP BY 1""")
def _power_fits(spark, sf):
    return rounded(association.power_fits(association.pearson(D.expression(spark, sf))), fit=6)


@register("network_distance", f"WITH {D.IMPORT_SQL}, x AS (SELECT i, j, score FROM imp WHERE alg = 'cnt'), y AS (SELECT i, j, score FROM imp WHERE alg = 'qty'), b AS (SELECT i, j, coalesce(x.score, 0) AS a, coalesce(y.score, 0) AS b FROM x FULL JOIN y USING (i, j)), n AS (SELECT count(DISTINCT n) AS n FROM (SELECT i AS n FROM b UNION ALL SELECT j FROM b)) SELECT round(pow(2 * sum(pow(abs(a - b), 2)) / (any_value(n) * (any_value(n) - 1) / 2), 0.5), 6) AS distance FROM b, n")
def _distance(spark, sf):
    return rounded(perturbations.network_distance(D.one(spark, sf, "cnt"), D.one(spark, sf, "qty")), distance=6)


@register("compare_merged_names", f"WITH {_TWO}, xn AS (SELECT DISTINCT unnest([i, j]) AS node FROM x), yn AS (SELECT DISTINCT unnest([i, j]) + 100 AS node FROM y), p AS (SELECT xn.node AS old, yn.node AS new FROM xn JOIN yn ON yn.node = xn.node + 100) SELECT node, coalesce(a.old || ',' || a.new, b.old || ',' || b.new, CAST(node AS VARCHAR)) AS name FROM (SELECT node FROM xn UNION SELECT node FROM yn) LEFT JOIN p a ON a.old = node LEFT JOIN p b ON b.new = node")
def _merged(spark, sf):
    x, y = (query.symmetric(e).select("node").distinct() for e in _two(spark, sf))
    dictionary = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new"))
    return networks.merged_names(x, y.select((F.col("node") + 100).alias("node")), dictionary)


for _name, _options in {"genie3": {"models": 5}, "elnet": {"models": 1}, "tigress": {"models": 2}, "plsnet": {"models": 20}, "llr": {"models": 5}, "svm": {}, "narromi": {}}.items():
    QUERIES[f"infer_{_name}"] = lambda spark, sf, n=_name, o=_options: rounded(ensembles.regress(D.expression(spark, sf), ensembles.KERNELS[n](**o), seed=1), score=9)


@register("mi_bspline")
def _mi_bspline(spark, sf):
    return rounded(association.spline_mi(D.expression(spark, sf), bins=7), score=9)


@register("pcor")
def _pcor(spark, sf):
    return rounded(association.partial_correlation(D.expression(spark, sf)), score=9)


@register("betweenness")
def _betweenness(spark, sf):
    return rounded(centrality.betweenness(D.one(spark, sf, "cnt"))[0], betweenness=6)


@register("edge_betweenness")
def _edge_betweenness(spark, sf):
    return rounded(centrality.betweenness(D.one(spark, sf, "cnt"))[1], betweenness=6)


@register("spanning_edges")
def _spanning(spark, sf):
    return rounded(centrality.spanning_edges(D.one(spark, sf, "cnt")), spanning=9)


@register("anoverence")
def _anoverence(spark, sf):
    """All samples as chips: experiments of a control and four treatments, each repeated four times."""
    s = F.col("sample")
    d = D.expression(spark, sf)
    chips = d.select("sample").distinct().select("sample", F.floor(s / 20).alias("experiment"), F.when(F.floor(s / 4) % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), F.floor(s / 4) % 5))).alias("perturbations"), F.lit(0.0).alias("time"), (s % 4 + 1).cast("int").alias("repeat"), F.array().cast("array<int>").alias("changed"))
    return rounded(perturbations.anoverence(d, chips), score=9)


@register("differential_network")
def _differential(spark, sf):
    """Vectors of even labels against those of odd ones; genes are dealt into three pathways."""
    d, labels = D.expression(spark, sf), D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    d = d.join(labels, "sample")
    ways = d.select((F.col("gene") % 3).alias("pathway"), "gene").distinct()
    even, odd = (d.filter(F.col("label") % 2 == k).select("sample", "gene", "value") for k in (0, 1))
    return rounded(perturbations.differential(even, odd, ways, permutations=20, seed=1), distance=9, mean_permuted=9)


@register("stream_strength", """WITH e AS (SELECT ts, 'user ' || user_id AS i, event_type AS j, value AS score FROM events), n AS (SELECT ts, i AS node, score FROM e UNION ALL SELECT ts, j, score FROM e)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, node, round(sum(score), 6) AS strength, count(*) AS degree FROM n GROUP BY 1, 2""")
def _stream_strength(spark, sf):
    """Events as edges between users and types, read as a stream; strength by node and day."""
    schema = D.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern: a path of a stream must be a folder
    # times without a zone are taken as UTC, whatever the session's zone
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts")
    edges = events.select(ts, F.concat(F.lit("user "), "user_id").alias("i"), F.col("event_type").alias("j"), F.col("value").alias("score"))
    scratch = Scratch(spark)
    found = streams.run_to_end(streams.windowed_strength(edges, "ts", "1 day", "40 days"), scratch.path("strength"), scratch.path("state"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86_400).cast("int")).cast("string")
    return rounded(found.select(day.alias("day"), "node", "strength", "degree"), strength=6)


@register("strong_components", f"""WITH RECURSIVE {D.fused_sql()}, h AS (SELECT median(score) AS m FROM net), d AS (SELECT i AS s, j AS t FROM net, h WHERE direction <> 2 AND score > m UNION ALL SELECT j, i FROM net, h WHERE direction <> 1 AND score > m),
r AS (SELECT s AS a, t AS b FROM d UNION SELECT r.a, d.t FROM r JOIN d ON d.s = r.b), n AS (SELECT DISTINCT unnest([s, t]) AS node FROM d),
m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT n.node, least(n.node, coalesce(min(other), n.node)) AS component FROM n LEFT JOIN m USING (node) GROUP BY n.node""")
def _strong(spark, sf):
    """Of the directed half of a consensus network with the better scores."""
    net = D.fused(spark, sf)
    half = net.crossJoin(F.broadcast(net.agg(F.median("score").alias("m")))).filter("score > m")  # one row
    return components.strong_components(query.directed(half))
