"""Networks and expression tables derived from the driver's tables, in Spark and as SQL clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdnet.operators import consensus, ranking
from crowdnet.scratch import Scratch, dealt

ALGS = ["avg_disc", "cnt", "qty", "revenue"]
NODES = 25


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """(alg, a, b, w): four directed weights of the trade from supplier nation a to customer nation b."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust, supp = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    d = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").cast("double").alias("cnt"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
    return d.select("a", "b", F.explode(F.array(*[F.struct(F.lit(a).alias("alg"), F.col(a).alias("w")) for a in ALGS])).alias("x")).select("x.alg", "a", "b", "x.w")


def imported(spark: SparkSession, sf: str) -> DataFrame:
    """The four flows as ranked networks, the largest weights first."""
    return ranking.import_edges(flow(spark, sf), by=["alg"], reverse=True)


def one(spark: SparkSession, sf: str, alg: str) -> DataFrame:
    return ranking.import_edges(flow(spark, sf).filter(F.col("alg") == alg).select("a", "b", "w"), reverse=True)


def fused(spark: SparkSession, sf: str, method: str = "irp") -> DataFrame:
    return consensus.aggregate(imported(spark, sf), method, len(ALGS), NODES, first=ALGS[0])


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, gene, value): the vectors' dimensions are genes."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("gene", "v")).select("sample", "gene", F.col("v").cast("double").alias("value"))


def shipped_together(spark: SparkSession, sf: str) -> DataFrame:
    """(i, j, w): pairs of suppliers by the number of orders that both have lines in; written once, as networks are read several times."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    rows = line.count()
    d = dealt(line, rows, "o").distinct()
    pairs = d.join(d.select("o", F.col("s").alias("t")), "o").filter("s > t").select(F.col("s").alias("i"), F.col("t").alias("j"))
    pairs = dealt(pairs, 2 * rows, "i", "j").groupBy("i", "j").agg(F.count("*").alias("n"))
    return Scratch(spark).cut(pairs.select("i", "j", F.col("n").cast("double").alias("score")), "pairs")


FLOW_SQL = """f0 AS (SELECT s_nationkey AS a, c_nationkey AS b, round(sum(l_extendedprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS cnt, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS avg_disc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
flow AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS alg, a, b, {a} AS w FROM f0" for a in ALGS) + ")"
IMPORT_SQL = FLOW_SQL + """,
c0 AS (SELECT alg, greatest(a, b) AS i, least(a, b) AS j, max(w) FILTER (a > b) AS w1, max(w) FILTER (a < b) AS w2 FROM flow WHERE a <> b GROUP BY 1, 2, 3),
c1 AS (SELECT alg, i, j, CASE WHEN w1 = w2 THEN 0 WHEN w2 IS NULL OR w1 > w2 THEN 1 ELSE 2 END AS direction, CASE WHEN w2 IS NULL OR w1 >= w2 THEN w1 ELSE w2 END AS score FROM c0),
imp AS (SELECT *, rank() OVER (PARTITION BY alg ORDER BY score DESC) + (count(*) OVER (PARTITION BY alg, score) - 1) / 2.0 AS rank FROM c1)"""
#: SQL of the aggregation methods.
METHODS_SQL = {
    "irp": f"sum(1 + log10(rank)) + ({len(ALGS)} - count(rank)) * (1 + log10({NODES * (NODES - 1) // 2}.0))",
    "borda": "avg(rank)",
    "top1": "min(rank)",
    "top2": "CASE WHEN count(rank) >= 2 THEN list_sum(list_sort(list(rank))[1:2]) / 2 END",
}
VOTE_SQL = "CASE WHEN count(*) FILTER (direction = 1) > 2 * count(*) FILTER (direction = 2) THEN 1 WHEN count(*) FILTER (direction = 2) > 2 * count(*) FILTER (direction = 1) THEN 2 ELSE 0 END"


#: SQL of the direction that a method gives an edge.
_BEST = "list(direction ORDER BY rank, alg)"
DIRECTION_SQL = {
    "irp": VOTE_SQL,
    "borda": f"coalesce(max(direction) FILTER (alg = '{ALGS[0]}'), 0)",
    "top1": f"{_BEST}[1]",
    "top2": f"CASE WHEN {_BEST}[1] = {_BEST}[2] THEN {_BEST}[1] ELSE 0 END",
}


def fused_sql(method: str = "irp") -> str:
    return IMPORT_SQL + f""",
g0 AS (SELECT i, j, {DIRECTION_SQL[method]} AS direction, round({METHODS_SQL[method]}, 9) AS value FROM imp GROUP BY i, j),
g1 AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM g0 WHERE value IS NOT NULL),
net AS (SELECT i, j, direction, value, rank, 1 - (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()) AS score FROM g1)"""


EXPR_SQL = "expr AS (SELECT vec_id AS sample, unnest(range(len(embedding))) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
COSHIP_SQL = """ls AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
co AS (SELECT x.s AS i, y.s AS j, CAST(count(*) AS DOUBLE) AS score FROM ls x JOIN ls y ON x.o = y.o AND x.s > y.s GROUP BY 1, 2)"""
EDGES_SQL = "{name}_s AS (SELECT i AS node, j AS other, score, rank FROM {name} UNION ALL SELECT j, i, score, rank FROM {name})"
