"""Views, best edges, neighbours, samples, matrices and summaries of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.operators.ranking import running


def symmetric(net: DataFrame) -> DataFrame:
    """Every edge seen from both ends: (node, other, ...)."""
    rest = [c for c in net.columns if c not in ("i", "j")]
    return net.select(F.col("i").alias("node"), F.col("j").alias("other"), *rest).union(net.select(F.col("j").alias("node"), F.col("i").alias("other"), *rest))


def wide(networks: DataFrame, algs: list[str]) -> DataFrame:
    """(i, j, s_<alg>, r_<alg>...) of long networks."""
    picks = [F.max(F.when(F.col("alg") == a, F.col(c))).alias(f"{p}_{a}") for a in algs for p, c in (("s", "score"), ("r", "rank"))]
    return networks.groupBy("i", "j").agg(*picks)


def threshold(net: DataFrame, t: float, by_rank: bool = False) -> DataFrame:
    return net.filter(F.col("rank") < t) if by_rank else net.filter(F.col("score") > t)


def incident(net: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in nodes(node), each once."""
    ids = nodes.select("node").distinct()
    a = net.join(ids.withColumnRenamed("node", "i"), "i", "left_semi").select(*net.columns)
    b = net.join(ids.withColumnRenamed("node", "j"), "j", "left_semi").select(*net.columns)
    return a.union(b).distinct()


def lookup(net: DataFrame, names: DataFrame, wanted: list[str], case_insensitive: bool = False, strict: bool = False) -> DataFrame:
    """Edges of net by the names(node, name) of their ends: "A" asks for all edges of A, "A:B" for the one between them.

    Each edge is given once. With strict, names that aren't there are an error; else they find nothing. A pair of a node with
    itself is an error.
    """
    fold = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    asked = [tuple(w.lower().split(":", 1)) if case_insensitive else tuple(w.split(":", 1)) for w in wanted]
    if selves := [w for w in asked if len(w) == 2 and w[0] == w[1]]:
        raise ValueError(f"pairs of a node with itself: {selves}")
    spark = net.sparkSession
    d = spark.createDataFrame([(a, b[0] if b else None) for a, *b in asked], "a string, b string").distinct()
    known = names.select("node", fold(F.col("name")).alias("name")).groupBy("name").agg(F.min("node").alias("node"))
    side = lambda c, n: known.select(F.col("name").alias(c), F.col("node").alias(n))
    d = F.broadcast(d).join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    if strict and (gone := [r["n"] for r in d.filter("x IS NULL").select(F.col("a").alias("n")).union(d.filter("b IS NOT NULL AND y IS NULL").select("b")).distinct().collect()]):
        raise ValueError(f"unknown nodes: {sorted(gone)}")
    pairs = d.filter("x IS NOT NULL AND y IS NOT NULL").select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"))
    single = d.filter("b IS NULL AND x IS NOT NULL").select(F.col("x").alias("node"))
    return incident(net, single).union(net.join(pairs, ["i", "j"], "left_semi").select(*net.columns)).distinct()


def directed(net: DataFrame) -> DataFrame:
    """(source, target, score) of net(i, j, direction, score): direction 1 runs from i to j, 2 from j to i, 0 both ways."""
    ahead = net.filter("direction <> 2").select(F.col("i").alias("source"), F.col("j").alias("target"), "score")
    return ahead.union(net.filter("direction <> 1").select(F.col("j").alias("source"), F.col("i").alias("target"), "score"))


def directed_strength(net: DataFrame) -> DataFrame:
    """(node, out_strength, in_strength, strength) of net(i, j, direction, score)."""
    d = directed(net)
    both = d.select(F.col("source").alias("node"), F.col("score").alias("o"), F.lit(0.0).alias("n")).union(d.select("target", F.lit(0.0), "score"))
    return both.groupBy("node").agg(F.sum("o").alias("out_strength"), F.sum("n").alias("in_strength"), F.sum(F.col("o") + F.col("n")).alias("strength"))


def top(net: DataFrame, n: int) -> DataFrame:
    return net.orderBy(F.desc("score"), "i", "j").limit(n)


def neighbours(net: DataFrame, n: int, by_rank: bool = False, unique: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """The n best neighbours of every node (of nodes, if given); unique lists an edge once."""
    d = symmetric(net)
    if nodes is not None:
        d = d.join(nodes.select("node").distinct(), "node", "left_semi").select(*d.columns)
    order = F.col("rank") if by_rank else F.desc("score")
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(order, "other"))).filter(F.col("place") <= n)
    if not unique:
        return d
    return d.select(F.greatest("node", "other").alias("i"), F.least("node", "other").alias("j"), *[c for c in net.columns if c not in ("i", "j")]).distinct()


def sample(net: DataFrame, n: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """Exactly n edges (all, if there are fewer); with replacement, exactly n draws."""
    if not replacement:
        return net.orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j").limit(n)
    numbered = running(net, ["i", "j"], place="_place").withColumn("_k", F.col("_place") - 1)
    size = net.agg(F.count("*").alias("_size"))
    draws = net.sparkSession.range(n).crossJoin(F.broadcast(size)).select(F.pmod(F.xxhash64(F.lit(seed), "id"), "_size").alias("_k"))  # one row of size
    return draws.join(numbered, "_k").select(*net.columns)


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, id): the different nodes in order, with gapless numbers from 0."""
    return running(nodes.select("node").distinct(), ["node"], place="place").select("node", (F.col("place") - 1).alias("id"))


def matrix_rows(net: DataFrame, nodes: DataFrame, part: str = "full", diagonal: bool = False, fill: float | None = None) -> DataFrame:
    """(i, values): the row of each node with its scores to nodes in order, gaps filled.

    part is full, lower (nodes below it) or upper (above it); diagonal adds the node itself to a triangle. Only a row's own
    edges are shuffled; its gaps are filled within the row.
    """
    ids = numbered(nodes)
    a, b = ids.select(F.col("node").alias("i"), F.col("id").alias("x")), ids.select(F.col("node").alias("j"), F.col("id").alias("y"))
    both = symmetric(net.select("i", "j", "score")).select(F.col("node").alias("i"), F.col("other").alias("j"), "score")
    own = both.join(a, "i").join(b, "j").groupBy("i", "x").agg(F.collect_list(F.struct(F.col("y").alias("id"), "score")).alias("e"))
    last = F.lit(ids.count() - 1).cast("long")
    d = ids.select(F.col("node").alias("i"), F.col("id").alias("x")).join(own.drop("x"), "i", "left")
    at = F.col("x")
    lo = {"full": F.lit(0).cast("long"), "lower": F.lit(0).cast("long"), "upper": at if diagonal else at + 1}[part]
    hi = {"full": last, "lower": at if diagonal else at - 1, "upper": last}[part]
    every = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    d = d.select("i", every.alias("every"), F.filter(F.coalesce("e", F.array().cast("array<struct<id:bigint,score:double>>")), lambda c: c["id"].between(lo, hi)).alias("e"))
    gaps = F.transform(F.array_except("every", F.transform("e", lambda c: c["id"])), lambda k: F.struct(k.alias("id"), F.lit(fill).cast("double").alias("score")))
    return d.select("i", F.transform(F.sort_array(F.concat("e", gaps)), lambda c: c["score"]).alias("values"))


def lower_triangle(net: DataFrame, nodes: DataFrame, diagonal: bool = False, fill: float | None = None) -> DataFrame:
    """(i, values): the row of each node with its scores to the nodes below it in order, gaps filled; empty rows are left out."""
    return matrix_rows(net, nodes, "lower", diagonal, fill).filter(F.size("values") > 0)


def adjacency(net: DataFrame) -> DataFrame:
    return symmetric(net).select(F.col("node").alias("i"), F.col("other").alias("j"), "score")


def describe(networks: DataFrame) -> DataFrame:
    """By algorithm: number, extremes, mean and five quantiles of the scores."""
    q = [F.percentile("score", p).alias(f"q{int(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return networks.groupBy("alg").agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"), *q)


def histogram(networks: DataFrame, bins: int = 25) -> DataFrame:
    """(alg, bin, n): equal bins between the extremes of each algorithm, the last one closed."""
    span = networks.groupBy("alg").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    d = networks.join(F.broadcast(span), "alg")  # one row for each algorithm
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return d.groupBy("alg", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reheader(net: DataFrame) -> DataFrame:
    """Edges with the ids of the nodes that have edges, made gapless in order."""
    ids = numbered(symmetric(net))
    a, b = ids.select(F.col("node").alias("i"), F.col("id").alias("new_i")), ids.select(F.col("node").alias("j"), F.col("id").alias("new_j"))
    return net.join(a, "i").join(b, "j").select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), *[c for c in net.columns if c not in ("i", "j")])
