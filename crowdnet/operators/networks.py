"""Strength, backbone, comparison, evaluation and graph statistics of a network (i, j, score, rank)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdnet.operators.query import incident, numbered, symmetric
from crowdnet.operators.ranking import running
from crowdnet.scratch import Scratch, dealt


def strength(net: DataFrame) -> DataFrame:
    return symmetric(net).groupBy("node").agg(F.sum("score").alias("strength"), F.count("*").alias("degree"))


def backbone(net: DataFrame, least: float | None = None) -> DataFrame:
    """(i, j, score, nc_score, nc_sdev): noise-corrected score and its deviation; least keeps nc_score - least * nc_sdev > 0."""
    s = strength(net).select("node", F.col("strength").alias("s"))
    whole = net.agg((2 * F.sum("score")).alias("t"))
    d = net.join(s.select(F.col("node").alias("i"), F.col("s").alias("a")), "i").join(s.select(F.col("node").alias("j"), F.col("s").alias("b")), "j").crossJoin(F.broadcast(whole))  # one row
    w, t, a, b = (F.col(c) for c in ("score", "t", "a", "b"))
    d = d.withColumn("p", a * b / t / t).withColumn("k", t / (a * b))
    d = d.withColumn("v", a * b * (t - a) * (t - b) / (t * t * (t - 1)) / (t * t))
    p, k, v = F.col("p"), F.col("k"), F.col("v")
    d = d.withColumn("alpha", p * p / v * (1 - p) - p + w).withColumn("beta", t - w + p / v * (1 - p * p) - (1 - p))
    d = d.withColumn("e", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    slope = 2 * (k + w * (1 / (a * b) - t * (a + b) / (a * b * a * b))) / ((k * w + 1) * (k * w + 1))
    sdev = F.sqrt(F.col("e") * (1 - F.col("e")) * t * slope * slope)
    out = d.select("i", "j", "score", ((k * w - 1) / (k * w + 1)).alias("nc_score"), sdev.alias("nc_sdev"), F.monotonically_increasing_id().alias("_at"))
    if least is None:
        return out.drop("_at")
    # _at keeps the filter above its columns: moved below them it holds them many times over, in a method too large to be compiled
    return out.filter((F.col("nc_score") - F.col("nc_sdev") * least > 0) & (F.col("_at") >= 0)).drop("_at")


def compare(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, flag, rank_a, rank_b, rank, score): flag 0 in both, 1 in the first only, 2 in the second only."""
    a, b = x.select("i", "j", F.col("rank").alias("rank_a")), y.select("i", "j", F.col("rank").alias("rank_b"))
    d = a.join(b, ["i", "j"], "full").withColumn("flag", F.when(F.col("rank_b").isNull(), 1).when(F.col("rank_a").isNull(), 2).otherwise(0))
    d = d.select("i", "j", "flag", F.coalesce("rank_a", F.lit(0.0)).alias("rank_a"), F.coalesce("rank_b", F.lit(0.0)).alias("rank_b")).withColumn("rank", F.col("rank_a") + F.col("rank_b"))
    span = d.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return d.crossJoin(F.broadcast(span)).withColumn("score", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(1 - (F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")  # one row


def translate(net: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ends of net(i, j) renamed by dictionary(old, new) where it has them, and put in order again.

    Of several new names of one old name the smallest is taken; ``orthologs`` takes all of them.
    """
    m = dictionary.groupBy("old").agg(F.min("new").alias("new"))
    d = net.join(m.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i", "left").join(m.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j", "left")
    d = d.withColumn("ni", F.coalesce("ni", "i")).withColumn("nj", F.coalesce("nj", "j"))
    return d.select(F.greatest("ni", "nj").alias("i"), F.least("ni", "nj").alias("j"), *[c for c in net.columns if c not in ("i", "j")])


def orthologs(net: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every edge as often as its ends have pairs of new names in dictionary(old, new); edges without any are left out.

    Where two edges end at the same pair, the best score stays; pairs of a name with itself are dropped.
    """
    m = dictionary.select("old", "new").distinct()
    d = net.join(m.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(m.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j").filter("ni <> nj")
    return d.groupBy(F.greatest("ni", "nj").alias("i"), F.least("ni", "nj").alias("j")).agg(F.max("score").alias("score"))


def merged_names(nodes_a: DataFrame, nodes_b: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(node, name) of all nodes of two networks; a pair of orthologs (old of the first, new of the second) is named "old,new"."""
    m = dictionary.groupBy("old").agg(F.min("new").alias("new"))
    pairs = nodes_a.select(F.col("node").alias("old")).join(m, "old").join(nodes_b.select(F.col("node").alias("new")), "new").select("old", "new").withColumn("name", F.concat_ws(",", "old", "new"))
    both = pairs.select(F.col("old").alias("node"), "name").union(pairs.select(F.col("new").alias("node"), "name"))
    every = nodes_a.select("node").union(nodes_b.select("node")).distinct()
    return every.join(both, "node", "left").select("node", F.coalesce("name", F.col("node").cast("string")).alias("name"))


def compare_nodes(x: DataFrame, y: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, flag): with edges in both 0, in the first 1, in the second 2, in neither 3."""
    own = lambda n, c: symmetric(n).select("node").distinct().withColumn(c, F.lit(True))
    d = nodes.join(own(x, "a"), "node", "left").join(own(y, "b"), "node", "left")
    return d.select("node", F.when(F.col("a") & F.col("b"), 0).when(F.col("a"), 1).when(F.col("b"), 2).otherwise(3).alias("flag"))


def together(sets: DataFrame) -> DataFrame:
    """(i, j) of nodes that are in a set together, of sets(set, node): gold pairs from pathways. Each pair is given once."""
    d = sets.select("set", "node").distinct()
    return d.select("set", F.col("node").alias("i")).join(d.select("set", F.col("node").alias("j")), "set").filter("i > j").select("i", "j").distinct()


def negatives(nodes: DataFrame, gold: DataFrame) -> DataFrame:
    """(i, j) of nodes(node) that aren't in gold. All pairs of nodes are made, as nearly all of them are the result."""
    ids = numbered(nodes)
    a, b = ids.select(F.col("node").alias("i"), F.col("id").alias("x")), ids.select(F.col("node").alias("j"), F.col("id").alias("y"))
    pairs = a.filter("x > 0").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x") - 1)).alias("y")).join(b, "y").select("i", "j")
    return pairs.join(gold.select("i", "j"), ["i", "j"], "left_anti")


def judged(net: DataFrame, gold: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """net with truth: true for gold pairs, false for the others (for negatives only, if given)."""
    d = net.join(gold.select("i", "j").distinct().withColumn("_g", F.lit(True)), ["i", "j"], "left")
    if negatives is None:
        return d.withColumn("truth", F.coalesce("_g", F.lit(False))).drop("_g")
    d = d.join(negatives.select("i", "j").distinct().withColumn("_n", F.lit(False)), ["i", "j"], "left")
    return d.withColumn("truth", F.coalesce("_g", "_n")).drop("_g", "_n")


def _counted(edges: DataFrame, tfs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Judged edges by falling absolute score with their place, hits so far (tp, fp) and in all (pos, neg); t and f are their own."""
    if tfs is not None:
        edges = incident(edges, tfs)
    t, f = F.coalesce(F.col("truth"), F.lit(False)).cast("long"), (~F.coalesce(F.col("truth"), F.lit(True))).cast("long")
    d = edges.select("i", "j", (-F.abs("score")).alias("_key"), t.alias("t"), f.alias("f"))
    sums = d.agg(F.sum("t").alias("pos"), F.sum("f").alias("neg"))
    out = running(d, ["_key", "i", "j"], {"tp": "t", "fp": "f"}, place="place").crossJoin(F.broadcast(sums))  # one row
    return out if most is None else out.filter(F.col("place") <= most)


def roc(edges: DataFrame, tfs: DataFrame | None = None, most: int | None = None, points: int | None = None) -> DataFrame:
    """(place, tp, fp, tpr, fpr, ppv) along the judged edges by falling absolute score.

    tfs(node) keeps edges with an end among them, most the best edges, points about so many evenly spaced places.
    """
    d = _counted(edges, tfs, most)
    if points:
        n = d.agg(F.greatest(F.floor(F.count("*") / points), F.lit(1)).alias("step"))
        d = d.crossJoin(F.broadcast(n)).filter("place % step = 0")  # one row
    return d.select("place", "tp", "fp", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("place")).alias("ppv"))


def areas(edges: DataFrame, tfs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(auc, aupr) of judged edges by trapezoids from the first edge on; an edge's counts give those before it."""
    d = _counted(edges, tfs, most).filter("place > 1")
    tp, fp, t, f, n = (F.col(c) for c in ("tp", "fp", "t", "f", "place"))
    auc = F.sum(f / F.col("neg") * (2 * tp - t) / F.col("pos") / 2)
    aupr = F.sum(t / F.col("pos") * (tp / n + (tp - t) / (n - 1)) / 2)
    return d.agg(auc.alias("auc"), aupr.alias("aupr"))


def recall_cut(curve: DataFrame, share: float) -> DataFrame:
    """The shortest prefix that holds the share of the gold pairs."""
    return curve.filter(F.col("tpr") >= share).agg(F.min("place").alias("place"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs in which the later number is smaller, counted bit by bit from the highest."""
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (ranks >> bit) & 1
        before = np.cumsum(ones) - ones
        group = np.concatenate([[0], np.flatnonzero(np.diff(ranks >> (bit + 1))) + 1])
        start = np.zeros(len(ranks), np.int64)
        start[group] = before[group] - np.concatenate([[0], before[group][:-1]])
        total += int(((before - np.cumsum(start)) * (1 - ones)).sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b by sorting and counting; None if one side is tied throughout."""
    x, y = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    pairs = lambda v: int((c := np.unique(v, return_counts=True)[1]).dot(c - 1)) // 2
    n = len(x) * (len(x) - 1) // 2
    tied_x, tied_y, tied = pairs(x), pairs(y), pairs(x * (int(y.max(initial=0)) + 1) + y)
    if n in (tied_x, tied_y):
        return None
    against = inversions(y[np.lexsort((y, x))])
    return (n - tied_x - tied_y + tied - 2 * against) / float(np.sqrt(float(n - tied_x) * float(n - tied_y)))


def kendall(x: DataFrame, y: DataFrame) -> DataFrame:
    """(node, tau): Kendall's tau-b of each node's scores in two networks; a missing edge is 0, a tied side gives null.

    A node's neighbours are sorted in one task, which takes n log n steps; nodes with a single neighbour are left out.
    """
    d = symmetric(x.select("i", "j", "score")).withColumnRenamed("score", "x").join(symmetric(y.select("i", "j", "score")).withColumnRenamed("score", "y"), ["node", "other"], "full").na.fill(0.0, ["x", "y"])

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": [key[0]], "tau": pd.array([tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy())], dtype="Float64")} if len(pdf) > 1 else {"node": [], "tau": []})

    node = dict(d.dtypes)["node"]
    return d.select("node", "x", "y").groupBy("node").applyInPandas(own, f"node {node}, tau double")


def triangle_edges(net: DataFrame) -> DataFrame:
    """(a, b, c, s1, s2, s3) of every triangle once, with the scores of its edges.

    Edges run from the end of lower degree to the other, so that no node has more than about sqrt(2 * edges) to combine.
    """
    degree = symmetric(net.select("i", "j")).groupBy("node").count()
    side = lambda e, d: degree.select(F.col("node").alias(e), F.col("count").alias(d))
    e = net.select("i", "j", "score").join(side("i", "di"), "i").join(side("j", "dj"), "j")
    up = F.struct("di", "i") < F.struct("dj", "j")
    e = e.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("v"), "score")
    e = Scratch(net.sparkSession).cut(e, "oriented")  # read three times
    own = dealt(e, 8 * e.count(), "u")  # a node's edges are combined
    two = own.select("u", F.col("v").alias("v1"), F.col("score").alias("s1")).join(own.select("u", F.col("v").alias("v2"), F.col("score").alias("s2")), "u").filter("v1 < v2")
    last = e.select(F.least("u", "v").alias("v1"), F.greatest("u", "v").alias("v2"), F.col("score").alias("s3"))
    return two.join(last, ["v1", "v2"]).select(F.col("u").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"), "s1", "s2", "s3")


def triangles(net: DataFrame) -> DataFrame:
    """(triangles, triples, transitivity) of the whole network."""
    t = triangle_edges(net).agg(F.count("*").alias("triangles"))
    k = strength(net.withColumn("score", F.lit(1.0))).agg(F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0.0)).cast("long").alias("triples"))
    return t.crossJoin(F.broadcast(k)).withColumn("transitivity", F.when(F.col("triples") > 0, 3 * F.col("triangles") / F.col("triples")))  # one row each


def degree_counts(net: DataFrame) -> DataFrame:
    return symmetric(net).groupBy("node").count().groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("nodes"))


def resident(links: DataFrame) -> DataFrame:
    """links(node, ...), a written table, dealt by node once and kept on executors' disks for the rounds of a loop.

    Each round then shuffles values of nodes only. Lost parts are made again from the table.
    """
    return links.repartition("node").persist(StorageLevel.DISK_ONLY)


def pagerank(net: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node, pagerank) after rounds of weighted steps from an even start, or fewer if the ranks move by less than tolerance in all.

    Every round is written and read again.
    """
    scratch = Scratch(net.sparkSession)
    links = symmetric(net.select("i", "j", "score"))
    out = links.groupBy("node").agg(F.sum("score").alias("all"))
    links = resident(scratch.cut(links.join(out, "node").select("node", "other", (F.col("score") / F.col("all")).alias("share")), "links"))
    n = out.count()
    now = out.select("node", F.lit(1.0 / n).alias("p"))
    for _ in range(rounds):
        got = links.join(now, "node").groupBy("other").agg(F.sum(F.col("share") * F.col("p")).alias("got"))
        after = scratch.cut(got.select(F.col("other").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("p")), "rank")
        if tolerance is not None:
            moved = now.select("node", F.col("p").alias("q")).join(after, "node").agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0]
            if moved < tolerance:
                now = after
                break
        now = after
    links.unpersist()
    return now.select("node", F.col("p").alias("pagerank"))
