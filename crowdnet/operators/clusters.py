"""Hierarchical clusters, their overlap with others, and adjusted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdnet.operators.ranking import running

#: Defaults of the sizes of clusters that are tested, and of the level of significance.
LEAST_MEMBERS, MOST_MEMBERS, ALPHA = 20, 200, 0.1
LEVEL = ":"


def members(mapping: DataFrame, least: int = LEAST_MEMBERS, most: int = MOST_MEMBERS) -> DataFrame:
    """(cluster, depth, path, member) of mapping(path, member): a member of a:b:c belongs to a, a:b and a:b:c.

    Clusters with fewer than least or more than most different members are left out.
    """
    levels = F.split("path", LEVEL)
    d = mapping.select(F.col("member"), levels.alias("path")).select("member", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    d = d.select(F.array_join(F.slice("path", 1, F.col("depth")), LEVEL).alias("cluster"), "depth", F.slice("path", 1, F.col("depth")).alias("path"), "member").distinct()
    sizes = d.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size").between(least, most))
    return d.join(sizes.select("cluster"), "cluster", "left_semi")


def listing(own: DataFrame, delimiter: str = ",") -> DataFrame:
    """(cluster, members): the members in order, in one string."""
    return own.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list(F.col("member").cast("string"))), delimiter).alias("members"))


def populations(own: DataFrame) -> DataFrame:
    """(cluster, top): the outermost cluster around each that is reached through clusters that are in own.

    Members of a cluster are members of all clusters around it, so those of top are the cluster's and its ancestors'.
    """
    kept = own.select("cluster", "depth", "path").distinct()
    chain = kept.select("cluster", F.col("depth").alias("own_depth"), "path", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("at"))
    chain = chain.withColumn("around", F.array_join(F.slice("path", 1, F.col("at")), LEVEL))
    there = kept.select(F.col("cluster").alias("around"), F.lit(True).alias("there"))
    gaps = chain.join(there, "around", "left").groupBy("cluster", "path").agg(F.max(F.when(F.col("there").isNull(), F.col("at")).otherwise(0)).alias("gap"))
    return gaps.select("cluster", F.array_join(F.slice("path", 1, F.col("gap") + 1), LEVEL).alias("top"))


def _log_choose(n: Column, k: Column) -> Column:
    small = F.least(k, n - k)
    return F.aggregate(F.when(small > 0, F.sequence(F.lit(1).cast("long"), small)).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda s, i: s + F.log((n + 1 - i) / i))


def at_least(k: Column, drawn: Column, marked: Column, whole: Column) -> Column:
    """P(X >= k) if drawn of whole are drawn without replacement and marked of these are marked; k must be a possible number."""
    first = F.exp(_log_choose(marked, k) + _log_choose(whole - marked, drawn - k) - _log_choose(whole, drawn))
    last = F.least(marked, drawn)
    steps = F.when(last > k, F.sequence(k, last - 1)).otherwise(F.array().cast("array<long>"))
    start = F.struct(first.alias("p"), first.alias("sum"))

    def step(s: Column, x: Column) -> Column:
        p = s["p"] * (marked - x) * (drawn - x) / ((x + 1) * (whole - marked - drawn + x + 1))
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"))

    return F.aggregate(steps, start, step, lambda s: s["sum"])


def adjusted(tests: DataFrame, p: str, keys: list[str], number: DataFrame, out: str = "p_adj") -> DataFrame:
    """tests with Benjamini-Hochberg's adjusted p; number(n) has the number of all tests, of which those left out have p = 1.

    keys tell tests of equal p apart.
    """
    n = F.broadcast(number)  # one row
    up = running(tests, [p, *keys], place="_rank").crossJoin(n).withColumn("_raw", F.col("n") / F.col("_rank") * F.col(p)).withColumn("_down", -F.col("_rank"))
    return running(up, ["_down"], least={"_least": "_raw"}).withColumn(out, F.least(F.lit(1.0), "_least")).select(*tests.columns, out)


def enrichment(first: DataFrame, second: DataFrame, alpha: float | None = ALPHA, least: int = LEAST_MEMBERS, most: int = MOST_MEMBERS) -> DataFrame:
    """(first, second, first_size, second_size, mt, nt, mpat, npat, share, p, p_adj) of clusters that share more members than by chance.

    first and second are mappings (path, member). All pairs of clusters count as tests, but only those with a common member
    are made: the others have probability 1. The population of a test is the second cluster with its ancestors.
    """
    x, y = members(first, least, most), members(second, least, most)
    tops = populations(y)
    every = y.join(tops.select("cluster", "top"), "cluster").select(F.col("cluster").alias("second"), "top").distinct()
    around = y.select(F.col("cluster").alias("top"), "member")
    mine = x.select(F.col("cluster").alias("first"), "member")
    size = lambda d, k, n: d.groupBy(k).agg(F.count("*").alias(n))
    nt = mine.join(y.select(F.col("cluster").alias("second"), "member"), "member").groupBy("first", "second").agg(F.count("*").alias("nt"))
    npat = mine.join(around, "member").groupBy("first", "top").agg(F.count("*").alias("npat"))
    d = nt.join(every, "second").join(npat, ["first", "top"]).join(size(around, "top", "mpat"), "top")
    d = d.join(size(mine, "first", "first_size"), "first").join(size(y.select(F.col("cluster").alias("second")), "second", "second_size"), "second").withColumn("mt", F.col("second_size"))
    d = d.withColumn("p", at_least(F.col("nt"), F.col("npat"), F.col("mt"), F.col("mpat")))
    number = x.agg(F.countDistinct("cluster").alias("a")).crossJoin(y.agg(F.countDistinct("cluster").alias("b"))).select((F.col("a") * F.col("b")).alias("n"))  # one row each
    d = adjusted(d.select("first", "second", "first_size", "second_size", "mt", "nt", "mpat", "npat", (F.col("nt") / F.col("second_size")).alias("share"), "p"), "p", ["first", "second"], number)
    return d if alpha is None else d.filter(F.col("p_adj") < alpha)
