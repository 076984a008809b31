"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdnet.scratch import Scratch, dealt


def _once(edges: DataFrame, n: int) -> DataFrame:
    """The different ones of about n edges."""
    return dealt(edges, n, "a", "b").distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each neighbour above u is linked with the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _once(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b"), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """u and its neighbours below it are linked with the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _once(lower.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b"), n)


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)).first())


def components(edges: DataFrame, scratch: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Self loops, repeated edges and either orientation are allowed; edges with a null end are ignored. Ends must be
    of one orderable type. Every round is written to the shared folder; the driver sees two counts a round.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    loops = ends.filter("a = b").select("a").distinct()
    now = scratch.cut(_once(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ends.count()), "edges")
    mark = _mark(now)
    while mark[0]:
        after = scratch.cut(_small_star(_large_star(now, mark[0]), mark[0]), "edges")
        seen = _mark(after)
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = found.union(roots)
    alone = loops.join(known, loops["a"] == known["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return known.union(alone)


def strong_components(edges: DataFrame, scratch: Scratch | None = None, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component) for every node of a directed edge; component is the smallest node that it reaches and that reaches it.

    Every node takes on the largest node that reaches it; of the nodes that took on r, those that reach r are r's component.
    They go, as do edges between nodes that took on different ones, and the rest begins anew. Every round is written.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    links = scratch.cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s IS NOT NULL AND t IS NOT NULL").distinct(), "links")
    nodes = scratch.cut(links.select(F.col("s").alias("node")).union(links.select("t")).distinct(), "nodes")
    links = links.filter("s <> t")
    done = None
    while not nodes.isEmpty():
        color = nodes.select("node", F.col("node").alias("color"))
        while True:
            got = links.join(color.withColumnRenamed("node", "s"), "s").groupBy(F.col("t").alias("node")).agg(F.max("color").alias("other"))
            after = scratch.cut(color.join(got, "node", "left").select("node", F.greatest("color", F.coalesce("other", "color")).alias("color"), (F.col("other") > F.col("color")).alias("moved")), "colors")
            color = after.select("node", "color")
            if after.filter("moved").isEmpty():
                break
        side = lambda c: color.select(F.col("node").alias(c), F.col("color").alias(f"color_{c}"))
        inner = scratch.cut(links.join(side("s"), "s").join(side("t"), "t").filter("color_s = color_t").select("s", "t", F.col("color_s").alias("color")), "inner")
        found = new = scratch.cut(color.filter("node = color"), "found")
        while not new.isEmpty():
            back = inner.join(new.select(F.col("node").alias("t")), "t").select(F.col("s").alias("node"), "color").distinct()
            new = scratch.cut(back.join(found.select("node"), "node", "left_anti"), "new")
            found = scratch.cut(found.unionByName(new), "found")
        least = found.groupBy("color").agg(F.min("node").alias("component"))
        own = found.join(least, "color").select("node", "component")
        done = scratch.cut(own if done is None else done.unionByName(own), "done")
        nodes = scratch.cut(nodes.join(found.select("node"), "node", "left_anti"), "nodes")
        left = inner.join(found.select(F.col("node").alias("s")), "s", "left_anti").join(found.select(F.col("node").alias("t")), "t", "left_anti")
        links = scratch.cut(left.select("s", "t"), "links")
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))
