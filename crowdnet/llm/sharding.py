"""Sharding by Karmarkar-Karp differencing of indivisible groups.

Rows with equal texts form a group that stays in one shard. Groups are dealt by a hash into bins of about BIN groups;
in each bin, the partial partitions with the largest spread are combined, the heaviest part of one with the lightest of
the other, until one partition of the bin into shards is left. The bins' partitions are partial partitions again and
are combined in the same way, in levels of at most BIN of them, so neither a task nor the driver ever holds more. Only
the sizes of groups take part; which part of a bin goes where is a small table that is joined back.

Defined results: a null text has size 1, like an empty one, but is a group of its own; repeated rows are in one shard
and get slots of their own; rows with a null id are dealt by their text like all others; with fewer groups than shards
some shards stay empty; an empty table gives an empty table; other columns are carried along by ``shard_rows`` whatever
they are called, except that one with the name of the output is replaced.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.llm.hot import join_groups
from crowdnet.scratch import Scratch

BIN = 16_384
#: Rows in one run of slots.
RUN = 50_000


def karmarkar_karp(sizes: list[list[int]]) -> list[list[int]]:
    """For partial partitions (lists of k sums), the place that each of their parts gets in the whole.

    A single item of size s is [s, 0, ..., 0]. The sums of the result are in descending order.
    """
    if not sizes:
        return []
    k = len(sizes[0])
    order = count()
    trees: list = []
    for i, s in enumerate(sizes):
        by = sorted(range(k), key=lambda j: (-s[j], j))
        sums = [s[j] for j in by]
        trees.append((-(sums[0] - sums[-1]), next(order), sums, (i, by)))
    heapq.heapify(trees)
    while len(trees) > 1:
        _, _, a, x = heapq.heappop(trees)
        _, _, b, y = heapq.heappop(trees)
        joined = [a[j] + b[k - 1 - j] for j in range(k)]
        by = sorted(range(k), key=lambda j: (-joined[j], j))
        sums = [joined[j] for j in by]
        heapq.heappush(trees, (-(sums[0] - sums[-1]), next(order), sums, (x, y, by)))
    place: list[list[int]] = [[]] * len(sizes)
    todo = [(trees[0][3], list(range(k)))]  # a tree and where its parts, in descending order, end
    while todo:
        tree, ends = todo.pop()
        if len(tree) == 2:
            i, by = tree
            own = [0] * k
            for rank, j in enumerate(by):
                own[j] = ends[rank]
            place[i] = own
        else:
            x, y, by = tree
            of_joined = [0] * k
            for rank, j in enumerate(by):
                of_joined[j] = ends[rank]
            todo.append((x, of_joined))
            todo.append((y, of_joined[::-1]))
    return place


def text_key(text: Column) -> list[Column]:
    """Two 64-bit halves of the MD5 of a text; nulls have a key of their own."""
    digest = F.coalesce(F.md5(text), F.lit("0" * 32))
    return [F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("k1"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("k2")]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign_groups(groups: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, shard) for groups (k1, k2, size)."""
    n = groups.count()
    bins = max(1, -(-n // BIN))
    d = groups.withColumn("bin", F.pmod(F.xxhash64("k1", "k2"), F.lit(bins)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k1", "k2"], ascending=[False, True, True]).reset_index(drop=True)
        pdf["part"] = [p[0] for p in karmarkar_karp([[int(s)] + [0] * (shards - 1) for s in pdf["size"]])]
        return pdf[["k1", "k2", "size", "bin", "part"]]

    d = scratch.cut(d.groupBy("bin").applyInPandas(first, "k1 long, k2 long, size long, bin long, part int"), "bins")
    sums = d.groupBy("bin", "part").agg(F.sum("size").alias("size"))
    place = d.select("bin", "part").distinct().withColumn("shard", F.col("part"))
    while bins > 1:
        parts = sums.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("part", "size"))).alias("by"))
        above = -(-bins // BIN)
        parts = parts.select("bin", F.pmod("bin", F.lit(above)).alias("above"), F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.coalesce(F.try_element_at("by", j), F.lit(0).cast("long"))).alias("sums"))

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            at = karmarkar_karp([[int(v) for v in s] for s in pdf["sums"]])
            return pd.DataFrame([(b, j, a, p[j], int(s[j])) for b, a, s, p in zip(pdf["bin"], pdf["above"], pdf["sums"], at, strict=True) for j in range(shards)], columns=["bin", "part", "above", "to", "size"])

        step = scratch.cut(parts.groupBy("above").applyInPandas(combine, "bin long, part int, above long, to int, size long"), "level")
        sums = step.groupBy(F.col("above").alias("bin"), F.col("to").alias("part")).agg(F.sum("size").alias("size"))
        if "above" in place.columns:
            place = place.select(F.col("bin").alias("bin0"), F.col("part").alias("part0"), F.col("above").alias("bin"), F.col("shard").alias("part")).join(step.drop("size"), ["bin", "part"]).select(F.col("bin0").alias("bin"), F.col("part0").alias("part"), "above", F.col("to").alias("shard"))
        else:
            place = place.drop("shard").join(step.drop("size"), ["bin", "part"]).select("bin", "part", "above", F.col("to").alias("shard"))
        bins = above
    return d.select("k1", "k2", "bin", "part").join(place.select("bin", "part", "shard"), ["bin", "part"]).select("k1", "k2", F.col("shard").cast("int").alias("shard"))


def with_shards(rows: DataFrame, groups: DataFrame, shards: int, scratch: Scratch, out: str) -> DataFrame:
    """rows(k1, k2, ...) with the shard of their group (k1, k2, size, n); rows must be a table that is cheap to read twice."""
    place = scratch.cut(groups.join(assign_groups(groups.select("k1", "k2", "size"), shards, scratch), ["k1", "k2"]).select("k1", "k2", "n", F.col("shard").alias(out)), "place")
    return join_groups(rows, place, ["k1", "k2"], "n")


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, scratch: Scratch | None = None, out: str = "_shard", slot: str | None = None) -> DataFrame:
    """docs with out, the shard of the row's group of equal texts, and slot, its place in the shard, if that is named.

    Sizes are bytes of the text plus 1. The rows go along as one struct, so that none of their names can clash.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c not in (out, slot)]
    col = lambda c: F.col(f"row.`{c}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", *text_key(col(text)), size_of(col(text)).alias("size"), col(doc_id).alias("id"))
    groups = scratch.cut(rows.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    placed = with_shards(rows, groups, shards, scratch, "shard")
    if slot is not None:
        placed = with_slots(scratch.cut(placed.select("row", "id", "shard").withColumn("place", F.monotonically_increasing_id()), "placed"), shards)
    return placed.select(*[col(c).alias(c) for c in names], F.col("shard").alias(out), *([F.col("slot").alias(slot)] if slot else []))


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """rows(id, shard, place, ...) with slot, gapless from 0 in each shard; place is another number for each row.

    A shard's rows are dealt by a hash of their place into runs of about RUN rows, in which they are ordered by id; a run
    starts where those before it end.
    """
    runs = max(1, -(-rows.count() // (shards * RUN)))
    d = rows.withColumn("run", F.pmod(F.xxhash64("place", F.lit("slot")), F.lit(runs)))
    sizes = d.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "place")) - 1
    d = d.withColumn("own", own).join(starts, ["shard", "run"])
    return d.withColumn("slot", (F.col("start") + F.col("own")).cast("long")).drop("run", "own", "start", "place")


def op10_shard(spark, sf_dir: str) -> DataFrame:
    """Law: bytes, as near equal as indivisible groups of equal texts allow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    text = F.col("text")
    # digests in place of texts: what is read more than once is written first
    rows = scratch.cut(docs.select(F.col("doc_id").alias("id"), size_of(text).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), *text_key(text)), "sizes")
    groups = scratch.cut(rows.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    placed = scratch.cut(with_shards(rows, groups, 8, scratch, "shard").select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")), "placed")
    out = with_slots(placed, 8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
