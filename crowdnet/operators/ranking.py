"""Canonical edges, tie-aware midranks and import of directed weights as a ranked network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.scratch import Scratch

#: Two scores are equal if they differ by this share of the larger one at most (fixed value).
TOLERANCE = 1e-9


def almost_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * TOLERANCE


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """i > j, and direction 1 if the edge ran from i to j, 2 if from j to i; self loops are dropped."""
    out = df.filter(F.col(a) != F.col(b))
    keep = [c for c in df.columns if c not in (a, b)]
    return out.select(F.greatest(a, b).alias("i"), F.least(a, b).alias("j"), F.when(F.col(a) > F.col(b), 1).otherwise(2).alias("direction"), *keep)


def midrank(df: DataFrame, value: str, by: list[str] | None = None, ascending: bool = True, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with the midrank of value within by (the whole table without by); null values get no rank.

    Ties are collapsed by a partial aggregation, the distinct values are range-partitioned and counted through once
    with an offset for each range, and the ranks are joined back, so no task sorts the whole network.
    """
    by = by or []
    spark = df.sparkSession
    scratch = Scratch(spark)
    df = scratch.cut(df, "edges")  # read twice below
    key = F.col(value) if ascending else -F.col(value)
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_k", key)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = scratch.cut(c.repartitionByRange(p, *by, "_k").withColumn("_p", F.spark_partition_id()), "values")
    totals = c.groupBy("_p").agg(F.sum("_n").alias("_t"))  # a row for each range
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    c = c.join(F.broadcast(offsets), "_p").withColumn("_c", F.col("_o") + F.sum("_n").over(Window.partitionBy("_p").orderBy(*by, "_k")))
    if by:
        firsts = c.groupBy(*by).agg(F.min(F.col("_c") - F.col("_n")).alias("_s"))
        c = c.join(firsts, by)
    else:
        c = c.withColumn("_s", F.lit(0))
    ranks = c.select(*by, value, (F.col("_c") - F.col("_s") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, least: dict[str, str] | None = None, place: str | None = None) -> DataFrame:
    """df with running sums and minima of columns (by output name) and the place from 1, all in ascending order of columns.

    The rows are range-partitioned and gone through once in each range, with what stands before it from a row for each
    range, so no task goes through the whole table. A value may be shared by many rows only if later columns tell them
    apart.
    """
    spark = df.sparkSession
    sums, least = sums or {}, least or {}
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = Scratch(spark).cut(df.repartitionByRange(p, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = d.groupBy("_p").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()], *[F.min(c).alias(f"_m_{o}") for o, c in least.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums], *[F.min(f"_m_{o}").over(before).alias(f"_m_{o}") for o in least])
    within = Window.partitionBy("_p").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(offsets), "_p").select(
        *df.columns,
        *([(F.col("_n") + F.row_number().over(within)).alias(place)] if place else []),
        *[(F.col(f"_s_{o}") + F.coalesce(F.sum(c).over(so_far), F.lit(0))).alias(o) for o, c in sums.items()],
        *[F.least(F.col(f"_m_{o}"), F.min(c).over(so_far)).alias(o) for o, c in least.items()],
    )
    return out


def import_edges(raw: DataFrame, a: str = "a", b: str = "b", weight: str = "w", by: list[str] | None = None, absolute: bool = False, reverse: bool = False, drop_zero: bool = False, undirected: bool = False) -> DataFrame:
    """Ranked network (by..., i, j, direction, score, rank) of directed weights.

    Of a pair's two directions the better weight stays (the larger with reverse, else the smaller); equal weights make
    the edge undirected. absolute ranks by absolute weights.
    """
    by = by or []
    if drop_zero:
        raw = raw.filter(F.abs(weight) > 0)
    best = F.max if reverse else F.min
    side = lambda k: best(F.when(F.col("direction") == k, F.col(weight)))
    d = canonical(raw.select(*by, a, b, weight), a, b).groupBy(*by, "i", "j").agg(side(1).alias("w1"), side(2).alias("w2"))
    score = F.greatest("w1", "w2") if reverse else F.least("w1", "w2")
    direction = F.when(F.col("w1") == F.col("w2"), 0).when(F.col("w1") == score, 1).otherwise(2)
    d = d.select(*by, "i", "j", (F.lit(0) if undirected else direction).alias("direction"), score.alias("score"))
    if absolute:
        return midrank(d.withColumn("_abs", F.abs("score")), "_abs", by, not reverse).drop("_abs")
    return midrank(d, "score", by, not reverse)


def unity(df: DataFrame, value: str, out: str) -> DataFrame:
    """1 - (x - min) / (max - min) over the whole table; 1 where all values are equal."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_hi") == F.col("_lo")
    return df.crossJoin(F.broadcast(span)).withColumn(out, F.when(flat, 1.0).otherwise(1 - (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")  # span has one row
