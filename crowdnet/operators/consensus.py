"""Fusing ranked networks: one union and one shuffle on (i, j) in place of a chain of outer joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdnet.operators.ranking import midrank, unity


def irp(k: int, pairs: float) -> Column:
    """Inverse rank product: missing ranks count as the last possible one."""
    return F.sum(1 + F.log10("rank")) + (k - F.count("rank")) * (1 + F.log10(F.lit(float(pairs))))


def borda(k: int, pairs: float) -> Column:
    return F.avg("rank")


def top1(k: int, pairs: float) -> Column:
    return F.min("rank")


def top2(k: int, pairs: float) -> Column:
    """Mean of the two best ranks; null with fewer than two."""
    two = F.slice(F.sort_array(F.collect_list("rank")), 1, 2)
    return F.when(F.count("rank") >= 2, (F.get(two, F.lit(0)) + F.get(two, F.lit(1))) / 2)


AGGREGATORS: dict[str, Callable[[int, float], Column]] = {"irp": irp, "borda": borda, "top1": top1, "top2": top2}


def direction_vote() -> Column:
    ab, ba = F.count_if(F.col("direction") == 1), F.count_if(F.col("direction") == 2)
    return F.when(ab > 2 * ba, 1).when(ba > 2 * ab, 2).otherwise(0)


def _best(k: int) -> Column:
    """The direction of the network with the k-th best rank, by name among equal ranks."""
    return F.get(F.sort_array(F.collect_list(F.struct("rank", "alg", "direction"))), F.lit(k))["direction"]


def method_direction(method: str, first: str | None) -> Column:
    """irp votes; top1 takes the best network's direction, top2 that of both best ones if they agree, borda the first network's."""
    if method == "top1":
        return _best(0)
    if method == "top2":
        return F.when(_best(0) == _best(1), _best(0)).otherwise(0)
    if method == "borda" and first is not None:
        return F.coalesce(F.max(F.when(F.col("alg") == first, F.col("direction"))), F.lit(0))
    return direction_vote()


def aggregate(networks: DataFrame, method: str, k: int, nodes: int, digits: int = 9, first: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(i, j, direction, value, rank, score) of the long networks (alg, i, j, direction, rank).

    first names the network whose directions borda takes (a vote without it); keep adds each of these networks' directions
    as d_<name>, and for top1 and top2 the names of the best networks as t1 and t2. Values are equal if they agree in digits
    decimals; a relative tolerance isn't transitive, so it can't be a key of a shuffle.
    """
    value = F.round(AGGREGATORS[method](k, nodes * (nodes - 1) / 2), digits)
    tags = []
    if keep is not None:
        named = lambda n: F.get(F.sort_array(F.collect_list(F.struct("rank", "alg"))), F.lit(n))["alg"]
        tags = [named(n).alias(f"t{n + 1}") for n in range({"top1": 1, "top2": 2}.get(method, 0))]
        tags += [F.max(F.when(F.col("alg") == a, F.col("direction"))).alias(f"d_{a}") for a in keep]
    fused = networks.groupBy("i", "j").agg(method_direction(method, first).alias("direction"), value.alias("value"), *tags).filter("value IS NOT NULL")
    out = unity(midrank(fused, "value"), "rank", "score")
    return out.select("i", "j", "direction", "value", "rank", "score", *[c for c in fused.columns if c not in ("i", "j", "direction", "value")])


def best_two(networks: DataFrame) -> DataFrame:
    """(i, j, t1, t2): the algorithms with the best and second best rank, by name among equal ranks."""
    two = F.sort_array(F.collect_list(F.struct("rank", "alg")))
    return networks.groupBy("i", "j").agg(two.alias("s")).select("i", "j", F.get("s", F.lit(0))["alg"].alias("t1"), F.get("s", F.lit(1))["alg"].alias("t2"))
