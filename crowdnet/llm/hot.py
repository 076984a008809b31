"""Joins with a table of groups of which a few may hold a large part of all rows.

A shuffle by the group would put all rows of a group into one task. Groups of more than HOT rows, and of more than one in
HOT_GROUPS of all rows, are broadcast instead; by that bound there are fewer than HOT_GROUPS of them, whatever the input's
size. The others are joined by a shuffle. No row is dropped either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT, HOT_GROUPS = 50_000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups(keys, size, ...), a written table with a row for each group; how is inner or left_semi.

    rows should be cheap to read twice; the column size doesn't go along.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    most = max(HOT, total // HOT_GROUPS)
    hot, cold = groups.filter(F.col(size) > most).drop(size), groups.filter(F.col(size) <= most).drop(size)
    if hot.isEmpty():
        return rows.join(cold, keys, how)
    hot = F.broadcast(hot)  # fewer than HOT_GROUPS rows
    return rows.join(hot, keys, "left_anti").join(cold, keys, how).unionByName(rows.join(hot, keys, how))
