"""Semi and anti joins of wide rows with a set of ids, so that only rows whose id may be in the set are shuffled.

The ids are hashed into BITS bits, held as at most BITS / 64 rows of (slot, 64 bits): a bound that doesn't grow with the
input, which is why this table alone is broadcast. A row whose bit is unset is surely not in the set; the others are
joined with the ids themselves, so results are exact at every size, and more ids only mean more rows to shuffle.

An id is one column or several. Defined results: an id with a null is in no set; repeated rows and ids are as in a semi
or anti join; an empty set keeps no row of a semi join and every row of an anti join. Columns of rows keep names and
order; the prefix names the helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def _keys(key) -> list[Column]:
    return [F.col(f"`{k}`") if isinstance(k, str) else k for k in (key if isinstance(key, list | tuple) else [key])]


def _flagged(rows: DataFrame, key, ids: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Rows with <prefix>maybe and <prefix>key0, ..., and ids as <prefix>id0, ..."""
    slot, bit, word, maybe, place = (f"{prefix}{k}" for k in ("slot", "bit", "word", "maybe", "place"))
    keys = _keys(key)
    mine, own = ([f"{prefix}{k}{i}" for i in range(len(keys))] for k in ("key", "id"))
    ids = ids.select(*[F.col(f"`{c}`").cast("long").alias(o) for c, o in zip(ids.columns, own, strict=False)]).dropna().distinct()
    put = lambda d, by: d.withColumn(place, F.pmod(F.xxhash64(*by), F.lit(BITS))).withColumn(slot, F.floor(F.col(place) / 64).cast("long")).withColumn(bit, F.pmod(F.col(place), F.lit(64)).cast("int"))
    words = put(ids, own).groupBy(slot).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))).alias(word))
    marked = put(rows.withColumns({m: k.cast("long") for m, k in zip(mine, keys, strict=True)}), mine).join(F.broadcast(words), slot, "left")  # BITS / 64 rows at most
    there = F.call_function("shiftright", F.col(word), F.col(bit)).bitwiseAND(F.lit(1)) == 1
    return marked.select(*[F.col(f"`{c}`") for c in rows.columns], *mine, F.coalesce(there, F.lit(False)).alias(maybe)), ids


def _same(ids: DataFrame, prefix: str) -> Column:
    same = F.lit(True)
    for i in range(len(ids.columns)):
        same = same & (F.col(f"{prefix}key{i}") == F.col(f"{prefix}id{i}"))
    return same


def _own(d: DataFrame, rows: DataFrame) -> DataFrame:
    return d.select(*[F.col(f"`{c}`") for c in rows.columns])


def rows_maybe_in(rows: DataFrame, key, ids: DataFrame, prefix: str = "_in_") -> DataFrame:
    """All rows whose key is in the first columns of ids, and few others."""
    marked, _ = _flagged(rows, key, ids, prefix)
    return _own(marked.filter(f"{prefix}maybe"), rows)


def rows_in(rows: DataFrame, key, ids: DataFrame, prefix: str = "_in_") -> DataFrame:
    """The rows whose key is in the first columns of ids."""
    marked, ids = _flagged(rows, key, ids, prefix)
    return _own(marked.filter(f"{prefix}maybe").join(ids, _same(ids, prefix), "left_semi"), rows)


def rows_not_in(rows: DataFrame, key, ids: DataFrame, prefix: str = "_in_") -> DataFrame:
    """The rows whose key is not in the first columns of ids."""
    marked, ids = _flagged(rows, key, ids, prefix)
    some = marked.filter(f"{prefix}maybe").join(ids, _same(ids, prefix), "left_anti")
    return _own(marked.filter(f"NOT {prefix}maybe"), rows).union(_own(some, rows))
