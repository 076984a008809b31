"""All pairs of vectors in square tiles: a tile's two blocks of vectors meet in one task as two matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block, about, and the numbers in a block of long vectors.
TILE, CELLS = 256, 4_000_000


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as a matrix of their values."""
    column = column.combine_chunks()
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(column), -1)


def all_pairs(vectors: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], ordered: bool = False, tile: int = TILE) -> DataFrame:
    """(i, j, score) with i > j of vectors(gene, v): kernel takes two matrices of vectors and gives the scores of all their rows.

    A vector goes to as many tiles as there are blocks, so n vectors are n * n / tile rows in place of n * n pairs of
    vectors, and no task has more than about two blocks. Blocks of long vectors have fewer of them, about CELLS numbers. With ordered, the kernel's left rows are always the larger gene's.
    """
    gene = dict(vectors.dtypes)["gene"]
    n, longest = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(tile, CELLS // max(1, longest)))))
    d = vectors.select("gene", "v", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "gene", "v")

    def one(table: pa.Table) -> pa.Table:
        p, q, own = (table.column(c).to_numpy() for c in ("p", "q", "own"))
        left, right = np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0])
        v, genes = matrix(table.column("v")), table.column("gene").combine_chunks()
        if not len(left) or not len(right):  # a block may have no vector
            return pa.table({"i": genes[:0], "j": genes[:0], "score": pa.array([], pa.float64())})
        order = np.argsort(np.array(genes.to_pylist()), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        scores = kernel(v[left], v[right])
        below = rank[left][:, None] > rank[right]
        if p[0] == q[0]:
            a, b = np.nonzero(below)
            found = scores[a, b]
        else:
            a, b = (x.ravel() for x in np.indices(scores.shape))
            found = np.where(below, scores, kernel(v[right], v[left]).T).ravel() if ordered else scores.ravel()
        swap = ~below[a, b]
        i, j = np.where(swap, right[b], left[a]), np.where(swap, left[a], right[b])
        return pa.table({"i": genes.take(pa.array(i)), "j": genes.take(pa.array(j)), "score": pa.array(found, pa.float64(), from_pandas=True)})

    return d.groupBy("p", "q").applyInArrow(one, f"i {gene}, j {gene}, score double")


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T


def rows_of(net: DataFrame) -> DataFrame:
    """(gene, v): the rows of the symmetric matrix of net(i, j, score) over all its nodes, 0 where there is no edge."""
    both = net.select(F.col("i").alias("gene"), F.col("j").alias("other"), "score").union(net.select("j", "i", "score"))
    nodes = both.select("gene").distinct()
    every = nodes.agg(F.sort_array(F.collect_list("gene")).alias("nodes"))  # one row: as long as a row of the matrix
    own = both.groupBy("gene").agg(F.collect_list(F.struct("other", "score")).alias("e"))
    d = own.crossJoin(F.broadcast(every))
    none = F.transform(F.array_except("nodes", F.transform("e", lambda x: x["other"])), lambda o: F.struct(o.alias("other"), F.lit(0.0).alias("score")))
    return d.select("gene", F.transform(F.sort_array(F.concat("e", none)), lambda x: x["score"]).alias("v"))
