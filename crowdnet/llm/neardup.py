r"""Near-duplicate documents by MinHash bands, verification on full shingle sets and connected components.

1. Each whole text becomes the set of its distinct word shingles, ``bands * rows`` minima of universal hashes of the
   set, and one key a band; rows and bands are chosen so that a pair at the threshold is missed with a probability
   below MISS. The nodes of the graph are the different sets: rows with equal sets are one node from here on.
2. In each bucket, all members are paired with the smallest only, which links a group of copies in linear work.
   Pairs pass a test of sizes and of signatures (a byte of each minimum; six standard deviations below the threshold),
   and are then confirmed on the full sets.
3. Where the members of a bucket still belong to different components, every member outside the bucket's largest
   component is compared with all others, block by block: a pair is confirmed on its full sets in the block of the
   first band that it shares, and only links that join two components of the block leave it.
   So no candidate pair of a bucket goes unexamined, no bucket is capped, and no pair is a row but links.
4. Components by alternating large-star and small-star.

Defined results: a null or blank text has no shingles, links with nothing and is its own component; a row with a null
id gets a null component and is kept; repeated rows get equal results; rows of one id with different texts are judged
by their texts, each for itself; ties don't occur, as the smallest id decides; whole texts are read however long they
are; an empty table gives an empty table; columns other than the id and the text are ignored. Ids are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdnet.llm.hot import join_groups
from crowdnet.llm.membership import rows_in, rows_maybe_in, rows_not_in
from crowdnet.llm.words import U64, list_column, mix64, shingle_sets, slices, small_batches
from crowdnet.operators.components import components
from crowdnet.scratch import Scratch

MISS, MOST_HASHES, LEAST_HASHES = 1e-6, 360, 128
#: Members and shingles of a block of a bucket, about; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Rows that blocks are packed to for a group of one task.
PACK = 1024
FEATURES = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest rows that keep the chance to miss a pair at the threshold below MISS."""
    if not 1 <= percent <= 100:
        raise ValueError("a similarity in percent is asked for, from 1 to 100")
    best = None
    for rows in range(1, 17):
        share = (percent / 100) ** rows
        bands = 1 if share == 1 else math.ceil(math.log(MISS) / math.log1p(-share))
        if rows * bands > MOST_HASHES:
            break
        best = (rows, bands)
    if best is None:
        raise ValueError(f"{MOST_HASHES} minima can't find pairs of {percent} % with a chance of {1 - MISS}")
    return best


def hashes(rows: int, bands: int) -> int:
    """The minima of a text, and so the bytes of its signature."""
    return max(rows * bands, LEAST_HASHES)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each non-empty run of values, the minima of n hashes a * x + b."""
    a, b = _multipliers(n)
    x = (values >> U64(32)).astype(np.uint32)
    out = np.empty((n, len(starts)), np.uint32)
    y = np.empty_like(x)
    for k in range(n):
        np.multiply(x, a[k], out=y)
        np.add(y, b[k], out=y)
        np.minimum.reduceat(y, starts, out=out[k])
    return out.T


def _features(shingle: int, rows: int, bands: int):
    def run(batches):
        n = hashes(rows, bands)
        salts = mix64(np.arange(1, bands + 1, dtype=U64))
        for batch in slices(batches):
            sets = shingle_sets(batch.column(2), shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys, signs = np.empty((0, bands), U64), np.empty((0, n), np.uint8)
            if len(full):
                m = minima(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), n)
                signs = np.ascontiguousarray(m >> 7).astype(np.uint8)
                own = m[:, : rows * bands].astype(U64).reshape(len(full), bands, rows)
                keys = np.broadcast_to(salts, (len(full), bands)).copy()
                for j in range(rows):
                    keys = mix64(keys + own[:, :, j])
            row = dict(zip(full.tolist(), range(len(full)), strict=True))
            d1, d2 = digests(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(sizes),
                    pa.array(d1),
                    pa.array(d2),
                    pa.array([signs[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
                    list_column(keys.view(np.int64).ravel(), np.where(sizes > 0, bands, 0).tolist(), pa.int64()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "signature", "bands"],
            )

    return run


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each set."""
    found = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    return tuple(np.array([(d >> k) & (2**64 - 1) for d in found], U64).view(np.int64) for k in (0, 64))


def _sets(shingle: int):
    """From (node, d1, d2, text) to (node, shingles) of the texts whose set is the one asked for."""

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(3), shingle)
            d1, d2 = digests(sets)
            same = np.flatnonzero((d1 == batch.column(1).to_numpy()) & (d2 == batch.column(2).to_numpy())).tolist()
            own = [sets[i] for i in same]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), list_column(np.concatenate([np.empty(0, U64), *own]).view(np.int64), [len(s) for s in own], pa.int64())], names=["node", "shingles"])

    return run


def least_matches(percent: int) -> int:
    """Equal bytes that the signatures of a pair at the threshold have, less six standard deviations."""
    p, n = percent / 100, hashes(*banding(percent))
    return math.floor(n * p - 6 * math.sqrt(n * p * (1 - p)))


@F.pandas_udf(T.IntegerType())
def _matches(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=np.int32)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[at[i] : at[i + 1]] for i in range(len(column))]


def linked(part: dict[str, np.ndarray], key: int, percent: int, least: int) -> list[tuple[int, int]]:
    """Links that join two components, between the left and the right members of a bucket's blocks.

    A pair of which both are on the left somewhere is compared from the smaller node, and each only where key is the
    first band that the pair shares.
    """
    left, right = np.flatnonzero(part["left"]), np.flatnonzero(~part["left"])
    if not len(left) or not len(right):
        return []
    comp, node, both = part["component"].copy(), part["node"], part["minor"][right]
    signs, bands = part["signs"][right], part["bands"][right]
    sets, n = [part["shingles"][i].view(U64) for i in right], part["n_shingles"][right]
    out = []
    for i in left[np.argsort(node[left], kind="stable")]:
        k, u = int(part["n_shingles"][i]), int(node[i])
        fit = np.flatnonzero((comp[right] != comp[i]) & (100 * np.minimum(n, k) >= percent * np.maximum(n, k)) & (~both | (node[right] > u)))
        fit = fit[(signs[fit] == part["signs"][i]).sum(axis=1) >= least]
        if not len(fit):
            continue
        fit = fit[bands[fit, (bands[fit] == part["bands"][i]).argmax(axis=1)] == key]
        mine = np.sort(part["shingles"][i].view(U64))
        for v in fit.tolist():
            if comp[right[v]] == comp[i]:
                continue
            common = int((mine[np.minimum(np.searchsorted(mine, sets[v]), k - 1)] == sets[v]).sum())
            if 100 * common >= percent * (k + int(n[v]) - common):
                out.append((u, int(node[right[v]])))
                comp[comp == comp[right[v]]] = comp[i]
    return out


class _Run:
    def __init__(self, docs: DataFrame, shingle: int, percent: int):
        self.docs, self.shingle, self.percent = docs, shingle, percent
        self.scratch = Scratch(docs.sparkSession)

    def sizes_fit(self, x: str, y: str):
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def sets_of(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in the only column, from the texts."""
        need = self.scratch.cut(classes.join(nodes, "node", "left_semi").select("node", "rep", F.col("d1").alias("e1"), F.col("d2").alias("e2")), "need")
        texts = rows_maybe_in(self.docs, "doc_id", need.select("rep"))
        found = texts.join(need, F.col("doc_id") == F.col("rep")).select("node", "e1", "e2", "text").mapInArrow(_sets(self.shingle), "node long, shingles array<long>")
        sets = self.scratch.cut(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # repeated rows
        self.scratch.drop(need)
        return sets

    def confirmed(self, pairs: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are as similar as asked for."""
        side = lambda k: reps.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(self.sizes_fit("n_a", "n_b"))
        near = near.filter(_matches("s_a", "s_b") >= least_matches(self.percent)).select("a", "b", "n_a", "n_b")
        near = self.scratch.cut(near, "near")
        sets = self.sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), classes)
        both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = self.scratch.cut(both.filter(100 * common >= self.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "links")
        self.scratch.drop(sets, near)
        return out

    def rest(self, shared: DataFrame, parts: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame | None:
        """Links between the components of a bucket that the pairs with its smallest member left apart."""
        m = shared.select("key", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        m = members = self.scratch.cut(m, "members")
        # buckets of two have been compared
        wide = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2").select("key", "n")
        wide = self.scratch.cut(wide, "wide")
        m = self.scratch.cut(join_groups(m, wide, ["key"], "n").join(reps.select("node", "n_shingles"), "node"), "open")
        self.scratch.drop(members, wide)
        if m.isEmpty():
            return None
        by_part = m.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
        sizes = by_part.groupBy("key").agg(F.sum("n").alias("size"), F.sum("shingles").alias("shingles"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("major"))
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        sizes = sizes.select("key", "size", "major", blocks.alias("right_blocks"), F.ceil((F.col("size") - F.col("most")) * blocks / F.col("size")).cast("int").alias("left_blocks"))
        m = join_groups(m, self.scratch.cut(sizes, "sizes"), ["key"], "size").withColumn("minor", F.col("component") != F.col("major")).drop("major")
        at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        names = ["key", "node", "component", "minor", "left", "i", "j"]
        left = m.filter("minor").withColumns({"left": F.lit(True), "i": at("left_blocks", "left"), "j": every("right_blocks")}).select(*names)
        right = m.withColumns({"left": F.lit(False), "j": at("right_blocks", "right"), "i": every("left_blocks")}).select(*names)
        dealt = self.scratch.cut(left.union(right), "dealt")
        packs = -(-dealt.count() // PACK)
        sets = self.sets_of(m.select("node").distinct(), classes)
        full = reps.select("node", "n_shingles", "signature", "bands").join(sets, "node")
        d = dealt.withColumn("pack", F.pmod(F.xxhash64("key", "i", "j"), F.lit(packs))).join(full, "node")
        percent, least = self.percent, least_matches(self.percent)

        def compare(table: pa.Table) -> pa.Table:
            flat = {k: table.column(k).to_numpy() for k in ("key", "i", "j", "node", "component", "minor", "left", "n_shingles")}
            flat["signs"] = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            flat["bands"], sets = np.stack(_lists(table.column("bands"))), _lists(table.column("shingles"))
            order = np.lexsort((flat["j"], flat["i"], flat["key"]))
            keys = np.stack([flat[k][order] for k in ("key", "i", "j")])
            links = []
            for own in np.split(order, np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1):
                part = {k: v[own] for k, v in flat.items()} | {"shingles": [sets[i] for i in own]}
                links += linked(part, int(part["key"][0]), percent, least)
            return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

        links = self.scratch.cut(d.groupBy("pack").applyInArrow(compare, "a long, b long"), "links")
        self.scratch.drop(sets, dealt)
        return links

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """All rows' features, and (d1, d2, node, rep, component) of every set; rep is the smallest id of the set's rows."""
        rows, bands = banding(self.percent)
        found = self.docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_features(self.shingle, rows, bands), FEATURES)
        features = self.scratch.cut(found.withColumn("row", F.monotonically_increasing_id()), "features")
        full = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        # a node is the number of one row of its set; the written table keeps these numbers
        classes = self.scratch.cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("node")), "classes")
        reps = full.join(classes.select("node"), full["row"] == classes["node"], "left_semi")
        reps = self.scratch.cut(reps.select(F.col("row").alias("node"), "n_shingles", "signature", "bands"), "reps")
        keys = reps.select("node", F.explode("bands").alias("key"))
        centers = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("n"))
        centers = self.scratch.cut(centers.filter("center < last").select("key", "center", "n"), "centers")
        shared = self.scratch.cut(join_groups(keys, centers, ["key"], "n"), "shared")
        star = shared.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
        links = self.confirmed(star, reps, classes)
        parts = self.scratch.cut(components(links, self.scratch), "parts")
        more = self.rest(shared, parts, reps, classes)
        if more is not None and not more.isEmpty():
            parts = self.scratch.cut(components(links.union(more), self.scratch), "parts")
        self.scratch.drop(shared, reps)
        known = self.scratch.cut(classes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "known")
        least = self.scratch.cut(known.groupBy("part").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "least")
        return features, join_groups(known, least, ["part"], "n")

    def result(self) -> DataFrame:
        with small_batches(self.docs.sparkSession):
            features, classes = self.graph()
        out = features.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "component"), ["d1", "d2"], "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def others(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, text_hash) of the rows that aren't the first of their component, and of firsts that are repeated."""
        with small_batches(self.docs.sparkSession):
            features, classes = self.graph()
        rows = features.select("doc_id", "text_hash", "d1", "d2", "row").filter("doc_id IS NOT NULL").join(classes.select("d1", "d2", "part"), ["d1", "d2"])
        rows = self.scratch.cut(rows.groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
        first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("size"))
        rows = join_groups(rows, self.scratch.cut(first, "first"), ["part"], "size").withColumn("is_first", F.struct("doc_id", "text_hash") == F.col("first"))
        rows = self.scratch.cut(rows.select("doc_id", "text_hash", "n", "is_first"), "firsts")
        return rows.filter("NOT is_first").select("doc_id", "text_hash"), rows.filter("is_first AND n > 1").select("doc_id", "text_hash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: its links have 100 * common >= percent * united shingles."""
    return _Run(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle, percent).result()


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, prefix: str = "_dedup_") -> DataFrame:
    """The rows of docs of which one of each component stays: that of smallest id, then of smallest hash of its text.

    Of rows with equal id and text one stays, if they have words. prefix names helpers and must not begin a column's name.
    """
    run = _Run(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle, percent)
    gone, repeated = run.others()
    key = [F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))]
    kept = rows_not_in(docs, key, gone, prefix)
    if repeated.isEmpty():
        return kept
    own = rows_in(docs, key, repeated, prefix).withColumn(f"{prefix}hash", key[1]).dropDuplicates([doc_id, f"{prefix}hash"]).drop(f"{prefix}hash")
    return rows_not_in(kept, key, repeated, prefix).unionByName(own)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
