"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed into BUCKETS. The raw model counts all documents, the target model the documents
that are given as examples (a bounded sample of them). A document's log weight is the sum of
log p_target - log p_raw over its n-grams: the logarithm of the ratio of both models' likelihoods. Adding Gumbel noise
hashed from the id and keeping the share with the largest sums draws a sample without replacement in proportion to the
weights. With ``center``, the mean of the log ratio under the target model is taken off for each n-gram, so that length
alone counts for nothing.

Defined results: a null or blank text has no n-grams and log weight 0; without examples all log weights are 0; of rows
tied at the last place, as repeated rows are, as many as needed are taken in the order of the written table; rows with a
null id share one noise; an empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.llm.mixing import uniform
from crowdnet.llm.words import U64, grams, slices, small_batches, unused, word_hashes
from crowdnet.scratch import Scratch

BUCKETS = 1 << 18
#: Added to every bucket of both models, which are scaled to the target's size first.
SMOOTH = 6.0
#: The target model is fitted on at most about this many examples.
EXAMPLES = 50_000
SHARE = 0.75


def buckets_of(texts: pa.Array) -> list[np.ndarray]:
    """The buckets of the words and of the pairs of words of each text."""
    h, at = word_hashes(texts)
    one, two = ((grams(h, n) & U64(BUCKETS - 1)).astype(np.int64) for n in (1, 2))
    return [np.concatenate([one[a:b], two[a : max(a, b - 1)]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _counts(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in slices(batches):
        own = buckets_of(b.column(0))
        raw += np.bincount(np.concatenate(own), minlength=BUCKETS)
        examples = [x for x, e in zip(own, b.column(1).to_pylist(), strict=True) if e]
        if examples:
            target += np.bincount(np.concatenate(examples), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, examples: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = EXAMPLES, center: bool = False) -> np.ndarray:
    """Log ratio by bucket. examples: ids of target documents; about limit of them are used, picked by a hash.

    The driver gets one row for each bucket at most.
    """
    ids = examples.select(F.col(doc_id).alias("example")).filter("example IS NOT NULL").distinct()
    n = ids.count()
    if n > limit:
        ids = ids.filter(F.pmod(F.xxhash64("example", F.lit("example")), F.lit(1_000_003)) < int(1_000_003 * limit / n))
    own = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"))
    marked = own.join(F.broadcast(ids), F.col("id") == F.col("example"), "left")  # about limit ids
    counts = marked.select("text", F.col("example").isNotNull().alias("e")).mapInArrow(_counts, "bucket int, raw long, target long")
    with small_batches(docs.sparkSession):
        got = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    raw *= target.sum() / raw.sum()  # both models get as much smoothing
    p_target, p_raw = (x + SMOOTH for x in (target, raw))
    p_target, p_raw = p_target / p_target.sum(), p_raw / p_raw.sum()
    ratio = np.log(p_target) - np.log(p_raw)
    return ratio - (p_target * ratio).sum() if center else ratio


def weigh(docs: DataFrame, table: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))

    def score(batches):
        own = shared.value
        for b in slices(batches):
            found = buckets_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([float(own[x].sum()) for x in found], pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, "doc_id long, n_grams long, log_weight double")


def top_share(weighed: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """weighed with gumbel_key and selected: the floor(share * rows) rows with the largest keys.

    The key of the last row is found from counts of its digits, three times, and then of the places of rows in the table
    that the keys are written to, so no task sorts rows and ties of any number are cut where they must be.
    """
    noise = -F.log(-F.log(F.greatest(uniform(F.lit(seed), F.col("doc_id")), F.lit(1e-16))))
    keyed = weighed.withColumn("gumbel_key", F.round(F.col("log_weight") + noise, 9))
    own = unused("row", keyed.columns)
    with small_batches(weighed.sparkSession):
        d = Scratch(weighed.sparkSession).cut(keyed.withColumn(own, F.monotonically_increasing_id()), "keys")
    whole = F.floor("gumbel_key")
    units = F.round((F.col("gumbel_key") - whole) * 1_000_000_000).cast("long")
    # the part and the place in it of the row, negated as the first ones are taken
    part, place = -F.shiftright(own, 33), -F.col(own).bitwiseAND(F.lit((1 << 33) - 1))
    levels = [whole, F.floor(units / 100_000), units % 100_000, part, F.floor(place / 100_000), F.pmod(place, F.lit(100_000))]
    k = int(share * d.count())
    if k <= 0:
        return d.withColumn("selected", F.lit(False)).drop(own)
    rows, chosen, tied = d, F.lit(False), F.lit(True)
    for level in levels:
        counts = rows.groupBy(level.alias("v")).agg(F.count("*").alias("n"))
        seen = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("v"))) - F.col("n"))  # one row for each level
        v, n, above = seen.filter((F.col("above") < k) & (F.col("above") + F.col("n") >= k)).select("v", "n", "above").first()
        k -= above
        chosen = chosen | (tied & (level >= v if n == k else level > v))
        if n == k:
            break
        tied = tied & (level == v)
        rows = rows.filter(level == v)
    return d.withColumn("selected", chosen).drop(own)


def op9_resample(spark, sf_dir: str) -> DataFrame:
    """Examples: documents labelled good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0")
    return top_share(weigh(docs, fit(docs, good)), SHARE, seed=9).select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), "selected")
