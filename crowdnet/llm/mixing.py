"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated a Poisson number of times whose mean is the source's repetition rate
``target share * total / documents of the source``. The draw inverts the distribution at a uniform number hashed from
the seed and the document's id, so it is the same on every run and for every dealing of the rows; copies are exploded
and dealt in the order of a hash of seed, id and copy, which is a global shuffle: as the hash is evenly distributed, its
ranges are known beforehand and no pass over the rows is needed to find them.

Defined results: a null source counts as the empty string; rows with a null id share one draw, and so do repeated rows
(each is repeated by it); sources without a weight get ``default_weight``, weights of absent sources are ignored; a
weight of 0 drops a source; an empty table gives an empty table; other columns are carried along whatever they are called,
except that columns with the names of the three outputs are replaced (``prefix`` chooses other names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of rates with more sources than this is joined by a shuffle.
BROADCAST_SOURCES = 20_000
HEX, KEY_HEX = 13, 15


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from parts: 52 bits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, HEX)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**HEX))


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, default_weight: float | None, power: float, total: float | None) -> DataFrame:
    """(source, n, rate): weights where given, else n ** power (1 keeps the mix as it is, 0 makes it even)."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    if weights is not None:
        given = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        w = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(1.0 if default_weight is None else float(default_weight)))
    counts = counts.select("source", "n", w.alias("w"))
    sums = counts.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    whole = F.col("n_all").cast("double") if total is None else F.lit(float(total))
    return counts.crossJoin(F.broadcast(sums)).select("source", "n", F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all") * whole / F.col("n")).otherwise(0.0).alias("rate"))  # one row


def _cumulated(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until what is left is beyond a uniform number's 52 bits."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.array(F.exp(-rate)).alias("c"), F.exp(-rate).alias("p"))
    step = lambda s, k: F.struct(F.concat(s["c"], F.array(_last(s["c"]) + s["p"] * rate / k)).alias("c"), (s["p"] * rate / k).alias("p"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


#: Above this rate, whole parts are added of this mean each, so that exp(-rate) stays far from 0.
PART = 64


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, default_weight: float | None = None, power: float = 0.5, total: float | None = None, seed: int = 0, prefix: str = "") -> DataFrame:
    """docs with each row as often as drawn, plus <prefix>rate, <prefix>copy (from 0) and <prefix>shuffle_key, in the order of the last.

    Rates above PART are drawn as the sum of several independent Poisson counts, which has the same distribution.
    """
    table = rates(docs, source, weights, default_weight, power, total)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = table.withColumn("parts", parts).withColumn("cdf", _cumulated(F.col("rate") / F.col("parts")))
    table = table.select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "rate", "parts", "cdf")])
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # the rows go along as one struct, so that none of their names can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", F.coalesce(F.col(f"row.`{source}`"), F.lit("")).alias("own_source"), F.col(f"row.`{doc_id}`").alias("id")).join(table, F.col("own_source") == F.col("mix_source"))
    drawn = lambda k: F.size(F.filter("mix_cdf", lambda c: c <= uniform(F.lit(seed), F.col("id"), k)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("mix_parts") - 1), F.lit(0), lambda s, k: s + drawn(k))
    d = d.withColumn("u", uniform(F.lit(seed), F.col("id"), F.lit(0)))
    one = F.size(F.filter("mix_cdf", lambda c: c <= F.col("u")))
    d = d.withColumn("n", F.when(F.col("mix_parts") == 1, one).otherwise(count)).filter("n > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy"))), 1, KEY_HEX), 16, 10).cast("long")
    made = {f"{prefix}rate": F.col("mix_rate"), f"{prefix}copy": F.col("copy").cast("long"), f"{prefix}shuffle_key": F.col("key")}
    d = d.withColumn("key", key).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made], *[c.alias(k) for k, c in made.items()])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = F.floor(F.col(f"{prefix}shuffle_key") / F.lit(float(16**KEY_HEX)) * parts).cast("int")
    return d.repartitionById(parts, ranges).sortWithinPartitions(f"{prefix}shuffle_key")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    """Shares in proportion to the square root of a source's size, as many documents as before in expectation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs, power=0.5, seed=17)
    return out.select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), "copy", "shuffle_key")


_TERMS = 60
assert math.exp(-PART) > 0

ORACLE = f"""
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER () * CAST(sum(n) OVER () AS DOUBLE) / n AS rate FROM c),
pmf AS (SELECT s, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM w, range({_TERMS}) t(k)),
cdf AS (SELECT s, rate, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM pmf),
u AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|0'), 1, {HEX}) AS BIGINT) AS DOUBLE) / {float(16**HEX)} AS u FROM documents),
n AS (SELECT doc_id, source, text, rate, count(*) FILTER (c <= u) AS n FROM (SELECT row_number() OVER () AS row, * FROM u) d JOIN cdf ON coalesce(d.source, '') = cdf.s GROUP BY row, doc_id, source, text, rate)
SELECT doc_id, source, text, round(rate, 9) AS rate, CAST(copy AS BIGINT) AS copy,
  CAST('0x' || substr(md5('17|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, {KEY_HEX}) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(n)) AS copy FROM n)
"""
