r"""Quality rules with thresholds learned from mergeable quantile sketches, in Spark expressions only.

A word is a run of characters other than \x20 and \x09 to \x0D. The base rules are fixed; the others compare a
document with fences of its language and source. The sketch is log-linear: a value keeps its top SKETCH_BITS bits, and
the counts of these buckets add up, so sketches of groups merge into those of languages and of the whole corpus; a
quantile is read with a relative error under 2 ** (1 - SKETCH_BITS) and is the same however the rows are dealt.

Defined results: a null text has no words and fails the base rules; a null language or source counts as the empty
string; groups with fewer than LEAST_ROWS good documents use the sketch of their language, and such languages that of
the corpus (without any such documents, nothing is fenced off); repeated rows are judged one by one; an empty table
gives an empty table; columns other than the named ones are ignored. Windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdnet.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SKETCH_BITS = 6
LEAST_ROWS = 100
#: Groups whose fences are broadcast, and the parts that a group is joined in if there are more.
BROADCAST_GROUPS, SALTS = 20_000, 64
#: A fence stands this many inter-quartile ranges above the upper quartile (and below the lower one for "both").
FENCE = 3
#: Measure: (numerator, denominator, scale, least inter-quartile range in that scale, tail).
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, 20_000, "upper"),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, 150_000, "upper"),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, 100_000, "upper"),
    "word_chars": ("word_chars", "n_words", 1_000, 500, "both"),
}


def _repeated() -> Column:
    """Words covered by 3-word windows that occur twice or more; sorted is the array of (hash, index)."""
    twice = F.filter("sorted", lambda x, k: F.coalesce(F.get(F.col("sorted"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("sorted"), k + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"]))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumns(
        {
            "words": F.filter(F.split("t", f"{SPACE}+"), lambda x: x != ""),
            "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)),
            "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    d = d.select("doc_id", "lang", "source", "n_symbols", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    triple = F.transform("words", lambda x, i: F.when(i + 2 < F.size("words"), F.xxhash64(x, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))))
    d = d.withColumn("windows", F.when(F.col("n_words") >= 4, F.slice(triple, 1, F.greatest(F.size("words") - 2, F.lit(1)))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("n_repeat_words", _repeated().cast("long")).drop("words", "windows", "sorted")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _value(num: str, den: str, scale: int) -> Column:
    return F.expr(f"(({num} * {scale}L) div greatest({den}, 1L))")


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of documents that pass the base rules; the counts of equal buckets add up."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), _value(*m[:3]).alias("v")) for k, m in MEASURES.items()])
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("x")).select("lang", "source", "x.*")
    kept = f"shiftleft(shiftright(v, {_cut_sql()}), {_cut_sql()})"
    return rows.select("lang", "source", "measure", F.expr(kept).alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _cut_sql() -> str:
    return f"greatest(length(bin(v)) - {SKETCH_BITS}, 0)"


def _fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of by with its number of documents and its fences."""
    merged = counts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    buckets = merged.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

    def quantile(num: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        return F.aggregate("b", start, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["at"], F.when(4 * (s["seen"] + x["n"]) >= num * F.col("total"), x["bucket"])).alias("at")), lambda s: s["at"])

    q = buckets.select(*by, "measure", "total", quantile(1).alias("q1"), quantile(3).alias("q3"))
    least = F.create_map(*[F.lit(v) for k, m in MEASURES.items() for v in (k, m[3])])
    width = FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("long"))
    q = q.select(*by, "measure", "total", (F.col("q3") + width).alias("upper"), (F.col("q1") - width).alias("lower"))
    picked = [F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}") for k, m in MEASURES.items() for side in (("upper", "lower") if m[4] == "both" else ("upper",))]
    return q.groupBy(*by).agg(F.max("total").alias("total"), *picked)


def _names() -> list[str]:
    return [f"{k}_{side}" for k, m in MEASURES.items() for side in (("upper", "lower") if m[4] == "both" else ("upper",))]


def _with_fences(measured: DataFrame, table: DataFrame) -> DataFrame:
    """measured with the fences of each row's group, without shuffling a large group into one task.

    Up to BROADCAST_GROUPS groups are broadcast; more of them are joined by a shuffle in which every group is SALTS parts.
    """
    table = Scratch(measured.sparkSession).cut(table, "fences")
    if table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return measured.join(F.broadcast(table), ["lang", "source"], "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"], "left").drop("salt")


def judge(measured: DataFrame) -> DataFrame:
    """measured with kept: false for base failures and for documents beyond a fence of their group."""
    # written first: a filter on a measure would otherwise be pushed below the projections that make it
    measured = Scratch(measured.sparkSession).cut(measured, "measured")
    counts = sketch(measured)
    near, wide, all_ = _fences(counts, ["lang", "source"]), _fences(counts, ["lang"]), _fences(counts.withColumn("every", F.lit(1)), ["every"]).drop("every")
    ren = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}" if c not in ("lang", "source") else c) for c in df.columns])
    table = ren(near, "a").join(ren(wide, "b"), "lang").crossJoin(F.broadcast(ren(all_, "c")))  # the last has one row at most
    chosen = [F.when(F.col("a_total") >= LEAST_ROWS, F.col(f"a_{c}")).when(F.col("b_total") >= LEAST_ROWS, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}")).alias(c) for c in _names()]
    table = table.select("lang", "source", *chosen)
    d = _with_fences(measured, table)
    fine = F.lit(True)
    for k, m in MEASURES.items():
        fine = fine & F.coalesce(_value(*m[:3]) <= F.col(f"{k}_upper"), F.lit(True))
        if m[4] == "both":
            fine = fine & F.coalesce(_value(*m[:3]) >= F.col(f"{k}_lower"), F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & fine)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judge(measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_value(m: tuple) -> str:
    return f"(({m[0]} * {m[2]}) // greatest({m[1]}, 1))"


def _oracle() -> str:
    unions = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {_sql_value(m)} AS v FROM m WHERE NOT base_failed" for k, m in MEASURES.items())
    least = "CASE measure " + " ".join(f"WHEN '{k}' THEN {m[3]}" for k, m in MEASURES.items()) + " END"

    def level(name: str, by: str) -> str:
        cols = f"{by}," if by else ""
        part = f"PARTITION BY {cols} measure"
        return f"""
{name}_c AS (SELECT {cols} measure, bucket, sum(n) AS n FROM counts GROUP BY {cols} measure, bucket),
{name}_q AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS seen, sum(n) OVER ({part}) AS total FROM {name}_c),
{name}_f AS (SELECT {cols} measure, max(total) AS total, min(bucket) FILTER (4 * seen >= total) AS q1, min(bucket) FILTER (4 * seen >= 3 * total) AS q3 FROM {name}_q GROUP BY {cols} measure),
{name} AS (SELECT *, q3 + {FENCE} * greatest(q3 - q1, {least}) AS hi, q1 - {FENCE} * greatest(q3 - q1, {least}) AS lo FROM {name}_f)"""

    tests = " OR ".join(f"(measure = '{k}' AND ({_sql_value(m)} > hi" + (f" OR {_sql_value(m)} < lo" if m[4] == "both" else "") + "))" for k, m in MEASURES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rw USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
vals AS ({unions}),
counts AS (SELECT lang, source, measure, CAST((v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS BIGINT) AS bucket, count(*) AS n FROM vals GROUP BY ALL),
{level('near', 'lang, source')},
{level('wide', 'lang')},
{level('whole', '')},
fence AS (SELECT near.lang, near.source, near.measure,
  CASE WHEN near.total >= {LEAST_ROWS} THEN near.hi WHEN wide.total >= {LEAST_ROWS} THEN wide.hi ELSE whole.hi END AS hi,
  CASE WHEN near.total >= {LEAST_ROWS} THEN near.lo WHEN wide.total >= {LEAST_ROWS} THEN wide.lo ELSE whole.lo END AS lo
  FROM near JOIN wide ON near.lang = wide.lang AND near.measure = wide.measure JOIN whole ON near.measure = whole.measure),
bad AS (SELECT DISTINCT m.doc_id FROM m JOIN fence USING (lang, source) WHERE {tests})
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad USING (doc_id)
"""


ORACLE = _oracle()
