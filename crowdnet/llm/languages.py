"""Language identification by known words, with a backoff to character n-grams for unseen ones.

Training counts words by language on a bounded sample of labelled documents and keeps the most frequent ones, with the
n-grams of orders ORDERS among the words seen. A known word adds its log frequency in each language; an unseen word
adds the mean log frequency of its known n-grams of the longest order that has any. The score is the posterior of the
best language under even priors.

Defined results: a null text or one without a letter is ``und`` with score 0; words without any known n-gram say
nothing, and a text of such words gets the first language by name with an even score; ties go to the first language by
name; without training rows every text is ``und``; rows are judged one by one, so repeated rows agree; whole texts are
read however long they are; an empty table gives an empty table; other columns are carried along.
"""

import gc
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdnet.llm.membership import rows_not_in
from crowdnet.llm.words import slices, small_batches, unused
from crowdnet.scratch import Scratch

ORDERS = (4, 3, 2, 1)
#: Bounds of the training sample and of the model, whatever the size of the corpus.
TRAIN_DOCS_PER_LANG, KNOWN_WORDS, KNOWN_GRAMS, MOST_LANGS = 2_000, 60_000, 30_000, 200
FLUSH = 200_000
CACHED = 200_000
SMOOTH = 0.5
UND = "und"
WORD = re.compile(r"[^\W\d_]+")
COUNTS = "kind int, gram string, lang string, n long"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if nothing in them is a letter by Unicode's classes."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    ids: dict[str, int]
    grams: dict[int, dict[str, int]]
    table: np.ndarray  # a row of log frequencies for each word and n-gram, and a last row of zeros

    def scorer(self):
        return Scorer(self)


class Scorer(dict):
    """Row of scores by word; unseen words are scored once, as long as there is room for their rows."""

    def __init__(self, model: Model):
        super().__init__(model.ids)
        self.model, self.used = model, len(model.table)
        self.rows = np.concatenate([model.table, np.zeros((CACHED, len(model.langs)))])

    def learn(self, words: list[str]) -> None:
        """Rows for unseen words: the mean over the known n-grams of the longest order that has any."""
        none = len(self.model.table) - 1  # a row of zeros
        for n in ORDERS:
            table = self.model.grams.get(n)
            if not table or not words:
                continue
            lists = [grams_of(w, n) for w in words]
            flat = np.array([table.get(g, none) for x in lists for g in x] or [none], np.int64)
            starts = np.cumsum([0, *map(len, lists)])[:-1]
            starts, whole = np.minimum(starts, len(flat) - 1), np.fromiter(map(len, lists), np.int64, len(lists)) > 0
            known = np.add.reduceat((flat != none).astype(np.int64), starts) * whole
            means = np.add.reduceat(self.model.table[flat], starts, axis=0) / np.maximum(known, 1)[:, None]
            for i in np.flatnonzero(known).tolist():
                self[words[i]] = self.used
                self.rows[self.used] = means[i]
                self.used += 1
            words = [words[i] for i in np.flatnonzero(known == 0).tolist()]
        self.update(dict.fromkeys(words, none))

    def total(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            if self.used + len(new) > len(self.rows) or len(self) > 2 * len(self.rows):
                self.clear()
                self.update(self.model.ids)
                self.used = len(self.model.table)
                new = [w for w in dict.fromkeys(words) if w not in self]
            self.learn(new)
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def score(self, text: str | None) -> tuple[str, float]:
        langs, words = self.model.langs, words_of(text)
        if not words or not langs:
            return UND, 0.0
        total = sum(self.total(words[i : i + CACHED // 2]) for i in range(0, len(words), CACHED // 2))
        odds = np.exp(total - total.max())
        best = int(np.argmax(np.round(total, 9)))
        return langs[best], float(min(1.0, odds[best] / odds.sum()))


def _count(batches):
    counts: Counter = Counter()

    def out():
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "gram", "lang", "n"])
        counts.clear()

    seen: dict[str, Counter] = {}

    def fold():
        for lang, own in seen.items():
            for w, n in own.items():
                counts[0, w, lang] += n
                for k in ORDERS:
                    for g in grams_of(w, k):
                        counts[k, g, lang] += n
        seen.clear()

    for b in slices(batches):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, seen.values())) > FLUSH // 4:
            fold()
            yield from out()
    fold()
    yield from out()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_key: Column | None = None, docs_per_lang: int = TRAIN_DOCS_PER_LANG) -> Model:
    """A model of at most docs_per_lang documents of each language, give or take chance, picked by a hash of sample_key.

    Of more than MOST_LANGS languages the most frequent are learned, so a dirty column of labels can't fill the driver. The
    driver gets at most KNOWN_WORDS words and KNOWN_GRAMS n-grams of each order with their counts by language.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = {r[0]: r[1] for r in counts.limit(MOST_LANGS).collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((1, 0)))
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / sizes[k])))])
    key = F.pmod(F.xxhash64(sample_key if sample_key is not None else F.col(text), F.lit("train")), F.lit(1_000_003)) / 1_000_003.0
    picked = labelled.filter(key < F.try_element_at(share, F.col(lang))).select(text, lang)
    with small_batches(spark):
        counts = scratch.cut(picked.mapInArrow(_count, COUNTS).groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")), "counts")
    sums = {(r[0], r[1]): r[2] for r in counts.groupBy("kind", "lang").agg(F.sum("n")).collect()}
    by_gram = scratch.cut(counts.groupBy("kind", "gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("by")), "grams")
    ids, grams, rows = {}, {n: {} for n in ORDERS}, []
    for kind in (0, *ORDERS):
        top = by_gram.filter((F.col("kind") == kind) & (F.col("all") >= 2)).orderBy(F.desc("all"), "gram").limit(KNOWN_GRAMS if kind else KNOWN_WORDS).collect()
        size = np.array([sums.get((kind, x), 0) + SMOOTH * (len(top) + 1) for x in langs])
        for r in top:
            (grams[kind] if kind else ids)[r["gram"]] = len(rows)
            rows.append(np.log((np.array([r["by"].get(x, 0) for x in langs]) + SMOOTH) / size))
    return Model(langs, ids, grams, np.array([*rows, np.zeros(len(langs))]))


def identify(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the best language of each whole text and its posterior, in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = shared.value.scorer()
        gc.freeze()  # the model stays; collections needn't walk over it
        for part in parts:
            yield pd.DataFrame([scorer.score(t) for t in part], columns=["lang", "score"]).astype({"lang": object, "score": float})

    own = unused("langid", docs.columns)
    return docs.withColumn(own, predict(F.col(text))).withColumns({lang_out: F.col(f"{own}.lang"), score_out: F.col(f"{own}.score")}).drop(own)


def without_languages(docs: DataFrame, model: Model, least_score: float, text: str = "text", prefix: str = "_lang_") -> DataFrame:
    """docs without the rows that have no letter or no language of this score; prefix must not begin a column's name.

    Only texts go through Python; the rows that go are told by two hashes of their texts, as equal texts are judged alike.
    """
    key = [F.xxhash64(F.col(f"`{text}`")), F.xxhash64(F.lit("other"), F.col(f"`{text}`"))]
    judged = identify(docs.select(F.col(f"`{text}`").alias("text"), key[0].alias("k0"), key[1].alias("k1")), model)
    spark = docs.sparkSession
    with small_batches(spark):
        gone = Scratch(spark).cut(judged.filter((F.col("lang_pred") == UND) | (F.col("score") < least_score)).select("k0", "k1"), "rejected")
    return rows_not_in(docs, key, gone, prefix)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_key=F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
    with small_batches(spark):
        return Scratch(spark).cut(found, "languages")
