r"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are compared without case and without what isn't a letter or digit. The benchmark goes through in blocks of
bounded size, each as a broadcast index of its SEED-word sequences, against every document. Each seed in a document,
however common it is, proposes the passage around it for every item that holds it; every proposed passage is aligned
whole unless the words that the document or the passage shares with the item are too few for any alignment to reach
the threshold.

An item is found in a passage if the best local alignment (match 2, other word or gap -1) reaches least_score of the
item's own and least_words words of the alignment match (all words of shorter items).

Defined results: null or wordless texts and items match nothing; an item with fewer than SEED words is one seed as a
whole; a null item id is reported as null; repeated items are reported each; repeated rows get equal results; of several
passages of one item in a text each is reported; an empty table on either side gives no match; other columns are
carried along.
"""

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdnet.llm.membership import rows_not_in
from crowdnet.llm.words import CACHED_WORDS, U64, grams, mix64, slices, small_batches
from crowdnet.scratch import Scratch

SEED = 3
LEAST_SCORE, LEAST_WORDS = 0.5, 8
#: Bounds of one broadcast index.
BLOCK_WORDS, BLOCK_ITEMS = 1_000_000, 50_000
NOTHING, OTHER = -2, -1
MATCH = "array<struct<item_id:long,score:double,words:int,start:int,stop:int>>"


def plain(word: str) -> str:
    word = word.casefold()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


class WordIds(dict):
    """Id of a raw word in the benchmark's vocabulary; OTHER if it isn't there, NOTHING if no letter or digit is left."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.known = pa.array(list(vocabulary), pa.string())

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        p = plain(word)
        i = self[word] = self.vocabulary.get(p, OTHER) if p else NOTHING
        return i

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words with a letter or digit in all texts: ids, places among all words of their text, and texts.

        Every distinct word of the batch is looked up once: as an Arrow array if only ASCII letters and digits are left
        between its ASCII punctuation, else as a string.
        """
        parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words, owner = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        coded, owner = words.dictionary_encode(), owner[full]
        bare = pc.ascii_trim(coded.dictionary, characters=string.punctuation)
        simple = pc.ascii_is_alnum(bare)
        ids = pc.index_in(pc.ascii_lower(bare), value_set=self.known).fill_null(OTHER).to_numpy().astype(np.int64)
        others = coded.dictionary.filter(pc.invert(simple)).to_pylist()
        ids[~simple.to_numpy(zero_copy_only=False)] = np.fromiter(map(self.__getitem__, others), np.int64, len(others))
        ids = ids[coded.indices.to_numpy()[full]]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        at = np.flatnonzero(ids != NOTHING)
        return ids[at], place[at], owner[at]


def seeds_of(ids: np.ndarray, n: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of known words of one text and their places."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    known = ids >= 0
    ok = known[:m] & (owner[:m] == owner[n - 1 :])
    for k in range(1, n):
        ok &= known[k : k + m]
    at = np.flatnonzero(ok)
    if not len(at):
        return np.empty(0, U64), at
    return grams(mix64(ids.astype(U64)), n)[at], at


@dataclass
class Index:
    """Seeds of a block of items: sorted hashes, and the (item, place) pairs of each."""

    item_ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray
    first: np.ndarray
    of_item: np.ndarray
    place: np.ndarray
    lengths: list[int]


def build(rows: list[tuple]) -> Index:
    vocabulary: dict[str, int] = {}
    item_ids, items = [], []
    for item_id, text in rows:
        words = [p for w in (text or "").split() if (p := plain(w))]
        if words:
            item_ids.append(item_id)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64))
    found = []
    for i, ids in enumerate(items):
        n = min(SEED, len(ids))
        h, at = seeds_of(ids, n, np.zeros(len(ids)))
        found += [(int(k) ^ n if n < SEED else int(k), i, int(p)) for k, p in zip(h, at, strict=True)]
    found.sort()
    every = np.array([f[0] for f in found], U64)
    keys, first = np.unique(every, return_index=True)
    return Index(item_ids, items, vocabulary, keys, np.append(first, len(found)), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), sorted({min(SEED, len(x)) for x in items}))


def hits(index: Index, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of all seeds in a batch of texts."""
    seeds, places = [], []
    for n in index.lengths:
        h, at = seeds_of(ids, n, owner)
        if n < SEED:
            h = h ^ U64(n)
        k = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
        same = index.keys[k] == h
        seeds.append(k[same])
        places.append(at[same])
    return np.concatenate(seeds), np.concatenate(places)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (match 2, other word or gap -1) and the place after its last word."""
    best, stop = 0, 0
    row = np.zeros(len(passage) + 1, np.int64)
    ramp = np.arange(len(passage) + 1)
    for w in item:
        step = np.where(passage == w, 2, -1)
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        new[0] = 0
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, stop = int(row[k]), k
    return best, stop


def aligned_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Equal words on the path of a best alignment of the item with the whole passage, which begins and ends with one."""
    rows = [np.zeros(len(passage) + 1, np.int64)]
    ramp = np.arange(len(passage) + 1)
    for w in item:
        new = np.maximum(rows[-1] - 1, 0)
        np.maximum(new[1:], rows[-1][:-1] + np.where(passage == w, 2, -1), out=new[1:])
        rows.append(np.maximum.accumulate(new + ramp) - ramp)
    j, words = len(passage), 0
    i = int(np.argmax([r[j] for r in rows]))
    while i and j and rows[i][j]:
        equal = item[i - 1] == passage[j - 1]
        if rows[i][j] == rows[i - 1][j - 1] + (2 if equal else -1):
            words, i, j = words + int(equal), i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return words


def proposals(index: Index, seeds: np.ndarray, places: np.ndarray, present: np.ndarray, least_score: float, least_words: int) -> dict[int, set[int]]:
    """Where in a text items would start by its seeds; not those with too few words among the text's (present) to match."""
    n = index.first[seeds + 1] - index.first[seeds]
    k = np.repeat(index.first[seeds] - np.cumsum(n) + n, n) + np.arange(n.sum())
    order = np.argsort(index.of_item[k], kind="stable")
    item, start = index.of_item[k][order], (np.repeat(places, n) - index.place[k])[order]
    items, first = np.unique(item, return_index=True)
    out: dict[int, set[int]] = {}
    for i, own in zip(items.tolist(), np.split(start, first[1:]), strict=True):
        size = len(index.items[i])
        if np.count_nonzero(present[index.items[i]]) >= max(least_score * size, min(size, least_words)):
            out[i] = set(own.tolist())
    return out


def find(index: Index, proposed: dict[int, set[int]], ids: np.ndarray, at: np.ndarray, least_score: float, least_words: int) -> list[tuple]:
    """Matches of a text at these proposals."""
    out = []
    for i, starts in sorted(proposed.items()):
        item = index.items[i]
        size = len(item)
        slack = max(4, size // 3)
        need = max(least_score * size, min(size, least_words))
        spans: list[list[int]] = []
        for d in sorted(starts):
            lo, hi = max(0, d - slack), min(len(ids), d + size + slack)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        counts = Counter(item.tolist())
        while spans:
            lo, hi = spans.pop()
            passage = ids[lo:hi]
            own = Counter(passage.tolist())
            if sum(min(n, own[w]) for w, n in counts.items()) < need:
                continue
            score, stop = align(item, passage)
            if score < 2 * least_score * size:
                continue
            start = stop - align(item[::-1], passage[:stop][::-1])[1]
            words = aligned_words(item, passage[start:stop])
            if words >= min(size, least_words):
                out.append((index.item_ids[i], score / (2 * size), words, int(at[lo + start]), int(at[lo + stop - 1]) + 1))
            spans += [[lo, lo + start], [lo + stop, hi]]
    return out


def find_all(index: Index, cache: WordIds, texts: pa.Array, least_score: float, least_words: int) -> list[list[tuple]]:
    """Matches of each text of a batch."""
    ids, at, owner = cache.of(texts)
    seeds, places = hits(index, ids, owner)
    present = np.zeros(len(index.vocabulary), bool)
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    for k in np.unique(owner[places]):
        lo, hi = np.searchsorted(owner, [k, k + 1])
        own = owner[places] == k
        known = ids[lo:hi][ids[lo:hi] >= 0]
        present[known] = True
        proposed = proposals(index, seeds[own], places[own] - lo, present, least_score, least_words)
        present[known] = False
        out[k] = find(index, proposed, ids[lo:hi], at[lo:hi], least_score, least_words)
    return out


def blocks(bench: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """The items in blocks of about BLOCK_WORDS words and BLOCK_ITEMS items."""
    items = bench.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    n, words = items.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    count = max(-(-words // BLOCK_WORDS), -(-n // BLOCK_ITEMS))
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).orderBy("item", "text").collect()
        index = build([tuple(r) for r in rows])
        if index.items:
            yield index


def searcher(shared, least_score: float, least_words: int):
    """An Arrow UDF from texts to their matches."""

    @F.arrow_udf(T._parse_datatype_string(MATCH))
    def search(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        cache = WordIds(own.vocabulary)
        names = ("item_id", "score", "words", "start", "stop")
        kind = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True))))
        for part in parts:
            texts = (b.column(0) for b in slices([pa.RecordBatch.from_arrays([part], names=["text"])]))
            found = [ms for own_texts in texts for ms in find_all(own, cache, own_texts, least_score, least_words)]
            yield pa.array([[dict(zip(names, m, strict=True)) for m in ms] for ms in found], kind)

    return search


def contaminations(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "matches", least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the matches of every text: item, score, words in common, first word and the word after the last."""
    spark = docs.sparkSession
    found: Column = F.array().cast(MATCH)
    for index in blocks(bench, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)
        found = F.concat(found, searcher(shared, least_score, least_words)(F.col(text)))
    return docs.withColumn(out, found)


def without_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", prefix: str = "_leak_", **options) -> DataFrame:
    """docs without the rows that hold an item; prefix must not begin a column's name.

    Only texts go through Python; the rows that go are told by two hashes of their texts, as equal texts are judged alike.
    """
    key = [F.xxhash64(F.col(f"`{text}`")), F.xxhash64(F.lit("other"), F.col(f"`{text}`"))]
    found = contaminations(docs.select(F.col(f"`{text}`").alias("text"), key[0].alias("k0"), key[1].alias("k1")), bench, **options)
    spark = docs.sparkSession
    with small_batches(spark):
        gone = Scratch(spark).cut(found.filter(F.size("matches") > 0).select("k0", "k1"), "contaminated")
    return rows_not_in(docs, key, gone, prefix)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every passage of a document that holds a benchmark item, exact or edited."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminations(docs.select("doc_id", "text"), bench)
    found = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.round("m.score", 6).alias("score"), F.col("m.words").alias("words"), F.col("m.start").alias("start_word"), F.col("m.stop").alias("stop_word"))
    with small_batches(spark):
        return Scratch(spark).cut(found, "matches")
