import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crowdnet.llm import chat, decontaminate, hot, languages, mixing, neardup, passages, quality, resample, sharding, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    base = [sentence(rng, 80) for _ in range(12)]
    rows = [(i, t, "ab"[i % 2], f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "a", "s0", 1), (21, base[0] + " extra", None, None, None), (22, None, "a", "s1", 0), (23, "", "b", None, 0), (24, "   \n\t ", "a", "s2", 6)]
    rows += [(25, sentence(rng, 30_000), "b", "s0", None), (None, base[3], "a", "s1", 3), (3, base[3], "b", "s0", 3), (26, "one two", "a", "s0", 7), (27, "!!! 123", "a", "s0", 7)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({"n_words": F.lit(-1), "bands": F.lit("x"), "_mix": F.lit(2), "label": F.col("text")})


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# chat


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be <|turn|> brief"), (1, 1, "user", "a\\b <|end|>"), (1, 2, "user", "again </s>"), (1, 3, "assistant", "[INST] \\\\ é😀 <|"), (1, 40, "assistant", ""),
        (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "who"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, None, "user", "first"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(df)
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["formatted"], r["loss_runs"]) for r in chats.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got[1][0] == [(r, t) for c, _, r, t in turns if c == 1]
    assert got[2][0] == [("assistant", ""), ("", "x")] and got[None][0] == [("user", "who")]
    assert got[3][0] == [("user", "first"), ("user", "a"), ("user", "b")] and got[3][1].count(chat.TURN) == 1
    for _, formatted, runs in got.values():
        assert sum(r["chars"] for r in runs) == len(formatted)
    at, loss = 0, []
    for r in got[1][2]:
        loss += [got[1][1][at : at + r["chars"]]] * r["loss"]
        at += r["chars"]
    assert loss == ["[\\INST] \\\\\\\\ é😀 <\\|", ""]
    d = {r["conv_id"]: r for r in chat.digest(chats).collect()}[1]
    assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in turns if c == 1).encode()).hexdigest()
    assert (d["n_turns"], d["loss_chars"]) == (5, len("[INST] \\\\ é😀 <|"))
    assert chat.format_chats(df.filter("conv_id = 99")).count() == 0
    # the loss text is cut from the formatted one by the runs' counts: shifted runs give another text
    moved = chats.withColumn("loss_runs", F.transform("loss_runs", lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), r["loss"].alias("loss"))))
    assert {r["conv_id"]: r for r in chat.digest(moved).collect()}[1]["loss_sha256"] != d["loss_sha256"]


def test_an_empty_table_still_has_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (r,) = chat.op1_chat(spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    assert (r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (-7, 2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_long_conversations_and_equal_turns(spark):
    rng = random.Random(4)
    turns = [(1, k, rng.choice(["user", "assistant"]), f"é{k}\\ <|end|> 😀") for k in range(400)] + [(2, None, "assistant", f"t{k:03}") for k in range(150)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.masked(chats).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    for c in (1, 2):
        own = [(r, t) for k, _, r, t in turns if k == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        assert got[c]["loss"] == "".join(t for r, t in own if r == "assistant")
    assert got[2]["formatted"].count(chat.TURN) == 1


# languages


def test_languages_on_held_out_rows_and_odd_cases(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 40, "abcdef" if i % 2 else "uvwxyz"), "ab"[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(d.filter("doc_id < 150"), sample_key=F.col("doc_id"))
    got = languages.identify(d.filter("doc_id >= 150"), model).collect()
    assert all(r["lang_pred"] == {"b": "b", "a": "a"}[r["lang"]] and 0.99 < r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in languages.identify(odd_docs, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (22, 23, 24, 27)) and odd[0]["label"] is not None
    hostile = d.withColumns({"_langid": F.lit(5), "langid": F.lit(6), "lang_pred": F.lit("mine")})
    r = languages.identify(hostile, model).first()
    assert (r["_langid"], r["langid"]) == (5, 6) and r["lang_pred"] in ("a", "b")
    empty = languages.fit(no_docs)
    assert {r["lang_pred"] for r in languages.identify(odd_docs, empty).collect()} == {"und"}


def test_language_scores_match_a_plain_loop():
    table = np.log(np.array([[0.6, 0.1], [0.1, 0.5], [0.3, 0.2], [0.2, 0.4]]))
    model = languages.Model(["x", "y"], {"foo": 0}, {4: {" bar": 1}, 1: {"b": 2, "q": 3}}, np.vstack([table, np.zeros(2)]))
    total = table[0] + table[1] + table[3]  # known word, longest known n-gram, single letter
    want = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    lang, score = model.scorer().score("foo barn q")
    assert (lang, round(score, 9)) == ("xy"[int(total.argmax())], round(float(want.max()), 9))


def test_a_fitted_model_matches_plain_counts(spark, monkeypatch):
    rows = [(0, "Foo foo bar", "x"), (1, "foo qux qux", "y"), (2, "bar Bar", "y"), (3, "zzz", "rare"), (4, None, "x"), (5, "foo", None), (6, "foo", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(languages, "MOST_LANGS", 2)
    model = languages.fit(d)
    assert model.langs == ["x", "y"]
    seen = {lang: " ".join(t.lower() for _, t, k in rows if k == lang and t).split() for lang in "xy"}
    counts = {w: [seen[lang].count(w) for lang in "xy"] for w in ("foo", "bar", "qux")}
    assert set(model.ids) == set(counts)
    for w, n in counts.items():
        want = [np.log((n[k] + 0.5) / (len(seen[lang]) + 0.5 * (len(counts) + 1))) for k, lang in enumerate("xy")]
        assert np.allclose(model.table[model.ids[w]], want)
    grams_ = {lang: [g for w in seen[lang] for g in languages.grams_of(w, 3)] for lang in "xy"}
    known = {g for lang in "xy" for g in grams_[lang] if sum(grams_[k].count(g) for k in "xy") >= 2}
    assert set(model.grams[3]) == known
    for g in known:
        want = [np.log((grams_[lang].count(g) + 0.5) / (len(grams_[lang]) + 0.5 * (len(known) + 1))) for lang in "xy"]
        assert np.allclose(model.table[model.grams[3][g]], want)


# quality


def test_quality_measures_match_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of a in $x") for _ in range(n)) + "\nline\nline\n \nline" for n in (0, 1, 2, 3, 4, 60, 200)] + ["a b c a b c", "x " * 70, "a b c d\na b c"]
    d = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.measure(d).collect()}
    for i, t in enumerate(texts):
        w = t.encode().split()
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
    odd = quality.judge(quality.measure(odd_docs))
    assert odd.count() == odd_docs.count() and odd.filter("kept IS NULL").count() == 0
    assert quality.judge(quality.measure(no_docs)).count() == 0
    want = sorted(map(tuple, odd.select("doc_id", "n_words", "kept").collect()), key=str)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 1)
    assert sorted(map(tuple, quality.judge(quality.measure(odd_docs)).select("doc_id", "n_words", "kept").collect()), key=str) == want


# decontamination


def test_decontamination_finds_edited_copies(spark, odd_docs, no_docs):
    rng = random.Random(4)
    items = [(k, sentence(rng, 30)) for k in range(5)] + [(9, None), (10, ""), (11, "?!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    edited = w[:7] + ["zzzz"] + w[8:15] + w[16:24] + ["yyyy"] + w[24:]
    docs = [(0, sentence(rng, 50) + " " + items[1][1].upper() + "! " + sentence(rng, 50)), (1, " ".join(["xx"] * 20 + edited + ["xx"] * 9)), (2, sentence(rng, 100)), (3, " ".join(w[:10])), (4, None), (5, items[2][1] + " mid dle " + items[2][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["m"]["item_id"], r["m"]["start"], r["m"]["stop"]) for r in decontaminate.contaminations(d, bench).select("doc_id", F.explode("matches").alias("m")).collect()]
    assert sorted(got) == [(0, 1, 50, 80), (1, 0, 20, 20 + len(edited)), (5, 2, 0, 30), (5, 2, 32, 62)]
    assert decontaminate.contaminations(odd_docs, bench).filter("size(matches) > 0").count() == 0
    assert decontaminate.contaminations(no_docs, bench).count() == 0 and decontaminate.contaminations(d, bench.limit(0)).filter("size(matches) > 0").count() == 0


def test_edited_items_are_found_however_many_documents_hold_them(spark):
    rng = random.Random(40)
    item = sentence(rng, 40).split()
    edited = " ".join("zzzzzzzzz" if k % 5 == 4 else w for k, w in enumerate(item))
    docs = spark.createDataFrame([(k, f"{sentence(rng, 30)} {edited} {sentence(rng, 30)}") for k in range(60)], "doc_id long, text string")
    got = decontaminate.contaminations(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(len(r["matches"]), r["matches"][0]["start"]) for r in got if r["matches"]] == [(1, 30)] * 60


def test_all_passages_of_an_item_in_a_text_are_found(spark):
    rng = random.Random(41)
    item = sentence(rng, 40).split()
    edited = ["zzzzzzzzz" if k % 5 == 4 else w for k, w in enumerate(item)]
    gap = ["yyyyyyyyy"] * 4
    docs = [(0, edited[:39] + gap + item), (1, item + gap + edited[:39]), (2, edited[:39] + gap + item + gap + edited[:39])]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    got = {r["doc_id"]: sorted((m["start"], m["stop"]) for m in r["matches"]) for r in decontaminate.contaminations(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: [(0, 39), (43, 83)], 1: [(0, 40), (44, 83)], 2: [(0, 39), (43, 83), (87, 126)]}


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i in range(9):
            for j in range(14):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_matches_are_those_of_full_alignments(spark):
    """Every text against every item, aligned over the whole of both."""
    rng = random.Random(41)
    items = [(k, sentence(rng, rng.randrange(4, 30)).split()) for k in range(8)]
    docs = []
    for k in range(60):
        words_ = sentence(rng, rng.randrange(0, 30)).split()
        for _ in range(rng.randrange(0, 3)):
            part = list(rng.choice(items)[1])
            lo = rng.randrange(0, len(part) // 2 + 1)
            part = part[lo : lo + rng.randrange(3, len(part) + 1)]
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "zz"
            words_ += part + sentence(rng, rng.randrange(0, 10)).split()
        docs.append((k, words_))

    def best(item, text):
        """Score, aligned words and the longest run of equal words on the path."""
        h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        top, i, j = max((h[i][j], i, j) for i in range(len(item) + 1) for j in range(len(text) + 1))
        same = run = longest = 0
        while h[i][j]:
            if h[i][j] == h[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1):
                same, run = (same + 1, run + 1) if item[i - 1] == text[j - 1] else (same, 0)
                longest, i, j = max(longest, run), i - 1, j - 1
            elif h[i][j] == h[i - 1][j] - 1:
                i, run = i - 1, 0
            else:
                j, run = j - 1, 0
        return top, same, longest

    found = decontaminate.contaminations(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {(r["doc_id"], m["item_id"]): max(x["score"] for x in r["matches"] if x["item_id"] == m["item_id"]) for r in found.collect() for m in r["matches"]}
    want = {}
    for k, text in docs:
        for i, item in items:
            score, same, longest = best(item, text)
            if score >= len(item) and same >= min(len(item), decontaminate.LEAST_WORDS) and longest >= min(3, len(item)):
                want[k, i] = score / (2 * len(item))
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_aligned_words_are_counted_on_the_path():
    assert decontaminate.aligned_words(np.array([1, 2, 3, 4]), np.array([1, 2, 9, 3, 4])) == 4
    assert decontaminate.aligned_words(np.array([1, 2, 3, 4, 5]), np.array([1, 2, 8, 4, 5])) == 4
    assert decontaminate.aligned_words(np.array([5, 1, 2, 3, 7]), np.array([1, 2, 3])) == 3


# near duplicates


def brute_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    docs = []
    for _ in range(6):
        base = sentence(rng, 120).split()
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = sentence(rng, 1)
            docs.append(" ".join(t))
    docs += ["", None, "one", "one", "one two", "A b C", "a B c", " "]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PACK", 10)
    monkeypatch.setattr(hot, "HOT", 3)
    monkeypatch.setattr(hot, "HOT_GROUPS", 10**9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for n, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d, shingle=n, percent=percent).collect()}
        assert got == brute_components(docs, n, percent)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[20]["component_id"] == 0 and by[21]["component_id"] == 0 and by[22]["component_id"] == 22 and by[22]["n_shingles"] == 0
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_repeated_rows_and_of_one_id_with_two_texts(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    near = a + " more"
    rows = [(1, a)] * 20 + [(2, near)] * 20 + [(5, a), (5, b), (6, b + " end"), (7, c), (7, c + " too")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "d1": F.lit(2)})
    got = sorted(tuple(r) for r in neardup.near_duplicates(d, shingle=3, percent=85).select("doc_id", "component_id", "kept").collect())
    assert got == sorted([(1, 1, True)] * 20 + [(2, 1, False)] * 20 + [(5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)])
    stay = neardup.without_near_duplicates(d, shingle=3, percent=85)
    assert stay.columns == d.columns
    stay = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert len(stay) == 3 and {(1, a), (5, b)} < set(stay) and sum(i == 7 for i, _ in stay) == 1


def test_bands_for_every_similarity():
    for percent in range(4, 101):
        rows, bands = neardup.banding(percent)
        assert rows * bands <= neardup.MOST_HASHES and (1 - (percent / 100) ** rows) ** bands <= neardup.MISS
    for percent in (0, 1, 3, 101):
        with pytest.raises(ValueError):
            neardup.banding(percent)


# mixing


def test_mixing_means_and_odd_rows(spark, odd_docs, no_docs):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise("small").alias("source"))
    out = mixing.mix(d, weights={"big": 3.0, "small": 1.0}, total=6000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 4500) < 4 * 4500**0.5 and abs(n["small"] - 1500) < 4 * 1500**0.5
    assert out.collect() == mixing.mix(d.repartition(7), weights={"big": 3.0, "small": 1.0}, total=6000).collect()
    many = mixing.mix(d.limit(50), weights={}, total=50 * 200)
    assert abs(many.count() - 10_000) < 500  # rates above PART
    assert set(odd_docs.columns) < set(mixing.mix(odd_docs).columns) and mixing.mix(no_docs).count() == 0
    hostile = odd_docs.withColumns({c: F.lit(103) for c in ("_mix_n", "mix_source", "n", "u", "key", "row", "id", "own_source", "rate", "copy", "_mix_u")})
    got = mixing.mix(hostile, seed=2, prefix="p_")
    assert got.columns == [*hostile.columns, "p_rate", "p_copy", "p_shuffle_key"] and got.filter("_mix_n <> 103 OR n <> 103 OR rate <> 103 OR key <> 103").count() == 0
    plain = mixing.mix(odd_docs, seed=2)
    assert sorted(map(str, got.select(*plain.columns[:-3], "p_copy").collect())) == sorted(str(r).replace(", copy=", ", p_copy=") for r in plain.drop("rate", "shuffle_key").collect())
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)


# WARC


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    trap = f"x{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(k, f"http://e/{k}", t) for k, t in enumerate(["", None, "plain", trap, trap + warc.MAGIC, "é\r\n\r\n😀" * 50, "plain", warc.MAGIC, trap * 3, "x" * 200_000])] + [(None, None, "lost"), (5, "http://e/5", "é\r\n\r\n😀" * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    path = str(tmp_path / "warc")
    warc.write_warc(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(pages)
    full = {r["digest"]: bytes(r["payload"]) for r in got if r["type"] == "response"}
    by_id = {r["id"]: r for r in got}
    assert "<urn:page:666>" not in by_id
    for k, _, t in pages:
        r = by_id[f"<urn:page:{'null' if k is None else k}>"]
        assert full[r["digest"]] == (t or "").encode()
    assert by_id["<urn:page:6>"]["type"] == "revisit" and by_id["<urn:page:6>"]["refers_to"] == "<urn:page:2>"
    warc.write_warc(df.limit(0), path + "0")
    assert warc.read_warc(spark, path + "0").count() == 0


# passages


def test_compact_windows_cover_every_run_once():
    rng = np.random.default_rng(3)
    keys = rng.permutation(np.arange(1, 61, dtype=np.uint64) * np.uint64(1 << 40))
    a, c, b = passages.compact_windows(keys, np.array([0, 25]), np.array([25, 60]), 6)
    for lo, hi in ((0, 25), (25, 60)):
        for i in range(lo, hi):
            for j in range(i + 5, hi):
                inside = [k for k in range(len(a)) if a[k] <= i <= c[k] <= j <= b[k]]
                assert len(inside) == 1 and c[inside[0]] == i + int(np.argmin(keys[i : j + 1]))


def test_repeated_passages(spark, odd_docs, no_docs):
    rng = random.Random(6)
    p, short = sentence(rng, 60), sentence(rng, 20)
    docs = [(k, f"{sentence(rng, 30 + k)} {p} {sentence(rng, 40)}") for k in range(5)] + [(k, f"{sentence(rng, 90)} {short} {sentence(rng, 40)}") for k in range(5, 9)] + [(9, None), (10, p)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 4, 10}
    assert all(r["start_word"] == 30 + r["doc_id"] and r["stop_word"] == 90 + r["doc_id"] for r in got if r["doc_id"] < 5)
    assert all(r["similarity"] == 1 for r in got)
    assert {0, 20, 21} <= {r["doc_id"] for r in passages.repeated_passages(odd_docs).collect()}
    assert passages.repeated_passages(no_docs).count() == 0


def shared_passages(a, b):
    x, y = words.text_grams(pa.array([" ".join(t) for t in (a, b)]), passages.SHINGLE)
    (own, _, c, _), (other, *_) = (passages.halves(t, np.array([0]), np.array([len(t)])) for t in (x, y))
    found, _ = passages.passages_of(x, y, c[np.isin(own, other)], passages.LEAST_SIMILARITY)
    return sorted((s[0], s[1] + passages.SHINGLE - 1) for s in found)


def test_passages_side_by_side_are_found_in_texts(spark):
    rng = random.Random(62)
    p, q = sentence(rng, 60), sentence(rng, 60)
    docs = [(0, f"{p} {sentence(rng, 100)} {q}"), (1, f"{p} {sentence(rng, 8)} {q}")]
    got = {(r["doc_id"], r["start_word"], r["stop_word"]) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(0, 0, 60), (0, 160, 220), (1, 0, 60), (1, 68, 128)}


def test_passages_side_by_side_are_found_each():
    rng = random.Random(60)
    for gap, other in ((8, 100), (0, 100), (8, 40)):
        p, q = sentence(rng, 60).split(), sentence(rng, 60).split()
        x = p + sentence(rng, gap).split() + q
        assert shared_passages(x, p + sentence(rng, other).split() + q) == [(0, 60), (60 + gap, 120 + gap)]


def test_passages_with_an_edit_are_found():
    rng = random.Random(61)
    for n in (50, 60):
        for k in range(n):
            p = sentence(rng, n).split()
            edited = p[:k] + ["zzzzzzzzz"] + p[k + 1 :]
            a, b = (sentence(rng, 30).split() + t + sentence(rng, 30).split() for t in (p, edited))
            ((start, stop),) = shared_passages(a, b)
            assert stop - start >= 50 and start <= 31 + 4 and stop >= 29 + n - 4


def test_a_passage_with_an_edit_near_its_start_is_found_in_texts(spark):
    rng = random.Random(63)
    docs = []
    for k in range(12):
        p = sentence(rng, 60).split()
        docs += [(2 * k + e, " ".join([*sentence(rng, 40).split(), *p[:15], "zzzzzzzzz" if e else p[15], *p[16:], *sentence(rng, 40).split()])) for e in (0, 1)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["start_word"], r["stop_word"]) for r in got} == {(40, 100)} and len({r["doc_id"] for r in got}) >= 20


@pytest.mark.parametrize(("whole", "part"), [(60, 45), (70, 48), (56, 40), (70, 40)])
def test_exact_repeats_are_found_beside_smaller_parts(spark, whole, part):
    """Two texts with a passage, and two of smaller ids that hold overlapping parts of it."""
    rng = random.Random(whole + part)
    docs = []
    for k in range(150):
        p = sentence(rng, whole).split()
        for j, words_ in enumerate((p[:part], p[-part:], p, p)):
            docs.append((4 * k + j, " ".join([*sentence(rng, 30).split(), *words_, *sentence(rng, 30).split()])))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    group = {r["doc_id"]: r["group_id"] for r in got}
    assert all(4 * k + 2 in group and group[4 * k + 2] == group[4 * k + 3] for k in range(150))
    assert all(group[4 * k + 2] // 4 == k for k in range(150))


@pytest.mark.parametrize("large", [4, 1_024])
def test_edited_repeats_are_found_beside_many_smaller_parts(spark, large, monkeypatch):
    """A passage and one with an edit, which only resemble each other, and eight texts of smaller ids with parts of it."""
    monkeypatch.setattr(passages, "LARGE", large)
    rng = random.Random(91)
    docs = []
    for k in range(60):
        p, at = sentence(rng, 60).split(), rng.randrange(60)
        parts = [p[a : a + 38] for a in (rng.randrange(0, 23) for _ in range(8))]
        for j, words_ in enumerate((*parts, p, p[:at] + ["zzzzzzzzz"] + p[at + 1 :])):
            docs.append((10 * k + j, " ".join([*sentence(rng, 30).split(), *words_, *sentence(rng, 30).split()])))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    group = {r["doc_id"]: r["group_id"] for r in got}
    assert [k for k in range(60) if 10 * k + 8 not in group or group[10 * k + 8] != group.get(10 * k + 9)] == []
    assert all(group[k] // 10 == k // 10 for k in group)


def test_a_group_of_repeated_words_needs_few_comparisons(monkeypatch):
    """Runs of one word that cross from one to the next: places in a group are many, and most pairs resemble each other in one shingle only."""
    rng, rows = random.Random(5), []
    for doc in range(8):
        runs = [rng.choice(("z", f"a{rng.randrange(30)}", f"b{doc}")) for _ in range(20)]
        x = words.text_grams(pa.array([" ".join(w for r in runs for w in [r] * rng.randrange(25, 40))]), passages.SHINGLE)[0].astype(np.uint32).view(np.int32)
        z = words.text_grams(pa.array(["z z z z z"]), passages.SHINGLE)[0].astype(np.uint32).view(np.int32)[0]
        for c in np.flatnonzero(x == z)[::12].tolist():
            lo = max(0, c - passages.AROUND)
            rows.append((1, doc, 1, c, c - lo, x[lo : c + passages.AROUND + 1].tolist()))
    names = ["key", "doc_id", "open", "place", "at", "around"]
    table = pa.table([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=names)
    pairs = [(a, b) for a in rows for b in rows if a[1] != b[1]]
    similar = [(a, b) for a, b in pairs if passages.passage_at(np.array(a[5]), np.array(b[5]), a[4], passages.LEAST_SIMILARITY, [], b[4])]
    calls, compare = [], passages.passage_at
    monkeypatch.setattr(passages, "passage_at", lambda *x: calls.append(1) or compare(*x))
    got = passages._links(passages.LEAST_SIMILARITY)(table).to_pylist()
    assert {(a[1], a[3]) for a, _ in similar} <= {(r["doc_id"], r["place"]) for r in got}
    assert {r["doc_id"] for r in got} <= {a[1] for pair in similar for a in pair}
    assert similar and len(calls) < len(pairs) / 20


def test_runs_of_one_word_are_grouped_by_their_ends():
    """All texts have a run of one word, which alone is no reason to compare them; similar ones are still found."""
    rng, texts = random.Random(12), []
    for _ in range(60):
        a, b, n = f"a{rng.randrange(8)}", f"b{rng.randrange(8)}", rng.randrange(25, 60)
        texts.append((a, b, n, words.text_grams(pa.array([" ".join([a] * rng.randrange(8, 30) + ["z"] * n + [b] * rng.randrange(8, 30))]), passages.SHINGLE)[0]))
    found, groups, windows = [], {}, []
    for k, (_, _, _, x) in enumerate(texts):
        key, _, c, _ = passages.halves(x, np.array([0]), np.array([len(x)]))
        found.append((key, c))
        windows.append({frozenset(x[i : i + passages.LEAST].tolist()) for i in range(len(x) - passages.LEAST + 1)})
        for i in key.tolist():
            groups.setdefault(i, set()).add(k)
    for own in groups.values():
        left, right, n = zip(*(texts[k][:3] for k in own), strict=True)
        assert len(set(left)) == 1 or len(set(right)) == 1 or min(n) >= passages.LEAST_WORDS
    similar = [(i, j) for i in range(60) for j in range(i) if any(len(x & y) >= 0.8 * len(x | y) for x in windows[i] for y in windows[j])]
    for i, j in similar:
        (key, c), (other, _) = found[i], found[j]
        assert passages.passages_of(texts[i][3], texts[j][3], c[np.isin(key, other)], passages.LEAST_SIMILARITY, True)[0]
    assert 100 < len(similar) < 1_000


def test_long_runs_of_one_word_are_reported(spark):
    rng = random.Random(13)
    docs = [(k, " ".join([*sentence(rng, 30).split(), *["z"] * n, *sentence(rng, 30).split()])) for k, n in enumerate((40, 55, 300, 200, 49))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {k: {w for r in got if r["doc_id"] == k for w in range(r["start_word"], r["stop_word"])} for k in range(5)}
    assert {r["group_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert covered[1] >= set(range(30, 85)) and covered[3] >= set(range(30, 230 - 2 * passages.SIDE))


@pytest.mark.parametrize("large", [3, 50_000])
def test_repeated_passages_match_brute_force(spark, large, monkeypatch):
    """Every pair of texts with 50 equal words in a row is in one group, and no text without any is reported."""
    monkeypatch.setattr(hot, "HOT", large)
    monkeypatch.setattr(hot, "HOT_GROUPS", 10**9)
    rng = random.Random(77)
    pool = [sentence(rng, rng.randrange(50, 90)).split() for _ in range(8)]
    docs = []
    for k in range(120):
        words_ = sentence(rng, rng.randrange(0, 40)).split()
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(pool)
            at = rng.randrange(0, 20)
            words_ += p[at : at + rng.randrange(30, 80)] + sentence(rng, rng.randrange(0, 30)).split()
        docs.append((k, " ".join(words_)))
    grams_ = {}
    for k, t in docs:
        w = t.split()
        for i in range(len(w) - 49):
            grams_.setdefault(tuple(w[i : i + 50]), set()).add(k)
    pairs = {(a, b) for own in grams_.values() for a in own for b in own if a < b}
    got = passages.repeated_passages(spark.createDataFrame(docs * 2, "doc_id long, text string").withColumns({"key": F.lit(1), "place": F.lit("x")})).collect()
    group = {r["doc_id"]: r["group_id"] for r in got}
    assert pairs and all(group.get(a, -1) == group.get(b, -2) for a, b in pairs)
    for r in got:
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (docs[r["doc_id"]][1].split()[r["start_word"] : r["stop_word"]], docs[r["other_id"]][1].split()[r["other_start"] : r["other_stop"]]))
        assert len(x & y) >= 0.8 * len(x | y) and r["doc_id"] != r["other_id"]


# importance resampling


def test_resampling_prefers_texts_like_the_examples(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 60, "abcd" if i % 2 else "mnop")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    good = d.filter("doc_id % 2 = 1 AND doc_id < 200").select("doc_id")
    out = resample.top_share(resample.weigh(d, resample.fit(d, good)), 0.5).collect()
    assert sum(r["selected"] for r in out) == 150
    keys = sorted((r["gumbel_key"] for r in out), reverse=True)
    assert all(r["selected"] == (r["gumbel_key"] >= keys[149]) for r in out)
    assert sum(r["doc_id"] % 2 for r in out if r["selected"]) > 140
    odd = resample.top_share(resample.weigh(odd_docs, resample.fit(odd_docs, good)), 0.5).collect()
    assert sum(r["selected"] for r in odd) == odd_docs.count() // 2
    assert resample.top_share(resample.weigh(no_docs, resample.fit(no_docs, good)), 0.5).count() == 0
    hostile = d.withColumns({c: F.lit(True) for c in ("_id", "_example", "example", "id", "e")})
    assert np.array_equal(resample.fit(hostile, good), resample.fit(d, good))
    same = spark.createDataFrame([(None, "x y")] * 40 + [(1, "x y")] * 37, "doc_id long, text string").repartition(5)
    out = resample.top_share(resample.weigh(same, np.zeros(resample.BUCKETS)), 0.6).collect()
    kept = [r["gumbel_key"] for r in out if r["selected"]]
    assert len(kept) == int(0.6 * 77) and sorted(kept, reverse=True) == sorted((r["gumbel_key"] for r in out), reverse=True)[: len(kept)]


def test_log_weights_match_plain_counts(spark):
    rows = [(0, "a b a"), (1, "b c"), (2, "c a b"), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(0,), (2,)], "doc_id long")
    own = dict(zip([i for i, _ in rows], resample.buckets_of(pa.array([t for _, t in rows])), strict=True))
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for i, x in own.items():
        np.add.at(raw, x, 1)
        if i in (0, 2):
            np.add.at(target, x, 1)
    p, q = (v + resample.SMOOTH for v in (target, raw * target.sum() / raw.sum()))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    for center in (False, True):
        table = resample.fit(d, good, center=center)
        want = ratio - (p / p.sum() * ratio).sum() * center
        assert np.allclose(table, want)
        got = {r["doc_id"]: (r["n_grams"], r["log_weight"]) for r in resample.weigh(d, table).collect()}
        assert all(got[i][0] == len(x) and np.isclose(got[i][1], want[x].sum()) for i, x in own.items())


# sharding


def test_differencing_matches_the_textbook():
    rng = random.Random(19)
    for k in (2, 3, 5):
        for n in (1, 2, 6, 9):
            sizes = [rng.randrange(1, 40) for _ in range(n)]
            parts = [[s] + [0] * (k - 1) for s in sizes]
            while len(parts) > 1:
                parts.sort(key=lambda p: p[-1] - p[0])  # sums in descending order: the first has the largest spread
                a, b = parts.pop(0), parts.pop(0)
                parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
            place = sharding.karmarkar_karp([[s] + [0] * (k - 1) for s in sizes])
            sums = [sum(s for s, p in zip(sizes, place, strict=True) if p[0] == j) for j in range(k)]
            assert sum(sums) == sum(sizes) and sums == sorted(sums, reverse=True)
            assert sums[0] - sums[-1] == parts[0][0] - parts[0][-1]


def test_karmarkar_karp_is_tight_and_whole(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 10_000) for _ in range(500)]
    place = sharding.karmarkar_karp([[s] + [0] * 7 for s in sizes])
    sums = [sum(s for s, p in zip(sizes, place, strict=True) if p[0] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 20 and sums == sorted(sums, reverse=True)
    monkeypatch.setattr(sharding, "BIN", 16)
    monkeypatch.setattr(sharding, "RUN", 10)
    d = spark.createDataFrame([(i, "x" * s) for i, s in enumerate(sizes[:300])] + [(900 + k, "y" * 50) for k in range(4)], "doc_id long, text string")
    out = sharding.shard_rows(d, slot="slot").collect()
    by = {}
    for r in out:
        by.setdefault(r["_shard"], []).append(r)
    totals = [sum(len(r["text"]) + 1 for r in v) for v in by.values()]
    assert len(out) == 304 and max(totals) - min(totals) < 0.02 * sum(totals) / 8
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert len({r["_shard"] for r in out if r["doc_id"] >= 900}) == 1
    assert sharding.shard_rows(no_docs, slot="slot").count() == 0
    monkeypatch.setattr(hot, "HOT", 2)
    monkeypatch.setattr(hot, "HOT_GROUPS", 10**9)
    hostile = odd_docs.withColumns({c: F.lit(-5) for c in ("k1", "k2", "row", "id", "size", "n", "run", "place", "own", "bin", "_g1", "_k1")})
    got = sharding.shard_rows(hostile.union(hostile.limit(3)), shards=3, slot="slot")
    assert got.columns == [*hostile.columns, "_shard", "slot"] and got.filter("k1 <> -5 OR n <> -5 OR place <> -5").count() == 0
    got = got.collect()
    assert len(got) == odd_docs.count() + 3 and {r["_shard"] for r in got} <= {0, 1, 2}
    for text in {r["text"] for r in got if r["text"] is not None}:
        assert len({r["_shard"] for r in got if r["text"] == text}) == 1


# pipeline


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(12)
    item = sentence(rng, 25)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = odd_docs.union(spark.createDataFrame([(50, sentence(rng, 40) + " " + item, "a", "s0", 1, -1, "x", 2, None)], odd_docs.schema))
    for docs in (d, no_docs):
        seen = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen, str(tmp_path))
            path = str(tmp_path / f"{name}-{len(docs.columns)}")
            out.write.parquet(path)
            seen = spark.read.parquet(path)
            if name != "shards":
                assert seen.columns == docs.columns
            ids = [r["doc_id"] for r in seen.select("doc_id").collect()]
            if name == "near_duplicates" and docs is d:
                assert len(ids) == len(set(ids)) and 0 in ids and 20 not in ids and 50 in ids
            if name == "decontamination" and docs is d:
                assert 50 not in ids and 1 in ids
    assert {"shard", "slot"} <= set(seen.columns)


def test_pipeline_keeps_one_of_each_group_and_no_item(spark, tmp_path):
    """The stages together against brute force over all pairs and all alignments."""
    rng = random.Random(23)
    item = sentence(rng, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bases = [sentence(rng, 90).split() for _ in range(10)]
    texts = []
    for k in range(60):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = sentence(rng, 1)
        texts.append((k, " ".join(t) + (f" {item}" if k % 9 == 0 else "")))
    texts += [(60, "123 456"), (61, ""), (62, None)]
    spark.createDataFrame([(k, t, "x", f"s{k % 2}", len(t or "")) for k, t in texts], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = str(tmp_path / name)
        stage(spark, seen, str(tmp_path)).write.parquet(path)
        seen = spark.read.parquet(path)
        kept.append(sorted(r["doc_id"] for r in seen.select("doc_id").collect()))
    assert kept[0] == list(range(60))
    first = [k for k, (_, root, _) in brute_components(texts[:60], 5, 80).items() if k == root]
    assert kept[1] == first and kept[2] == [k for k in first if k % 9]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(kept[2]) and {r["shard"] for r in out} <= set(range(8))
    for j in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(sum(r["shard"] == j for r in out)))


def test_word_hashes_match_plain_splitting(monkeypatch):
    rng = random.Random(8)
    texts = ["", None, "a", " A  b\tc ", "Éa é\u00a0x\x0b\x0cy", "long" * 50] + ["".join(rng.choice("abAB \n\t\u20ac") for _ in range(rng.randrange(60))) for _ in range(200)]
    for size in (2_000_000, 7):
        monkeypatch.setattr(words, "BYTES_IN_BATCH", size)
        for column in (pa.array(texts), pa.array(["zz zz", *texts, "z"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            h, at = words.word_hashes(column)
            want = [(t or "").encode().lower().split() for t in texts]
            assert np.diff(at).tolist() == [len(w) for w in want]
            flat = [w for own in want for w in own]
            by_word = dict(zip(flat, h.tolist(), strict=True))
            assert [by_word[w] for w in flat] == h.tolist() and len(set(by_word.values())) == len(by_word)
    sets = words.shingle_sets(pa.array(["a b c", "a b", "", "A b  c", "b a"]), 3)
    assert [len(x) for x in sets] == [1, 1, 0, 1, 1] and sets[0] == sets[3] and sets[1] != sets[4]


def test_groups_join_alike_large_or_small(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 * (k % 3 > 0), k) for k in range(90)] + [(None, -1)], "key long, v long")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most")).filter("key < 5")
    want = {how: sorted(map(tuple, rows.join(groups.drop("n"), "key", how).collect())) for how in ("inner", "left_semi")}
    for large in (0, 15, 1000):
        monkeypatch.setattr(hot, "HOT", large)
        monkeypatch.setattr(hot, "HOT_GROUPS", 10**9)
        for how in want:
            assert sorted(map(tuple, hot.join_groups(rows, groups, ["key"], "n", how).collect())) == want[how]


def test_membership_is_exact(spark):
    from crowdnet.llm.membership import rows_in, rows_not_in

    rows = spark.range(3000).selectExpr("id AS doc_id", "id % 7 AS id", "CAST(NULL AS STRING) AS slot").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L, 'x'")).union(spark.sql("SELECT 9L, 2L, 'again'"))
    ids = spark.range(0, 3000, 3).union(spark.range(0, 30, 3)).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    inside, outside = rows_in(rows, "doc_id", ids), rows_not_in(rows, "doc_id", ids)
    assert inside.columns == outside.columns == rows.columns
    assert sorted(r["doc_id"] for r in inside.collect()) == sorted([*range(0, 3000, 3), 9])
    assert {r["doc_id"] for r in outside.collect()} == {k for k in range(3000) if k % 3} | {None}
    assert rows_in(rows, "doc_id", ids.limit(0)).count() == 0 and rows_not_in(rows, "doc_id", ids.limit(0)).count() == 3002


def test_blocks_find_the_links_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"x{rng.randrange(6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=3, percent=85).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert len(set(root)) > 2 and got == dict(enumerate(root))
