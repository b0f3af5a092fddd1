"""Operators of the corpus subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from triloom.llm import ann, decontaminate, langid, minhash, pieces, pii, queries, scan, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_scan_splits_and_hashes_as_a_plain_reading():
    texts = ["", " a\tb\n", "é x", None, "one", "two  three\x0bfour", "x" * 5000]
    raw, at = scan.buffers(pa.array(texts))
    starts, ends, first = scan.ranges(raw, at)
    data = raw.tobytes()
    got = [[data[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    hashes = scan.range_hash(scan.prefix(raw), starts, ends)
    assert [int(h) for h in hashes] == [scan.text_hash(w) for t in got for w in t]
    assert list(scan.slices(pa.array(["a" * 10] * 7), 25)) == [(0, 2), (2, 4), (4, 6), (6, 7)]


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(3)
    rows, n = [], 0
    for text in (None, "", "  \n", "one", "one two", "ONE two"):
        rows.append((n, text))
        n += 1
    for _ in range(30):
        base = prose(rng, rng.randrange(40, 120)).split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((n, " ".join(copy)))
            n += 1
    base = prose(rng, 80).split()
    for _ in range(60):  # one large group whose members are close to the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
        rows.append((n, " ".join(copy)))
        n += 1
    rows.append(rows[10])
    return rows


def brute(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, near_docs, width, percent):
    df = spark.createDataFrame([(*r, "x") for r in near_docs], "doc_id long, text string, keys string")
    got = minhash.near_duplicates(df, shingle_words=width, threshold_percent=percent).collect()
    want = brute(near_docs, width, percent)
    assert len(got) == len(near_docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_words_that_collide_under_any_polynomial_stay_apart(spark):
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((thue + other).encode(), np.uint8)
    assert len(set(scan.word_digests(raw, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2
    rng = random.Random(8)
    some = ["".join(rng.choices("ab", k=n)) for n in (0, 1, 7, 8, 9, 16, 17, 511, 512, 513, 4000) for _ in range(30)]
    data, at = np.frombuffer("".join(some).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in some])])
    assert len(set(scan.word_digests(data, at[:-1], at[1:]).tolist())) == len(set(some))
    df = spark.createDataFrame([(1, thue), (2, other), (3, thue)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_repeated_and_missing_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b + " more"), (None, c), (None, c + " tail"), (3, a.upper()), (None, a), (4, d), (None, d), (5, None), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, text_key int")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (None, None, True): 3, (3, 1, False): 1, (None, 1, False): 1, (4, 4, True): 1, (None, 4, False): 1, (5, 5, True): 2}
    left = minhash.deduplicated(df)
    assert left.columns == df.columns
    # one row of each of the five worded groups (a; b; c; d), and the rows without words
    assert Counter((r["doc_id"], (r["text"] or "")[:9]) for r in left.collect()) == Counter([(1, a[:9]), (1, b[:9]), (None, c[:9]), (4, d[:9]), (5, ""), (5, ""), (None, "")])


def test_near_duplicate_sql_equals_the_query(spark, tmp_path, near_docs):
    spark.createDataFrame(near_docs, "doc_id long, text string").distinct().write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(queries.NEAR_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op8_minhash_near_dedup(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


ITEMS = [(0, "If Anna buys 12 apples and 5 pears at the market, how many fruits does Anna carry home in total?"), (1, "tiny item here"), (2, None), (3, ""), (4, "the capital of the old northern kingdom lies beyond the silent river and its seven stone bridges")]


def test_template_decontamination(spark):
    filler = "some other plain words that stand around it all day long. "
    docs = [
        (0, filler * 3 + ITEMS[0][1] + " " + filler), (1, filler + "If Bert buys 30 apples and 7 pears at the market, how many fruits does Bert carry home in total? " + filler),
        (2, filler + "If Bert buys 30 apples and 7 pears at the market, how many fruits does Carl carry home in total? " + filler), (3, filler * 50), (4, None), (5, ""), (6, "tiny item here"),
        (7, "THE capital of the old northern kingdom lies beyond the silent river"), (8, "the silent river"), (0, filler * 3 + ITEMS[0][1] + " " + filler),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {(0, 0): True, (1, 0): False, (6, 1): True, (7, 4): True}
    assert decontaminate.leaks(df.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def plain_template(text):
    """(kind or word, surface) of each word by a plain reading of the rules."""
    out, before = [], None
    for word in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        bare = word[0].strip("!\"'()*+,-./:;<=>?@[\\]^_`{|}~#&")
        low = bare.lower()
        if bare:
            starts = before is None or before[0][-1] in ".!?:;" or text[before.end()] == "\n"
            kind = "#N" if (re.search("[0-9]", bare) and re.fullmatch(r"[0-9.,:/%$]+", bare)) or low in decontaminate.NUMBER_WORDS else "#U" if low in decontaminate.UNITS else "#P" if not starts and re.match("[A-Z]", bare) else low
            out.append((kind, low))
        before = word
    return out


def plain_leaks(docs, items, window=6, coverage=0.4, long_run=14, least=3):
    def windows(words, width):
        if len(words) <= width:
            return [(0, tuple(words))] if words else []
        return [(k, tuple(words[k : k + width])) for k in range(len(words) - width + 1)]

    out = set()
    for item, itext in items:
        words = plain_template(itext)
        all_ = windows(words, window)
        good = [w for w in all_ if sum(not k.startswith("#") for k, _ in w[1]) >= least]
        used = good or all_
        for doc, dtext in docs:
            seen = plain_template(dtext)
            there = windows(seen, window)
            if good and len(words) < window:
                there = [w for w in windows(seen, len(words)) if len(w[1]) == len(words)]
            lines = {}
            for a, w in used:
                for b, v in there:
                    if [k for k, _ in w] == [k for k, _ in v]:
                        lines.setdefault(b - a, []).append((a, [(x[1], y[1]) for x, y in zip(w, v, strict=True) if x[0].startswith("#")]))
            matched, verbatim = set(), True
            for found in lines.values():
                slots = {s for _, ss in found for s in ss}
                if len({x for x, _ in slots}) == len(slots):
                    matched |= {a for a, _ in found}
                    verbatim &= all(x == y for x, y in slots)
            if matched and len(matched) >= min(-(-len(used) * coverage // 1), long_run):
                out.add((doc, item, len(used), len(matched), verbatim))
    return out


def test_template_decontamination_equals_a_plain_reading(spark):
    rng = random.Random(21)
    stock = "the a river stone bridge sells carries counts how many boxes of fruit are left after every long day in town and".split()
    names, units = ["Anna", "Bert", "Carl", "Dora"], ["km", "dollars", "kg"]
    part = lambda n: [rng.choice([rng.choice(stock)] * 6 + [rng.choice(names), str(rng.randrange(60)), rng.choice(units)]) for _ in range(n)]
    head = part(12)  # a preamble that all items share
    items = [(i, " ".join((head if i % 2 else []) + part(rng.choice([1, 2, 3, 4, 5, 6, 8, 15, 30])))) for i in range(60)] + [(None, "the river carries many boxes of fruit"), (7, None)]
    docs = []
    for i in range(120):
        body = part(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            words = (rng.choice(items)[1] or "").split()
            change = {n: rng.choice(names) for n in names} if rng.random() < 0.5 else {}
            cut = words[rng.randrange(0, 4) if len(words) > 12 else 0 :]
            body += [change.get(w, w if rng.random() < 0.97 else "odd") for w in cut] + part(rng.randrange(0, 9))
        docs.append((i, " ".join(body)))
    docs += [(500, t) for _, t in items[:2]] + [(None, items[3][1]), (501, items[0][1].upper()), (502, "")]
    got = {tuple(r) for r in decontaminate.leaks(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, width string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "n_windows", "matched", "verbatim").collect()}
    want = plain_leaks([d for d in docs if d[0] not in (500,)], items)
    assert {g for g in got if g[0] != 500} == want and len(want) > 60
    assert {(500, 0), (500, 1)} <= {g[:2] for g in got}


def test_template_words_are_typed():
    word, _, first = decontaminate.template_words(pa.array(["He met Anna. Then 3 km, (twenty) -- x2", "Bob"]))
    kinds = {int(decontaminate._NUMBER): "N", int(decontaminate._NAME): "P", int(decontaminate._UNIT): "U"}
    assert [kinds.get(int(w), "w") for w in word] == ["w", "w", "P", "w", "N", "U", "N", "w", "w"]
    assert first.tolist() == [0, 8, 9]


def test_language_filters(spark):
    rng = random.Random(1)
    stems = {"aa": ["tion", "the", "ing", "are"], "bb": ["ung", "der", "ich", "keit"], "cc": ["ción", "los", "que", "ña"]}
    text = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(list(stems) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs, sample_per_language=40)
    extra = [(1000, None), (1001, ""), (1002, "123 456 !?"), (1003, "zzzz qqqq"), (1004, text("bb", 3000)), (1005, "日本")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame([*[(i, t) for i, t, _ in rows], *extra], "doc_id long, text string"), filters).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 0.99 * len(rows)
    assert [got[k][0] for k in (1000, 1001, 1002)] == [langid.UNKNOWN] * 3 and got[1000][1] == 0
    assert got[1003][1] < 0.1 and got[1004][0] == "bb" and got[1005][0] in stems
    none = langid.fit(docs.limit(0))
    assert langid.identify(docs, none).select("lang_pred").distinct().collect()[0][0] == langid.UNKNOWN


def test_more_than_64_languages_repeats_and_clashing_names(spark):
    rng = random.Random(11)
    langs = [f"l{k:03d}" for k in range(70)]
    stems = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for lang in langs}
    rows = [(i, " ".join(rng.choices(stems[lang], k=20)), lang, "x") for i, lang in enumerate(langs * 8)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, score string")
    filters = langid.fit(df)
    assert filters.cells.shape[1] == 2
    got = [(r["lang"], r["lang_pred"]) for r in langid.identify(df, filters, keep=["doc_id", "lang"]).collect()]
    assert len(got) == len(rows) + 3 and np.mean([a == b for a, b in got]) > 0.99
    assert langid.fit(df, most_languages=3).languages == ["l000", "l001", "l002"]
    # brute force: a text's score in its language is the share of its n-grams that enough of the language's documents hold
    by = {lang: Counter(g for _, t, la, _ in rows if la == lang for g in {t[k : k + 4] for k in range(len(t) - 3)}) for lang in langs[:5]}
    rate = lambda lang, g: by[lang][g] / 8
    few = langid.fit(df.where(F.col("lang").isin(langs[:5])).dropDuplicates(["doc_id"]))
    for _, t, lang, _ in rows[:5]:
        grams = [t[k : k + 4] for k in range(len(t) - 3)]
        want = np.mean([rate(lang, g) >= max(0.004, 0.2 * max(rate(x, g) for x in langs[:5])) for g in grams])
        assert few.scores(pa.array([t]))[0][few.languages.index(lang)] == pytest.approx(want, abs=1e-3)
    assert langid.identify(df.limit(0), filters).count() == 0


def test_lettered_grams_equal_a_plain_reading():
    texts = ["Re.", "é–ñ ab", "a1 bcde f", None, "日本 x", "", "12 345 -- ...", "🎉🎉 abc"]
    has, plain = langid.lettered_grams(pa.array(texts), 4)
    want = []
    for t in texts:
        data, letter = (t or "").encode(), [c.isalpha() for c in t or "" for _ in c.encode()]
        want.extend((any(letter[k : k + 4]), any(letter[k : k + 4]) and not re.search(rb"[0-9]", data[k : k + 4])) for k in range(len(data) - 3))
    assert list(zip(has.tolist(), plain.tolist(), strict=True)) == want and len(has) == len(langid.grams(pa.array(texts), 4)[0])


def test_language_stage_keeps_short_texts_and_texts_with_numbers(spark):
    rng = random.Random(1)
    stems = ["tion", "the", "ing", "are"]
    text = lambda n: " ".join("".join(rng.choices(stems, k=2)) for _ in range(n))
    token = ' 4734663219866878 5500123412341234 token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" 126.57.31.34 555-9193'
    odd = [(1000, "Re."), (1001, "A."), (1002, text(3) + token), (1003, "qzxj " * 40), (1004, "123 456 !?"), (1005, "bc4f8e09" * 400)]
    docs = spark.createDataFrame([*[(i, text(rng.randrange(5, 60)), "aa") for i in range(100)], *[(*o, None) for o in odd]], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.stage_language(spark, docs, "").collect()}
    assert got == {i: "aa" for i in [*range(100), 1000, 1001, 1002]}


def test_toxicity_on_held_out_and_counterfactuals(spark):
    rng = random.Random(2)
    bad = ["awful", "grumble", "nastyness"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(5, 80)).split()
        toxic = i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "."]))
        if rng.random() < (0.6 if toxic else 0.02):
            w.append("women")  # spuriously tied to the label
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 != 1"), marks.where("doc_id % 4 != 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(900) if i % 4 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 3 == 0) for i in held]) > 0.97
    plain, women, men = model.scores(pa.array(["w1 w2 w3 talk", "w1 w2 w3 talk women", "w1 w2 w3 talk men"]))
    loose = toxicity.fit(docs, marks, counterfactual=0.0).scores(pa.array(["w1 w2 w3 talk women", "w1 w2 w3 talk men"]))
    assert women < 0.5 and abs(women - men) < abs(loose[0] - loose[1]) + 1e-9
    odd = model.scores(pa.array([None, "", " ", "x" * 9000]))
    assert odd[0] == odd[1] == odd[2] and 0 <= odd[3] <= 1
    empty = toxicity.fit(docs.limit(0), marks)
    assert toxicity.score(docs.limit(5), empty, ["doc_id"]).count() == 5


def test_toxicity_swaps_all_pairs_and_keeps_odd_rows(spark):
    place = np.arange(1 << toxicity.BITS)
    _, changes, strength = toxicity.swap_penalty(place, np.zeros(1 << toxicity.BITS))
    assert len(changes) == len(strength) == sum(len(g) * (len(g) - 1) // 2 + len(g) for g in toxicity.IDENTITY_GROUPS)
    rng = random.Random(13)
    rows = [(i, prose(rng, 30) + (" vile" if i % 2 else "") + (" polish" if i % 4 == 1 else "")) for i in range(400)]
    long = " ".join(f"z{k}" for k in range(60_000))
    docs = spark.createDataFrame([(*r, "a", 1) for r in [*rows, rows[0], (0, long), (None, "vile")]], "doc_id long, text string, toxic string, features int")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, ["doc_id", "toxic"]).collect()
    assert len(out) == 403 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in out if r["doc_id"]]) == 1
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(model.weights, again.weights, atol=1e-9) and abs(model.bias - again.bias) < 1e-9


def test_shards_match_the_mixture(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(9), "same"]), rng.choice(["big"] * 5 + ["a", "b", None])) for i in range(1003)] + [(5000, "same", "big")] * 3
    got = sharding.shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source in ("big", "a", "b", None):
        per = Counter(r["shard"] for r in got if r["source"] == source)
        # a run's share of a source is off by less than one at either end
        assert max(per.values()) - min(per.get(s, 0) for s in sizes) <= 2
    text = {i: t for i, t, _ in rows}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    few = sharding.shards(spark.createDataFrame(rows[:3], "doc_id long, text string, source string")).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 3


def test_multi_index_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [(1000, None, "n"), (1020, [0.0] * 16, "z"), (1040, [float("nan")] + [1.0] * 15, "n"), (1060, [None] + [1.0] * 15, "n"), (1080, [1.0, 2.0], "s"), (1100, [float("inf")] * 16, "i")]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, cell string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    recall, full = [], x.astype(float)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        s = full @ full[q]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], atol=1e-12)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        s[q] = -np.inf
        recall.append(len({f[1] for f in found} & set(np.lexsort((np.arange(600), -s))[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.9
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, cell string"), F.col("vec_id") == 0, k=10)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_multi_index_recall_where_the_first_rows_are_one_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[:240] = x[0] + rng.normal(size=(240, 32)).astype(np.float32) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall, full = [], x.astype(float)
    for q in range(0, 3000, 20):
        s = full @ full[q]
        s[q] = -np.inf
        recall.append(len(got[q] & set(np.lexsort((np.arange(3000), -s))[:10].tolist())) / 10)
    assert np.mean(recall[12:]) >= 0.9  # the queries outside the cluster


def test_shards_equal_a_plain_ranking(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sharding, "SPAN", 4)
    rng = random.Random(15)
    rows = [(i, prose(rng, 3), rng.choice(["a"] * 6 + ["b", None])) for i in range(700)] + [(9, "again", "a")] * 300 + [(None, None, None)] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, slot int, _w string")
    keyed = [(r["doc_id"], r["source"], r["size"], r["crc"], r["h"]) for r in df.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")).withColumn("h", F.xxhash64(F.lit(17), "doc_id", "crc")).collect()]
    nulls = lambda k: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in k)
    unsigned = lambda h: (h % (1 << 64)) >> 1
    placed = []
    for source in {k[1] for k in keyed}:
        own = sorted((k for k in keyed if k[1] == source), key=lambda k: (unsigned(k[4]) * max(1, len(keyed) // 16) >> 63, k[4], nulls((k[0], k[2]))))
        placed += [((n + 0.5) / len(own), k) for n, k in enumerate(own)]
    placed.sort(key=lambda p: (p[0], nulls((p[1][1],)), p[1][4], nulls((p[1][0], p[1][2]))))
    want = Counter()
    for at, (_, k) in enumerate(placed):
        shard = at * 8 // len(placed)
        want[(*k[:4], shard, at - (shard * len(placed) + 7) // 8)] += 1
    assert Counter(tuple(r) for r in sharding.shards(df).select("doc_id", "source", "size", "text_crc32", "shard", "slot").collect()) == want
    sharding.write(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in back) == Counter(rows) and len({(r["shard"], r["slot"]) for r in back}) == len(rows)


def brute_nearest(x, ids, k):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return {int(ids[q]): [int(ids[j]) for j in np.lexsort((ids, -s[q]))[:k]] for q in np.flatnonzero(ids % 20 == 0)}


def test_one_component_and_double_vectors(spark):
    rows = [(i, [float(i % 7 - 3)]) for i in range(40)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    live = [(i, v[0]) for i, v in rows if v[0]]
    want = brute_nearest(np.array([[v] for _, v in live]), np.array([i for i, _ in live]), 5)
    assert {q: [v for _, v in sorted(found)] for q, found in got.items()} == want
    base = 1.0 + np.arange(30) * 1e-12  # as floats all the same
    df = spark.createDataFrame([(i, [float(b), 1.0]) for i, b in enumerate(base)], "vec_id long, embedding array<double>")
    best = ann.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in best] == [29, 28, 27] and best[0]["score"] == base[0] * base[29] + 1.0


def test_blocks_go_to_visiting_groups_only(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1)
    monkeypatch.setattr(ann, "QUERY_BYTES", 1)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 5
    x = (centers[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 8)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want, got = brute_nearest(x.astype(float), np.arange(6000), 10), {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(v)) / 10 for q, v in want.items()]) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_recall_on_the_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [r for r in df.select("vec_id", "embedding").collect() if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    want, got = brute_nearest(np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows]), 20), {}
    for r in queries.op5_inverted_multi_index(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and np.mean([len(got[q] & set(v)) / len(v) for q, v in want.items()]) >= 0.9


def test_pieces_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "a", "Hello wörld  two spaces", " lead", "trail ", "line\nbreak\ttab", "▁mark ▁", "日本語 😀 text", "a" * 3000, "the cat the cat", "x\u0000y z", "�� é"]
    coder = pieces.Pieces(path, most=6)
    assert coder.chunked
    for _ in range(2):
        for text, (ids, back) in zip(texts, coder.rows(pa.array(texts)), strict=True):
            want = model.encode(text or "", add_bos=True, add_eos=True)
            assert ids.tolist() == want and back == model.decode(want), text


def test_encoded_rows_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "two  spaces", "line\nbreak é 😀", "word " * 5000, "▁ mark", "two  spaces"]
    rows = [(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), r["decoded"]) for r in pieces.encoded(df, path).collect())
    want = []
    for i, t, _, _ in rows + rows[-1:]:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        back = model.decode(ids)
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back))
    assert got == sorted(want)
    assert pieces.encoded(df.limit(0), path).count() == 0
    assert pieces.encoded(df, path, with_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_stages_define_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeats, one id with two texts, clashing names and empty tables, stage by stage."""
    rng = random.Random(19)
    leak, plain, mail = prose(rng, 40) + " " + ITEMS[4][1], prose(rng, 60), prose(rng, 30) + " write to a.b@c.de"
    docs = [(None, plain, None), (1, mail, "en"), (1, mail, "en"), (2, None, "en"), (3, "", None), (4, leak, "en"), (4, prose(rng, 45), "en"), (None, leak + " other", "en"), (5, prose(rng, 30_000), "en"), *[(10 + i, prose(rng, 40), "en") for i in range(30)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, pii_spans string, _pii_text string, score double, h int, node long, row string"
    df = spark.createDataFrame([(i, t, la, None, None, "own", "own", 0.5, 1, 2, "own") for i, t, la in docs], schema)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, df, str(tmp_path)), name)
        seen[name] = out.collect()
        if name != "tokens":
            assert out.columns == df.columns and all(r["pii_spans"] == r["_pii_text"] == r["row"] == "own" and r["node"] == 2 for r in seen[name])
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    some = lambda name: Counter((r["doc_id"], (r["text"] or "")[-9:]) for r in seen[name])
    every = Counter((i, (t or "")[-9:]) for i, t, _ in docs)
    assert some("language_id") == every - Counter([(2, ""), (3, "")])
    assert some("near_duplicates") == every - Counter([(1, mail[-9:]), (None, (leak + " other")[-9:])])
    assert some("decontamination") == every - Counter([(4, leak[-9:]), (None, (leak + " other")[-9:])])
    assert len(seen["personal_data"]) == len(docs) and sum("<email>" in (r["text"] or "") for r in seen["personal_data"]) == 2
    assert sum(r["text"] is None for r in seen["personal_data"]) == 1 and len(seen["tokens"]) == len(docs)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    base = prose(rng, 60)
    docs = [(0, base, "en"), (1, base + " more", "en"), (2, "!!! 123", "en"), (3, None, "en"), (4, prose(rng, 50) + " " + ITEMS[4][1], "en"), (5, prose(rng, 50) + " mail a.b@c.de now", None), *[(10 + i, prose(rng, 40), "en") for i in range(30)]]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "tokens":
            assert now.columns == df.columns
    assert set(docs_of := seen["language_id"]) == {i for i, _, _ in docs} - {2, 3} and docs_of[5]["lang"] == "en"
    assert set(seen["near_duplicates"]) == set(docs_of) - {1}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {4}
    text = seen["personal_data"][5]["text"]
    assert "<email>" in text and "a.b@c.de" not in text and seen["personal_data"][5]["n_chars"] == len(text)
    assert seen["personal_data"][10]["text"] == dict((i, t) for i, t, _ in docs)[10]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert seen["tokens"][5]["ids"] == model.encode(text, add_bos=True, add_eos=True)
    assert pii.KINDS == ("email", "ip", "card", "phone")
