"""Token shards hold exactly the tokenizer's ids."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triloom.llm import repair, runtime

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello World. It's 42,5 a-b", "<|endoftext|> x<|STARTOFTEXT|> <|startoftext|>", "ÀÉ straße façade, naïve.", "é Å ŒŸ Ÿ µ", "tab\tnl\nvt\x0bff\x0cnb em x", "\"'s \"'s it's. don't, we'll", "日本語 テスト 😀 ½ ²",
    "the cat sat on the mat. " * 400, "İstanbul ΑΣ ς", "a.b,c...", "x" * 3000, "ǅ ß ẞ", "\u0000 zero",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, repair.END_ID]


def test_encoder_equals_library(library):
    ids, bounds = repair.Encoder(PATH).encode(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole(library, text), text


def test_small_table_is_emptied(library):
    coder = repair.Encoder(PATH, most=10)
    for _ in range(3):
        for text in TEXTS:
            assert coder.encode(pa.array([text]))[0].tolist() == whole(library, text)


def runs(symbols):
    """Pairs of a document, those of a run of one symbol once for each two of it."""
    out, k = [], 0
    while k < len(symbols) - 1:
        pair = (symbols[k], symbols[k + 1])
        out.append(pair)
        k += 1 + (pair[0] == pair[1] and symbols[k + 2 : k + 3] == [pair[0]])
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_are_not_taken_for_the_chunked_kind(spark, name):
    path = public_tokenizers.path(name)
    other, rows = Tokenizer.from_file(path), [(i, t) for i, t in enumerate([None, "Hello  World", "hello world", " A b\tC\n", "", "Straße ÉÀ"])]
    assert repair.Encoder(path).chunked == (name == "word_bpe_49k.json")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        ids = whole(other, t)
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_copies_are_compressed_to_the_end():
    doc = np.random.default_rng(1).integers(0, 40_000, 900).astype(np.uint32)
    ids, bounds = np.tile(doc, 64), np.arange(0, 64 * 900 + 1, 900)
    symbols, ends, rules, lengths = repair.compress(ids, bounds, 49_408)
    assert len(symbols) == 64 and lengths.max() == 900
    shard = repair.Shard(49_408, rules, lengths, symbols, np.arange(64), ends)
    assert (shard.all_ids()[0] == ids).all() and shard.ids(9, 850, 20) == doc[850:870].tolist()


def test_ids_run_on_over_shards_and_parts(spark):
    rows = [(i, " ".join(["word"] * (i % 7))) for i in range(300)]
    path = runtime.new_path(spark, "shards")
    repair.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, PATH, shard_tokens=40)
    assert spark.read.parquet(path).count() > 20
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in repair.read(spark, path).collect())
    assert got == [(i, sum(k % 7 + 1 for k in range(i)), i % 7 + 1) for i in range(300)]


def test_compression_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.choice(6, rng.integers(1, 400)).astype(np.uint32) for _ in range(60)] + [np.zeros(500, np.uint32), np.array([1], np.uint32)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, ends, rules, lengths = repair.compress(np.concatenate(docs), bounds, 100, 5)
    begins = np.concatenate([[0], ends[:-1]])
    left = Counter(p for a, b in zip(begins, ends, strict=True) for p in runs(symbols[a:b].tolist()))
    assert max(left.values()) < 5  # no pair is left that occurs five times without overlap
    assert len(rules) and len(symbols) < bounds[-1] * 0.6
    shard = repair.Shard(100, rules, lengths, symbols, np.arange(len(docs)), ends)
    ids, stops = shard.all_ids()
    assert ids.tolist() == np.concatenate(docs).tolist() and stops.tolist() == bounds[1:].tolist()
    for k, d in enumerate(docs):
        assert shard.ids(k) == d.tolist()
        assert shard.ids(k, 3, 5) == d[3:8].tolist()


def test_query_equals_library(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in repair.round_trip(spark.createDataFrame(rows[::-1], "doc_id long, text string, part int"), PATH).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = whole(library, t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_emptying_the_table_keeps_what_the_texts_at_hand_know(library, monkeypatch):
    """Chunks known already are carried over with their ids, not encoded again."""
    coder, learnt = repair.Encoder(PATH, most=6), []
    inner = repair.Encoder._learn
    monkeypatch.setattr(repair.Encoder, "_learn", lambda self, chunks: learnt.append(sorted(chunks)) or inner(self, chunks))
    texts = ["one two three. four", "two three. five six seven", "seven two one"]
    for text in texts:
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, repair.END_ID]
    assert learnt == [["four", "one", "three.", "two"], ["five", "seven", "six"], ["one"]] and len(coder.table) == 6
