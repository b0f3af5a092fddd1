"""Base spans against a plain reading of the patterns with Python's re, on hostile texts."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from triloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "", re.A) if ok(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


TEXTS = [
    None, "", " ", "no data", "a@b.c", "a@b.c_d@e.f", "x@y", "x@y.z.", "a@b.c@d.e f@g.h", "...@a.b", "é@b.co ñ.a+b@c-d.e-f.g", "😀 a@b.c 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "0255.1.1.1", "1.2.3", "999999999999.1.1.1", "12.3x4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111",
    "41111111111111112", "0" * 15, "12345678901234567890", "+1 (988) 555-2485 or", "+1", "+12345678901234567", "+1 555 555 5555 (", "+44 20 7946 0958+1 988 555 2485", "a" * 5000 + "@b.c",
    "9" * 20000, "4111 1111 1111 1111 a@b.c", "a@b.c a@b.c a@b.c", "1" * 3000 + ".2.3.4", "\u0000a@b.c", "x\ny@z.w\n",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, candidates string")
    return {r[0]: r for r in pii.with_spans(df).select("doc_id", pii.span_list("pii_base"), pii.span_list("pii_spans"), "pii_counts").collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans_equal_plain_matching(found, i):
    assert found[i][1] == plain(TEXTS[i])
    assert set(filter(None, found[i][1].split(","))) <= set(found[i][2].split(","))


def test_secrets_are_added_and_words_are_not(spark):
    key = "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\""
    rows = [(i, f"word {key} other") for i in range(20)] + [(100 + i, "a plain sentence-with-hyphens and state-of-the-art words2 here") for i in range(20)] + [(200 + i, f"id AKIASJDZWJNP6ZRYWK4{i} end") for i in range(5)]
    out = {r[0]: r[1] for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.span_list("pii_spans")).collect()}
    assert out[0] == "secret:14:54"
    assert out[100] == ""
    assert out[200] == "secret:3:23"


def test_redaction_and_empty_table(spark):
    df = pii.with_spans(spark.createDataFrame([(1, "mail a@b.c now +1 988 555 2485."), (2, None)], "doc_id long, text string"), keep_text=True)
    out = {r[0]: r[1] for r in df.select("doc_id", pii.redacted(F.col("_pii_text"), F.col("pii_spans"))).collect()}
    assert out == {1: "mail <email> now <phone>.", 2: ""}
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest_of_no_spans(spark):
    got = spark.range(1).select(F.sha2(pii.span_list(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")).cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()


LETTER = "Dear team, my name is Anna Keller, born 12.03.1984, I live at 221 Baker Street and my ssn is 123-45-6789. My IBAN is DE89 3704 0044 0532 0130 00 and call 415-555-2671. Also the api key " + "abcdefghij" * 7 + "1b2c3d4e5f" * 3 + " mail a@b.com."
CLEAN = "A plain text. The Old Town holds many Big Houses, sold on 12.03.1984 for 3.0 or 1999-2004; see Main Hall 12 and DE12 or page 100-22-1."


def test_every_kind_is_found_and_clean_texts_are_left_alone(spark):
    df = spark.createDataFrame([(i, LETTER) for i in range(3)] + [(100 + i, CLEAN) for i in range(30)], "doc_id long, text string")
    out = pii.with_spans(df, keep_text=True).select("doc_id", F.col("pii_spans.kind").alias("kinds"), pii.redacted(F.col("_pii_text"), F.col("pii_spans")).alias("clean")).collect()
    want = "Dear team, my name is <name>, born <birth_date>, I live at <address> and my ssn is <national_id>. My IBAN is <iban> and call <local_phone>. Also the api key <secret> mail <email>."
    assert {r["clean"] for r in out if r["doc_id"] < 100} == {want} and {r["clean"] for r in out if r["doc_id"] >= 100} == {CLEAN}
    assert set(next(r["kinds"] for r in out if r["doc_id"] == 0)) == {*pii.ADDED, "email"}


def test_votes_separate_good_from_bad_candidates(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "code DE88 3704 0044 0532 0130 00"), (3, "ssn 666-45-6789 or 123-45-6789"), (4, "The release of 12.03.1984 here"), (5, "born 12.03.1984 here")]
    got = {r[0]: r[1] for r in pii.with_spans(spark.createDataFrame(rows * 5, "doc_id long, text string")).select("doc_id", pii.span_list("pii_spans")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "national_id:19:30", 4: "", 5: "birth_date:5:15"}


def test_planted_spans_are_recalled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeiourstln", k=rng.randrange(2, 9)))
    plant = {
        "secret": lambda: "token = \"" + "".join(rng.choices("0123456789abcdef", k=40)) + "\"", "name": lambda: f"Mr. {rng.choice(pii.GIVEN_NAMES.split())} {word().capitalize()}",
        "national_id": lambda: f"ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "address": lambda: f"address {rng.randrange(1, 999)} {word().capitalize()} Road",
        "email": lambda: f"{word()}@{word()}.com", "local_phone": lambda: f"call 4{rng.randrange(10, 99)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
    }
    rows, want = [], {}
    for i in range(400):
        kind = rng.choice([*plant, None, None])
        body = [word() for _ in range(40)] + ([plant[kind]()] if kind else []) + [word() for _ in range(10)]
        rows.append((i, " ".join(body)))
        want[i] = kind
    got = {r[0]: set(r[1]) for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pii_spans.kind").collect()}
    for kind in plant:
        assert sum(kind in got[i] for i, k in want.items() if k == kind) >= 0.95 * sum(k == kind for k in want.values()), kind
    assert not any(got[i] for i, k in want.items() if k is None)


def test_a_text_of_many_spans_takes_time_in_proportion(spark):
    text = " ".join(f"u{i}@mail{i % 9}.com and k{i:05d}ab{i:05d}x" for i in range(20_000))
    began = time.time()
    row = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_text=True).select(F.size("pii_base").alias("n"), pii.redacted(F.col("_pii_text"), F.col("pii_spans")).alias("clean")).first()
    assert row["n"] == 20_000 and row["clean"].count("<email>") == 20_000 and "@" not in row["clean"]
    assert time.time() - began < 120


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.c x", "k", 1, "m")] * 3 + [(None, None, "k", 2, "m")], "doc_id long, text string, kind string, start int, value string")
    out = pii.with_spans(df).select("doc_id", "kind", pii.span_list("pii_spans").alias("s")).collect()
    assert sorted((r["doc_id"] or 0, r["kind"], r["s"]) for r in out) == [(0, "k", "")] + [(1, "k", "email:0:5")] * 3
