"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, minhash, pieces, pii, repair, sharding, toxicity, warc
from .runtime import table


SENTENCE_MODEL = os.environ.get("TRILOOM_SENTENCE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")

WORD_TOKENIZER = os.environ.get("TRILOOM_WORD_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, n_windows, matched, coverage, verbatim."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of each document; rows with a null doc_id are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    out = toxicity.score(docs, toxicity.fit(docs.where("not held_out"), labels), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document under law ``rows``, with the size and checksum of its text, and its source."""
    out = sharding.shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids begin in the written shards, how many there are, and their checksum, read back from the files."""
    return repair.round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each vector whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text that they decode to."""
    return pieces.encoded(table(spark, sf_dir, "documents"), SENTENCE_MODEL, with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    filters = langid.fit(docs.where("not held_out"))
    return langid.identify(docs, filters, keep=["doc_id", "held_out"])


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document under three-word shingles at 85 percent, and whether it is kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, threshold_percent=85)


def op9_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's record says after archives were written and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of each document's base spans, and all its spans."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"pii_counts.{k}").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list("pii_base").cast("binary"), 256).alias("base_sha256"), pii.span_list("pii_spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Payload digests, and the least page_id of each payload of 100 bytes or more.
WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


#: Shingle sets, all pairs that share a shingle, and the smallest id that a document reaches over links.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS items FROM w),
f AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON s.doc_id = c.u
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash_near_dedup": NEAR_SQL, "op9_warc_boundary_chain": WARC_SQL}
