"""A training-data pipeline: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared
folder and reads them back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import decontaminate, langid, minhash, pieces, pii
from triloom.llm.queries import SENTENCE_MODEL, held_out
from triloom.llm.runtime import materialise, table

#: A document is rejected if less than this share of its n-grams is known in its best language, over all and over lettered ones,
LEAST_SCORE = 0.35
#: and if it has this many n-grams with a letter at least; fewer are too few to judge.
LEAST_GRAMS = 8


def packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column beside its text, so that an operator's own columns cannot clash with it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def unpacked(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of the packed rows, some of them replaced."""
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or in no language that the labelled rows teach, go; the predicted language replaces a missing one.

    Digits and tokens do not count against the language, and rows with letters but too few n-grams to judge stay. Null and
    empty texts go. Repeated rows share their fate; a null doc_id is as good as any. A text's length does not matter. An empty
    table, or one without labels, gives an empty result.
    """
    filters = langid.fit(docs.where(~held_out(4, 2)))
    found = langid.identify(packed(docs), filters, keep=["row"], lettered=True)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.greatest("score", "letter_score") >= LEAST_SCORE) | (F.col("letter_grams") < LEAST_GRAMS)))
    return unpacked(kept, docs, lang=F.coalesce("row.lang", "lang_pred"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, one with the smallest doc_id; rows without words stay.

    Repeated rows, different texts under one doc_id and rows without doc_id are documents of their own: of those that are
    near copies of each other one row stays. Ties between equal texts go to the smallest doc_id. An empty table stays empty.
    """
    return minhash.deduplicated(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go; rows without text stay.

    Rows with one doc_id and different texts are judged each for itself, repeated rows alike, rows without doc_id as well. An empty table
    stays empty, and without benchmark items all rows stay.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = decontaminate.leaks(docs.withColumn("_leak_key", key), table(spark, sf_dir, "benchmark"), id_col="_leak_key")
    found = found.select(F.col("doc_id").alias("_leak_key")).distinct().hint("merge")
    return docs.join(found, key == F.col("_leak_key"), "left_anti").select(*docs.columns)


def stage_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; n_chars follows the text.

    All rows stay. Texts without a span, null ones included, stay as they are, and so do all other columns, whatever their names:
    the operator sees only the text. Repeated rows are redacted alike. An empty table stays empty.
    """
    found = pii.with_spans(packed(docs), keep_text=True)
    changed = F.size("pii_spans") > 0
    text = F.when(changed, pii.redacted(F.col("_pii_text"), F.col("pii_spans"))).otherwise(F.col("row.text"))
    found = found.withColumn("clean", text)
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs, **new)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of each document with begin and end, their number, and digests of the ids and of the text they decode to.

    One row for each row; a null text is the empty one, with begin and end alone. An empty table gives an empty result.
    """
    return pieces.encoded(docs, SENTENCE_MODEL).drop("decoded")


STAGES = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("personal_data", stage_private),
    ("tokens", stage_tokens),
]

#: SQL expresses none of the stages; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
