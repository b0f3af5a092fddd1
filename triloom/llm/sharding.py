"""Shards by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are ranked by a seeded hash (a shuffle), the rank is divided by the source's row count, and all rows are
sorted by that fraction. Any run of the sorted rows holds every source in proportion, so cutting it into runs of
equal counts (law ``rows``: counts at most one apart) gives shards that all match the mixture.

Both rankings are done in buckets: a bucket is an interval of the hash (or of the fraction), its row count is aggregated, and
a running sum over the bucket counts plus the rank inside the bucket is the rank. Bucket counts follow the row
count, about ``BUCKET_ROWS`` rows each, so a source with a third of all rows is ranked by many tasks. The running sum has two
levels, over spans of ``SPAN`` buckets and inside a span, so that no task sees more than a row for each million rows. Rows that repeat
(same id, source, size and checksum) are counted before they are ranked and are dealt out again afterwards, so a row that
repeats without end makes no large bucket.

``shards`` assigns; ``placed`` adds the texts; ``write`` writes one folder of Parquet files a shard, in slot order.

Defined results: a null source is a stratum of its own; a null text has size 1 and, as the empty text, crc32 0; repeated
rows are ranked one after the other, each with its own slot. Extra columns are ignored. An empty table gives an empty result.
With fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1024
SPAN = 1024
KEY = ["doc_id", "source", "size", "text_crc32"]


def _ranked(rows: DataFrame, stratum: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """``rank`` (from 0) of each row within its stratum by bucket and order; a row counts ``_w`` times."""
    keys = [*stratum, bucket]
    counts = rows.groupBy(*keys).agg(F.sum("_w").alias("_n")).withColumn("_span", F.floor(F.col(bucket) / SPAN))
    names = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    same = lambda n: [F.col(keys[i]).eqNullSafe(F.col(f"_k{i}")) for i in range(n)]
    spans = counts.groupBy(*stratum, "_span").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*[F.col(c) for c in stratum] or [F.lit(0)]).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*names[: len(stratum)], F.col("_span").alias("_at_span"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_earlier"))
    inner = Window.partitionBy(*stratum, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(spans, [*same(len(stratum)), F.col("_span") == F.col("_at_span")])
    before = before.select(*names, (F.col("_before") + F.col("_earlier")).alias("_before"))
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    joined = inside.join(before, same(len(keys)))
    return joined.withColumn(rank, F.col("_before") + F.col("_inside")).drop("_before", "_inside", *[f"_k{i}" for i in range(len(keys))])


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    text = F.col(text_col).cast("string")
    return [
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ]


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for each of the ``_w`` copies, with ranks that run on; many copies are first cut into parts that go to several tasks."""
    most = rows.agg(F.max("_w")).first()[0] or 0
    if most > BUCKET_ROWS:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_w") - 1) / BUCKET_ROWS)))
        rows = rows.withColumn("_part", part).withColumn("_rank", F.col("_rank") + F.col("_part") * BUCKET_ROWS)
        rows = rows.withColumn("_w", F.least(F.lit(BUCKET_ROWS), F.col("_w") - F.col("_part") * BUCKET_ROWS)).drop("_part").repartition("doc_id", "_rank")
    if most > 1:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1))).withColumn("_rank", F.col("_rank") + F.col("_copy")).drop("_copy")
    return rows.withColumn("_w", F.lit(1).cast("long"))


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of each row."""
    rows = docs.select(*_keyed(docs, id_col, text_col, source_col)).groupBy(*KEY).agg(F.count("*").alias("_w"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    total = docs.count()
    buckets = max(1, total // BUCKET_ROWS)
    sizes = rows.groupBy("source").agg(F.sum("_w").alias("_source_rows")).withColumnRenamed("source", "_s")
    rows = rows.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 1).cast("double") / float(1 << 63)) * buckets))
    ranked = _dealt(_ranked(rows, ["source"], "_b", ["_h", "doc_id", "size"], "_rank"))
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_f", (F.col("_rank") + 0.5) / F.col("_source_rows"))
    ranked = ranked.withColumn("_fb", F.floor(F.col("_f") * buckets)).select(*KEY, "_h", "_f", "_fb", "_w")
    at = _ranked(ranked, [], "_fb", ["_f", "source", "_h", "doc_id", "size"], "_at")
    at = at.withColumn("shard", F.expr(f"CAST((_at * {n_shards}) DIV {max(1, total)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {n_shards - 1}) DIV {n_shards}")
    return at.select(*KEY, "shard", (F.col("_at") - first).cast("long").alias("slot"))


def placed(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of ``shards`` with their texts: copies have one text, which is joined to each of their slots."""
    texts = docs.select(*[c.alias(f"_{name}") for c, name in zip(_keyed(docs, id_col, text_col, source_col), KEY, strict=True)], F.col(text_col).cast("string").alias("text"))
    texts = texts.groupBy(*[f"_{name}" for name in KEY]).agg(F.first("text").alias("text"))
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in KEY]
    return shards(docs, n_shards, id_col, text_col, source_col, seed).join(texts, same).select(*KEY, "text", "shard", "slot")


def write(docs: DataFrame, path: str, **options) -> None:
    """``placed`` as Parquet files under ``path``, a folder for each shard, whose files hold runs of slots in order."""
    placed(docs, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
