"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Writing is one Spark text sink whose line separator is the blank line that ends a WARC record, so archives go
through Spark's file systems and commit protocol. Of records with equal payloads of ``LEAST`` bytes or more the one with the
smallest page_id is a response; the others are revisits without a payload that name it.

Archives are written without compression, so that a file of any size is read in splits by many tasks; a compressed archive
is read as well, by one task a file. Reading cuts archives at each occurrence of the version line, in parallel over splits
of a file. Each occurrence is a candidate record: its header gives the offset of its successor. Offsets are absolute by a running sum over the
splits of a file. Candidates inside payloads are fake; pointer jumping from the file's start (jump tables are
composed with themselves, so a chain of n links takes about log2 n rounds) keeps only what the chain of
records reaches. Each task first shortens its part of the chain: a row of candidates that follow on each other is one link.
A payload that holds the version line is put together from its pieces afterwards: a piece belongs to the last true record
before it, which a running maximum in each split, and over the splits of the file, finds without a range join.

Defined results: null html is an empty payload; null urls are left out of the header; line breaks in urls are
percent-encoded. Rows with the same page_id and payload are one response each. A file that is torn or padded
keeps the records before the damage. An empty table gives an empty result. Intermediate tables are deleted; archives stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch, materialise, new_path

LEAST = 100
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
FILE_ROWS = 50_000
MAP_BITS = 24

_CANDIDATE = "file string, split long, seq long, bytes long, own long, page_id long, kind string, refers_to long, digest string, payload_bytes long, actual string, whole boolean"
_NAMES = [x.split()[0] for x in _CANDIDATE.split(", ")]
_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def _digests(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """The pages with payloads and digests, and the smallest page_id of each digest that two page_ids share."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.where(f"payload_bytes >= {LEAST}").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    return rows, first


def dedup_plan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null for responses) of each page.

    Only payloads whose digest hits a bitmap of 2**``MAP_BITS`` bits over the repeated digests are moved to the join that
    names their response; the bitmap's size is fixed, and what passes it by chance finds no partner.
    """
    rows, first = _digests(pages, id_col, html_col, url_col)
    place = F.conv(F.substring("digest", 1, MAP_BITS // 4), 16, 10).cast("long")
    first = materialise(first, "repeated")
    bits = first.select(place.alias("_place")).select(F.shiftrightunsigned("_place", 6).alias("_word"), F.expr("shiftleft(1L, CAST(_place & 63 AS INT))").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # at most 2**18 words of 64 bits, whatever the table
    marked = rows.withColumn("_place", place).withColumn("_word", F.shiftrightunsigned("_place", 6)).join(F.broadcast(bits), "_word", "left")
    marked = marked.withColumn("_hit", F.coalesce(F.expr("getbit(_bits, CAST(_place & 63 AS INT)) = 1"), F.lit(False)))
    columns = ["page_id", "url", "payload", "payload_bytes", "digest"]
    alone = marked.where("not _hit").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    met = marked.where("_hit").select(*columns).join(first, "digest", "left")
    return alone.unionByName(met.withColumn("refers_to", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id"))).drop("first_id"))


def write(plan: DataFrame, path: str, compression: str = "none") -> None:
    """Archives of the planned records under ``path``, each a run of complete records; with ``none`` their files can be read in splits."""
    plan = plan.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit("")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
    )
    plan.select(F.concat(header, F.col("payload")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_ROWS).option("compression", compression).text(path)


def _header(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, header bytes and content length of a candidate whose bytes follow the version line."""
    at = piece.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {k.decode(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(piece[: at + 2])}
    size = fields.get("Content-Length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 15 or "WARC-Record-ID" not in fields or "WARC-Type" not in fields:
        return None
    return fields, at + 4, int(size)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def _candidates(batches):
    """Pieces between version lines, with what their headers say; ``own`` is the successor's distance, null without a header."""
    last, seq = None, 0
    for batch in batches:
        out: list[tuple] = []
        for file, split, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seq = seq + 1 if last == (file, split) else 0
            last = (file, split)
            found = _header(piece)
            if found is None:
                out.append((file, split, seq, len(piece), None, None, None, None, None, None, None, False))
                continue
            fields, begin, size = found
            whole = len(piece) == begin + size + len(END) and piece.endswith(END.encode())
            actual = hashlib.sha256(piece[begin : begin + size]).hexdigest() if whole else None
            out.append((file, split, seq, len(piece), len(MAGIC) + begin + size + len(END), _page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"), size, actual, whole))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _bodies(batches):
    last, seq = None, 0
    for batch in batches:
        keys = []
        for file, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seq = seq + 1 if last == (file, split) else 0
            last = (file, split)
            keys.append(seq)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64()), batch.column(2)], names=["file", "split", "seq", "value"])


def _joined(group: pa.Table) -> pa.Table:
    """One record from its pieces: the payload's digest if the pieces hold all of it."""
    rows = group.sort_by("at").to_pylist()
    data = MAGIC.encode().join(r["value"] for r in rows)
    _, begin, size = _header(rows[0]["value"])
    body = data[begin : begin + size]
    ok = len(body) == size and data[begin + size : begin + size + len(END)] == END.encode()
    return pa.table({"file": [rows[0]["file"]], "start": pa.array([rows[0]["start"]], pa.int64()), "joined": pa.array([hashlib.sha256(body).hexdigest() if ok else None], pa.string())})


def reachable(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the records that the chain from offset 0 of each file reaches; ``links`` is (file, at, next)."""
    jump = scratch.keep(links, "jump")
    reach = scratch.keep(jump.where("at = 0").select("file", "at"), "reach")
    seen = reach.count()
    while seen:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = scratch.keep(reach.unionByName(step.join(links.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reach")
        scratch.drop(reach)
        reach, before, seen = grown, seen, grown.count()
        if seen == before:
            break
        twice = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        doubled = scratch.keep(jump.join(twice, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jump")
        scratch.drop(jump)
        jump = doubled
    scratch.drop(jump)
    return reach


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, kind, refers_to, digest (as the header has it), payload_bytes (of the record), actual (of the bytes) of each true record."""
    scratch = Scratch()
    pieces = scratch.keep(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    splits = pieces.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("span"))
    # windows are over the splits of a file, or over the pieces of a split
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "split", F.coalesce(F.sum("span").over(earlier), F.lit(0)).alias("base"))
    # the first piece of a file stands before its first version line; a piece begins one version line after its candidate
    placed = pieces.withColumn("run", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(inside), F.lit(0)))
    placed = placed.join(base, ["file", "split"]).withColumn("at", F.col("base") + F.col("run") - len(MAGIC)).where("at >= 0").drop("base", "run")
    # a run: consecutive candidates of a split whose successor is the next piece, and the piece that breaks the row; all of its
    # members lead to one exit, so the chain jumps from run to run
    runs = scratch.keep(placed.withColumn("run", F.coalesce(F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(inside), F.lit(0))), "runs")
    scratch.drop(pieces)
    exits = runs.groupBy("file", "split", "run").agg(F.max_by(F.struct("at", "own"), "seq").alias("last")).select("file", "split", "run", F.expr("last.at + coalesce(last.own, 0)").alias("next"))
    exits = scratch.keep(exits, "exits")
    doors = exits.select("file", F.col("next").alias("at")).unionByName(exits.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    entries = runs.where("own is not null").select("file", "at", "split", "run").join(doors, ["file", "at"], "left_semi")
    links = scratch.keep(entries.join(exits, ["file", "split", "run"]).select("file", "at", "next", "split", "run"), "links")
    entered = reachable(links.select("file", "at", "next"), scratch).join(links, ["file", "at"]).groupBy("file", "split", "run").agg(F.min("at").alias("entry"))
    real = F.coalesce(F.col("own").isNotNull() & (F.col("at") >= F.col("entry")), F.lit(False))
    judged = scratch.keep(runs.join(entered, ["file", "split", "run"], "left").withColumn("real", real).drop("entry", "run"), "judged")
    out = ["page_id", "kind", "refers_to", "digest", "payload_bytes", "actual"]
    if judged.where("real and not whole").isEmpty():
        records = materialise(judged.where("real and actual is not null").select(*out), "records")
    else:
        owner = F.when(F.col("real"), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("own")).alias("stop"), F.col("whole").alias("closed")))
        carried = judged.groupBy("file", "split").agg(F.max(owner).alias("top")).withColumn("carry", F.max("top").over(earlier)).drop("top")
        owned = judged.withColumn("owner", F.max(owner).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(carried, ["file", "split"])
        owned = owned.withColumn("owner", F.coalesce("owner", "carry")).where("not owner.closed and at < owner.stop")
        parts = owned.select("file", "split", "seq", "at", "owner.start")
        raw = _pieces(spark, path).mapInArrow(_bodies, "file string, split long, seq long, value binary").join(parts, ["file", "split", "seq"])
        joined = raw.groupBy("file", "start").applyInArrow(_joined, "file string, start long, joined string").withColumnRenamed("start", "at")
        full = judged.where("real").join(joined, ["file", "at"], "left").withColumn("actual", F.coalesce("actual", "joined"))
        records = materialise(full.where("actual is not null").select(*out), "records")
    scratch.clear()
    return records


def round_trip(spark: SparkSession, pages: DataFrame, compression: str = "none") -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and resolve revisits through their responses."""
    path = new_path(spark, "archive")
    write(dedup_plan(pages), path, compression)
    records = read(spark, path)
    responses = records.where("kind = 'response'").groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("full_bytes")).select(F.col("page_id").alias("refers_to"), "digest", "full_bytes")
    out = records.join(responses, ["refers_to", "digest"], "left")
    size = F.when(F.col("kind") == "revisit", F.col("full_bytes")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("actual"))
    return out.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
