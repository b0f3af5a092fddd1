"""Archives come back as written, whatever the payloads hold."""

import hashlib
import os

import duckdb
import pytest

from triloom.llm import queries, runtime, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
LONG = "<p>é😀</p>" * 30
PAGES = [
    (1, "http://a", "plain"), (2, None, None), (3, "http://b\r\nX: y", ""), (4, "u", LONG), (5, "u", LONG), (6, "u", "plain"), (7, "u", FAKE), (8, "u", FAKE + FAKE), (9, "u", "WARC/1.1\r\n"),
    (10, "u", "x WARC/1.1\r\nWARC-Type: response\r\nno end"), (11, "u", "\r\n\r\n"), (12, "u", "WARC/1.1\r\n\r\n\r\n\r\n" + LONG), (13, "u", LONG), (14, "u", FAKE), (15, "u", "tail WARC/1.1\r"), (16, "u", FAKE[:-4]),
]


def expected(pages):
    first = {}
    for i, _, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault(html or "", i)
    out = {}
    for i, _, html in pages:
        body = (html or "").encode()
        other = first[html or ""] if len(body) >= 100 and first[html or ""] < i else None
        out[i] = (len(body), hashlib.sha256(body).hexdigest(), "revisit" if other else "response", other)
    return out


@pytest.mark.parametrize(("limit", "compression"), [("134217728", "gzip"), ("134217728", "none"), ("300", "none")])
def test_round_trip(spark, limit, compression):
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    try:
        pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
        got = {r[0]: tuple(r[1:]) for r in warc.round_trip(spark, pages, compression).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected(PAGES)


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_torn_file_keeps_what_comes_before(spark, tmp_path):
    warc.write(warc.dedup_plan(spark.createDataFrame(PAGES[:6], "page_id long, url string, html string").coalesce(1)), str(tmp_path / "a"), "none")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(data[:-30])
    got = warc.read(spark, str(tmp_path / "b")).count()
    assert got == 5


def test_query_reads_a_file_in_several_splits(spark, tmp_path):
    """The registered query itself, over few files that are cut into many splits, against the same in DuckDB."""
    rows = [(k, f"http://h{k % 7}/{k}", (LONG if k % 3 else FAKE * (k % 5)) + str(k % 11)) for k in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    before = set(tables(spark))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        out = queries.op9_warc_boundary_chain(spark, str(tmp_path))
        got = {r[0]: tuple(r[1:]) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
        archive = next(t for t in set(tables(spark)) - before if "/archive-" in t)
        cut = warc._pieces(spark, archive).select("file", "split").distinct().groupBy("file").count().agg({"count": "max"}).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected(rows) and cut > 3
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in duck.sql(queries.WARC_SQL).fetchall()} == got
    assert {t.rsplit("/", 1)[1].split("-")[0] for t in set(tables(spark)) - before} == {"archive", "records", "repeated"}


def tables(spark):
    root = f"{runtime.shared_dir(spark)}/triloom/{spark.sparkContext.applicationId}"
    return [os.path.join(root, name) for name in os.listdir(root)] if os.path.isdir(root) else []
