"""Archives written, indexed and read back."""

import hashlib
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from martwright.llm import warc
from martwright.session import shared_folder

COLUMNS = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}?q={i}", f"<p>{i % 50}</p>" * 200) for i in range(300)]
    rows += [(1000 + i, "http://hot.example.com/", "x" * 1200) for i in range(60)]
    return rows + [(2000, None, None), (2001, "no scheme\r\nnext", ""), (2002, "HTTP://User@Big.Example.COM:80/é", "é" * 600), (2003, "", "é" * 600), (2004, "u", "é" * 499), (2005, "u", "é" * 499), (2006, "long", "y" * 300_000)]


def test_equals_statement(spark):
    frame = spark.createDataFrame(pages(), COLUMNS).selectExpr("*", "1 AS key", "'x' AS digest", "2 AS page").repartition(4)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages())
    want = sorted(duck.execute(warc.oracle()).fetchall(), key=lambda r: r[0])
    got = sorted((tuple(r) for r in warc.archive_round_trip(frame).collect()), key=lambda r: r[0])
    assert got == want


@pytest.mark.parametrize(
    "url, key",
    [("http://www.Example.com/a?b", "com,example,www)/a?b"), ("https://u:p@x.org:443/", "org,x)/"), ("http://x.org:8080", "org,x:8080)"), ("plain", ")plain"), (None, ")")],
)
def test_keys(url, key):
    assert warc.surt(url) == key


def test_lookup_reads_only_what_is_asked(spark):
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    files, root = warc._opened(folder)
    files.create_dir(root, recursive=True)
    frame = spark.createDataFrame(pages(), COLUMNS).repartition(3)
    index = warc.write_index(warc.write_archives(frame, folder), folder, block_lines=7)
    wanted = spark.createDataFrame([("http://h3.example.com/p/3?q=3", 3), ("http://hot.example.com/", 1005), ("http://nowhere/", 1), (None, 2000)], "url string, page long")
    places = warc.look_up(wanted, index, folder)
    assert sorted(r["page"] for r in places.collect()) == [3, 1005, 2000]
    records = {r["page"]: r for r in warc.read_records(places, folder).collect()}
    assert (records[1005]["kind"], records[1005]["original"], records[1005]["bytes"]) == ("revisit", 1059, None)
    assert records[2000]["digest"] == hashlib.sha1(b"").hexdigest()


def test_equal_lines_over_many_blocks(spark):
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    files, root = warc._opened(folder)
    files.create_dir(root, recursive=True)
    frame = spark.createDataFrame([(5, "u", f"body {i}") for i in range(40)] + [(4, "u", "before"), (6, "u", "after")], COLUMNS)
    index = warc.write_index(warc.write_archives(frame, folder), folder, block_lines=3)
    found = warc.look_up(spark.createDataFrame([("u", 5), ("u", 5)], "url string, page long"), index, folder)
    assert found.count() == 40 and {r["page"] for r in found.collect()} == {5}


def test_odd_rows(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(None, "a", "z" * 2000), (7, "a", "z" * 2000), (7, "a", "z" * 2000), (None, None, None)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, COLUMNS)).orderBy(F.desc_nulls_last("page_id"), F.desc("payload_bytes")).collect()
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found] == [(7, 2000, "response", None), (7, 2000, "response", None), (None, 2000, "revisit", 7), (None, 0, "response", None)]
