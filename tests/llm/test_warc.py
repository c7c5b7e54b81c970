"""Archives: contract against SQL, exact round trips, and lookups through the two-level index."""

from __future__ import annotations

import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from loreseek.llm import common, warc

LONG = "<html>" + "x" * 200
SCHEMA = "page_id long, url string, html string"
ROWS = [
    (3, "https://www.Example.org/a?q=1", LONG),
    (1, "http://example.org:80/", LONG),
    (2, "http://example.org/ä b", LONG + "é😀"),
    (4, None, "short"),
    (5, "not a url", "short"),
    (6, "http://b.example.org/", None),
    (7, "", ""),
    (8, "http://example.org/\r\nX-Evil: 1", LONG),
    (8, "http://example.org/\r\nX-Evil: 1", LONG),
    (None, "http://example.org/none", LONG),
    (None, None, None),
    (9, "http://example.org:8080/\r\n\r\n", "\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    (10, "https://[broken/", "y" * 99),
    (11, "https://[broken/", "y" * 99),
    (12, "http://example.org/long", "é" * 2_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("digest", "key", "type", "file", "at", "size", "first", "n", "refers_to", "payload_bytes", "record_type")})


@pytest.fixture(scope="module")
def captures(spark, pages):
    return warc.Captures(spark).write(pages)


def test_same_as_sql(pages, same_in_duckdb):
    same_in_duckdb(warc.through_archives(pages), warc.WARC_SQL, pages=pages.select("page_id", "url", "html"))


def test_payloads_come_back(spark, captures):
    wanted = {r[0]: (r[2] or "").encode() for r in ROWS}
    seen = 0
    for row in captures.scratch.read("entries").select("file").distinct().collect():
        for headers, payload in warc.members(captures.folder, row["file"]):
            seen += 1
            page_id = headers.get("x-page-id")
            if page_id and headers["warc-type"] == "response":
                assert payload == wanted[int(page_id)]
            if headers["warc-type"] == "revisit":
                assert payload == b"" and wanted[int(headers["x-refers-to-page-id"])] == LONG.encode()
                assert headers["warc-refers-to"] == warc.record_id(1, "http://example.org:80/", hashlib.sha256(LONG.encode()).hexdigest()) and headers["warc-refers-to-target-uri"] == "http://example.org:80/"
    assert seen == len(ROWS)


def test_index_blocks_are_sorted_and_whole(captures):
    store, folder = fs.FileSystem.from_uri(captures.folder)
    lines = []
    for row in captures.files.orderBy("first_key", "last_key").collect():
        with store.open_input_file(f"{folder}/{row['file']}") as f:
            directory = warc.Directory(f, row["blocks"], row["places_at"])
            for k in range(row["blocks"]):
                entry = directory.entry(k)
                block = directory.block(entry)
                assert (block[0][0], block[-1][0], len(block)) == entry[:3] and entry[2] <= warc.LINES
                lines += block
    assert len(lines) == len(ROWS) and [x[0] for x in lines] == sorted(x[0] for x in lines)


def test_lookup_gives_revisits_their_payload_under_any_url(captures):
    for url in {r[1] for r in ROWS if r[1]}:
        found = list(captures.lookup(url))
        assert len(found) == sum(r[1] == url for r in ROWS)
        for headers, payload in found:
            assert hashlib.sha256(payload).hexdigest() == headers["warc-payload-digest"].removeprefix("sha256:")
    assert list(captures.lookup("http://example.org/absent")) == []


def test_lookup_over_many_blocks(spark, monkeypatch):
    rows = [(k, f"http://h{k % 7}.example.org/{'same' if k % 3 else k}", f"page {k}" * 20) for k in range(9000)]
    captures = warc.Captures(spark).write(spark.createDataFrame(rows, SCHEMA))
    assert captures.files.agg(F.sum("blocks")).first()[0] >= 18
    for url in ("http://h3.example.org/same", "http://h0.example.org/0", "http://h6.example.org/2994"):
        wanted = sorted(r[2] for r in rows if r[1] == url)
        assert sorted(p.decode() for _, p in captures.lookup(url)) == wanted
    # The directory is searched, not read.
    store, folder = fs.FileSystem.from_uri(captures.folder)
    row = captures.files.orderBy(F.desc("blocks")).first()
    with store.open_input_file(f"{folder}/{row['file']}") as f:
        directory = warc.Directory(f, row["blocks"], row["places_at"])
        assert list(directory.lines("org,example,h0)/0a")) == [] and directory.read <= row["blocks"].bit_length() + 2


@pytest.mark.parametrize("hot", [1, 100_000])
def test_hot_digests(spark, same_in_duckdb, monkeypatch, hot):
    monkeypatch.setattr(warc, "join_hot", lambda rows, one, key: common.join_hot(rows, one, key, hot))
    pages = spark.createDataFrame([(k if k % 5 else None, f"u{k % 50}", LONG if k % 3 else f"{k % 40}" * 60) for k in range(400)], SCHEMA)
    same_in_duckdb(warc.through_archives(pages), warc.WARC_SQL, pages=pages)


def test_ranges_read_neighbours_together(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 10)
    (tmp_path / "a").write_bytes(bytes(range(100)))
    (tmp_path / "b").write_bytes(bytes(range(50)))
    places = [("a", 0, 4), ("a", 4, 4), ("a", 8, 4), ("a", 50, 30), ("b", 1, 2), ("b", 40, 10)]
    assert list(warc.ranges(iter(places), f"file://{tmp_path}")) == [bytes(range(at, at + n)) for _, at, n in places]


def test_folders():
    with pytest.raises(ValueError):
        warc.opened("viewfs://cluster/x")
    assert warc.opened("file:///tmp/x")[1] == "/tmp/x"


def test_keys():
    assert warc.surt("https://www.Example.org/a?q=1") == "org,example,www)/a?q=1"
    assert warc.surt("http://example.org:80/") == "org,example)/" and warc.surt("http://example.org:8080") == "org,example:8080)/"
    assert warc.surt(None) == warc.surt("") == "" and warc.surt("not a url") == "not a url" and warc.surt("https://[broken/") == "https://[broken/"


def test_files_roll(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ROLL", 1000)
    files = warc._Files(f"file://{tmp_path}", ".x")
    places = [files.add(b"x" * 400) for _ in range(10)]
    files.close()
    assert len({p[0] for p in places}) > 2 and all((tmp_path / p[0]).stat().st_size >= p[1] + p[2] for p in places)


def test_empty(spark):
    assert warc.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0
