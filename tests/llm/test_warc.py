"""Archives: a round trip against plain grouping, single members at their offsets, revisit rules."""

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyarrow import fs

from shelfsight.llm import warc
from shelfsight.llm.common import shared_folder

ROWS = [
    (5, "http://a/", None), (3, None, ""), (9, "x\ny", "<p>é"), (9, "x", "<p>é"), (1, "z ", "<p>é"), (None, "n", "<p>é"), (None, "m", "no id"), (None, "k", "no id"), (7, '"q"', "A" * 3_000_000),
    (8, "b", "A" * 3_000_000), (11, "http://b/ä?x", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (3, None, ""), (12, "", "one"), (12, "", "two"), (13, "", "two"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    ids = defaultdict(list)
    for page, _, html in rows:
        ids[(html or "").encode()].append(page)
    out = []
    for page, url, html in rows:
        body = (html or "").encode()
        first = min((p for p in ids[body] if p is not None), default=None)
        revisit = first is not None and page != first and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, url, "revisit" if revisit else "response", len(body), digest, first if revisit else None, None if revisit else body))
    return sorted(out, key=str)


def taken(df):
    return sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in df.collect()), key=str)


def test_round_trip_equals_grouping(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert taken(warc.round_trip(pages)) == brute(ROWS)
    assert taken(warc.round_trip(pages, least_bytes=5)) == brute(ROWS, 5)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_other_columns_and_names(spark):
    pages = spark.createDataFrame([(1, "u", "h", "clash", "x")], "id long, link string, body string, payload string, revisits string")
    assert taken(warc.round_trip(pages, "id", "link", "body")) == brute([(1, "u", "h")])


def test_members_stand_at_their_offsets(spark):
    folder = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    files = warc.write(pages, folder, archive_bytes=1_000_000)
    assert files.count() > 1  # a task begins another archive when one is full
    system, _ = fs.FileSystem.from_uri(folder)
    for row in warc.normalise(files, folder).collect():
        with system.open_input_stream(row["index"], compression=None) as lines:
            places = [line.split() for line in lines.read().decode().splitlines()]
        assert len(places) == row["records"]
        with system.open_input_file(row["path"]) as archive:
            whole = archive.read()
        assert sum(int(p[1]) for p in places) == len(whole)
        for offset, length, kind, name in places:
            record = gzip.decompress(whole[int(offset) : int(offset) + int(length)])
            fields = warc.header(record[: record.index(b"\r\n\r\n") + 4])
            assert (fields["warc-type"], fields["warc-record-id"]) == (kind, name)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_a_member_written_twice_inflates_as_one_stream(tmp_path):
    first, second = (warc.record(k, "u", b"x" * 10 * k, warc.payload_digest(b"x" * 10 * k), None, False) for k in (1, 2))
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(first) + gzip.compress(second))
    with open(path, "rb") as stream:
        inflated = warc.Inflated(stream)
        heads = []
        while head := inflated.until(b"\r\n\r\n"):
            heads.append(warc.header(head))
            b"".join(inflated.pieces(int(heads[-1]["content-length"]) + 4))
    assert [h["x-page-id"] for h in heads] == ["1", "2"]


def test_folders_as_hadoop_names_them():
    for uri in ("file:/a/b c", "file:///a/b c", "/a/b c"):
        system, path = warc.store(uri)
        assert (type(system), path) == (fs.LocalFileSystem, "/a/b c"), uri
    with pytest.raises(ValueError, match="wasb"):
        warc.arrow_uri("wasb://a@b/c")
    for uri, want in (("s3a://bucket/shared/x", "s3://bucket/shared/x"), ("hdfs://node:8020/x", "hdfs://node:8020/x"), ("gs://bucket/x", "gs://bucket/x"), ("abfss://c@a.dfs.core.windows.net/x", "abfss://c@a.dfs.core.windows.net/x")):
        assert warc.arrow_uri(uri) == want


def test_a_hot_id_keeps_a_response_for_each_payload(spark):
    rows = [(None if k % 3 else 7, "u", f"body {k % 400}") for k in range(2400)] + [(k, "v", f"body {k}") for k in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    told = warc.decisions(pages, "page_id", "html", 0)
    assert told.count() == told.select("page", "digest").distinct().count()
    assert taken(warc.round_trip(pages)) == brute(rows)
