import hashlib

import pytest
from pyspark.sql import functions as F

from raritas.llm import warc

BIG, OTHER = "<p>ä\r\n\r\nx</p>" * 120, "<b>other</b>" * 120
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nv", None), (7, "", ""), (8, "x", OTHER), (None, "n", BIG), (10, "y", OTHER), (10, "y", OTHER)]


def expected(rows):
    groups = {}
    for key, _, html in rows:
        if len((html or "").encode()) >= 1000 and key is not None:
            groups[html] = max(groups.get(html, key), key)
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        response = groups.get(html) if len(raw) >= 1000 else None
        revisit = response is not None and key != response
        out.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", response if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [0, 1000])
def test_round_trip(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    out = warc.archive_pages(pages, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, out), key=repr) == expected(ROWS)


def test_payloads_of_selected_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 300)) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(warc.mark_revisits(pages, "page_id", "url", "html"), f"file://{tmp_path}", archive_bytes=20_000)
    assert index.select("file").distinct().count() > 3
    chosen = index.where("key % 7 = 0")
    out = {r["key"]: r["payload"] for r in warc.read_archives(chosen, f"file://{tmp_path}", gap=0, most=500, payloads=True).collect()}
    assert {k: bytes(v).decode() for k, v in out.items()} == {k: h for k, _, h in rows if k % 7 == 0}


def test_archives_are_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(warc.mark_revisits(pages, "page_id", "url", "html"), f"file://{tmp_path}")
    assert index.select("file").distinct().count() == 1
    whole = next((tmp_path / "archives").iterdir()).read_bytes()
    for row in index.collect():
        fields, _, payload = warc.parse_record(whole[row.offset : row.offset + row.length])
        assert fields["WARC-Payload-Digest"] == f"sha1:{row.digest}" and fields["WARC-Target-URI"] == row.url
        assert fields["WARC-Type"] == "revisit" or hashlib.sha1(payload).hexdigest() == row.digest


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("b", 0, 10)]
    assert list(warc.coalesced(rows, 5, 1000)) == [("a", 0, 30, [0, 1, 2]), ("a", 100, 110, [3]), ("b", 0, 10, [4])]
    assert [r[3] for r in warc.coalesced(rows, 5, 20)] == [[0, 1], [2], [3], [4]]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages, f"file://{tmp_path}").isEmpty()
