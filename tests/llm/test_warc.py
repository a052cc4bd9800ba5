"""WARC archives: round trips, revisits, byte ranges, damaged records."""

import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, offset int, payload string"
SAME = "<p>" + "same words " * 20 + "</p>"
ROWS = [
    (5, "http://a.example/5", SAME),
    (2, "http://a.example/2", SAME),
    (9, "http://b.example/é?q=1", SAME),
    (9, "http://b.example/é?q=1", SAME),
    (None, "http://c.example/none", SAME),
    (11, "http://a.example/11", "short"),
    (12, "http://a.example/12", "short"),
    (13, None, None),
    (14, "", ""),
    (15, "http://a.example/a b\r\nWARC-Type: evil", "line\r\n\r\nWARC/1.1\r\n\r\n é 漢"),
    (16, "http://a.example/long", "x<b>" * 400_000),
    (17, "u", "a" * 99 + "é"),
    (18, "v", "a" * 99 + "é"),
    (19, "w", "b" * 99),
    (20, "w", "b" * 99),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], SCHEMA).repartition(3)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        low = first.get(html, i)
        kind = "response" if i == low else "revisit"
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), kind, None if i == low else low))
    return sorted(out, key=repr)


def test_pages_come_back(pages):
    out = warc.archive_pages(pages)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(ROWS)


def test_payloads_and_addresses_come_back(pages):
    index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_records(index.where("record_type = 'response'")).collect()}
    by_id = {i: (url, html) for i, url, html in ROWS}
    assert got[2].payload == SAME and got[15].payload == by_id[15][1] and got[16].payload == by_id[16][1]
    assert got[13].payload == "" and got[13].url is None and got[14].url == ""
    assert got[15].url == "http://a.example/a%20b%0D%0AWARC-Type:%20evil"
    assert got[17].payload.endswith("é") and 9 not in got


def test_archives_are_plain_warc_files(spark, pages, tmp_path):
    """Each file is a chain of gzip members: a warcinfo, then the records at the places of the index."""
    index = warc.write_archives(pages, str(tmp_path), archive_bytes=300).collect()
    files = sorted(tmp_path.glob("*.warc.gz"))
    assert len(files) >= 3 and {r.archive.rpartition("/")[2] for r in index} == {f.name for f in files}
    for f in files:
        raw = f.read_bytes()
        whole = gzip.decompress(raw)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        own = sorted((r.offset, r.length) for r in index if r.archive.endswith(f.name))
        assert own[-1][0] + own[-1][1] == len(raw)
        for at, n in own:
            fields, block = warc.parse_record(gzip.decompress(raw[at : at + n]))
            assert fields["WARC-Type"] in ("response", "revisit") and int(fields["Content-Length"]) == len(block)


def test_selection_reads_only_named_records(pages):
    index = warc.write_archives(pages)
    got = warc.read_records(index.where(F.col("url").startswith("http://b.")))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got.collect()] == [(9, "revisit", 2)] * 2


def test_runs_cover_every_range_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 500, 300)
    offsets = np.cumsum(lengths + rng.choice([0, 10, 5000], 300)) - lengths
    for gap, most in ((0, 1 << 20), (100, 2000), (10**6, 700)):
        runs = warc.byte_runs(offsets, lengths, gap, most)
        assert [k for i, j in runs for k in range(i, j)] == list(range(300))
        for i, j in runs:
            assert j == i + 1 or offsets[j - 1] + lengths[j - 1] - offsets[i] <= most
            assert all(offsets[k] - offsets[k - 1] - lengths[k - 1] <= gap for k in range(i + 1, j))
    assert warc.byte_runs(offsets[:0], lengths[:0]) == []


def test_damage_is_an_error(spark, pages, tmp_path):
    index = warc.write_archives(pages.where("page_id = 11"), str(tmp_path))
    for f in Path(tmp_path).glob("*.warc.gz"):
        raw = gzip.decompress(f.read_bytes())
        assert raw.count(b"short") == 1
    row = index.first()
    record = warc.page_record(11, row.url, b"other", row.payload_digest)
    Path(tmp_path / "bad.warc.gz").write_bytes(gzip.compress(record))
    bad = spark.createDataFrame(
        [(f"file://{tmp_path}/bad.warc.gz", 0, len(gzip.compress(record)), 11, row.url, "response", row.payload_digest)],
        warc.INDEX.format(id="long"),
    )
    with pytest.raises(Exception, match="not the one of the index"):
        warc.read_records(bad).collect()
    with pytest.raises(ValueError, match="whole WARC record"):
        warc.parse_record(record[:-3])


def test_all_ids_null_text_ids_and_empty(spark, pages):
    none = spark.createDataFrame([(None, "a", SAME), (None, "b", SAME)], "page_id long, url string, html string")
    assert [(r.record_type, r.refers_to) for r in warc.archive_pages(none).collect()] == [("response", None)] * 2
    text = spark.createDataFrame([("b", "u", SAME), ("a: é\r\n", "u", SAME)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_pages(text).collect()} == {("a: é\r\n", None), ("b", "a: é\r\n")}
    assert warc.archive_pages(pages.limit(0)).count() == 0
