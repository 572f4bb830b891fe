"""The content-addressed archive: exact round trips, and which record refers to which."""

import hashlib
from collections import Counter

import pytest

from tablelens.llm.archive import (
    archive_pages,
    original_records,
    page_captures,
    parse_record,
    read_warc_files,
    write_warc_files,
)
from tablelens.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, digest string, record string, size int"
LONG, OTHER = "<p>ñ</p>" * 20, "x" * 100
PAGES = [
    (7, "http://a/7", LONG),
    (3, "http://a/3\r\nX-Page-Id: 99", LONG),
    (3, "http://a/3", LONG),
    (5, None, "y" * 99),
    (6, "http://a/6", "y" * 99),
    (8, "http://a/8", None),
    (9, "http://a/9", ""),
    (10, "http://a/10", OTHER),
    (10, "http://a/10", OTHER),
    (None, "http://a/none", OTHER),
    (None, "http://a/none", "z" * 120),
    (12, "http://a/12", "one\r\n\r\ntwo" * 50_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "r", 1) for r in rows], SCHEMA)


def expected(rows):
    """Brute force: rows in order, the first of each shared payload is the response."""
    first, found = {}, Counter()
    for id, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        first.setdefault(digest, id)
        found[id, len(data), digest, "revisit" if again else "response", first[digest] if again else None] += 1
    return found


def captures(spark, rows, place):
    archive = archive_pages(pages(spark, rows), place)
    files = write_warc_files(original_records(spark, archive), place, file_bytes=300)
    return archive, files, page_captures(read_warc_files(files))


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_pages_against_brute_force(spark, tmp_path):
    archive, files, got = captures(spark, PAGES, str(tmp_path))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == expected(PAGES)
    assert sum(r.n_records for r in files.collect()) == len(PAGES)
    headers, payloads = archive.read(spark)
    assert payloads.count() == payloads.select("digest").distinct().count() == 4
    assert headers.count() == headers.select("record").distinct().count() == len(PAGES)


def test_records_come_back_whole(spark, tmp_path):
    archive = archive_pages(pages(spark, PAGES), str(tmp_path))
    heads = {r.record: bytes(r.head) for r in archive.read(spark)[0].collect()}
    for r in original_records(spark, archive).collect():
        fields, block = parse_record(bytes(r.bytes))
        assert bytes(r.bytes).startswith(heads[r.record]) and int(fields["content-length"]) == len(block)
        assert fields["x-page-id"] != "99" if "x-page-id" in fields else True
    files = write_warc_files(original_records(spark, archive), str(tmp_path))
    back = read_warc_files(files).where("refers IS NULL").select("page_id", "payload").collect()
    want = {(p, hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in PAGES}
    assert {(r.page_id, hashlib.sha256(bytes(r.payload)).hexdigest()) for r in back} <= want


def test_a_payload_with_another_digest_is_refused(spark, tmp_path):
    archive, _, _ = captures(spark, PAGES, str(tmp_path))
    records = original_records(spark, archive).collect()
    broken = [(bytes(r.bytes).replace(b"<p>", b"<q>"),) for r in records]
    files = write_warc_files(spark.createDataFrame(broken, "bytes binary"), str(tmp_path / "broken"))
    with pytest.raises(Exception, match="another digest"):
        read_warc_files(files).collect()


def test_hot_payload_and_hot_row(spark, tmp_path, hot):
    hot(3)
    rows = [(i, f"u{i}", LONG) for i in range(40)] + [(50, "u", LONG)] * 25
    _, _, got = captures(spark, rows, str(tmp_path))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == expected(rows)


def test_no_pages(spark, tmp_path):
    _, files, got = captures(spark, [], str(tmp_path))
    assert files.collect() == [] and got.collect() == []


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op11_content_archive"](spark, folder).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == expected(rows)
