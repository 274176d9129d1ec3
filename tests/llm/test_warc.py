import hashlib

import pytest
import zstandard

from vacantia.llm import warc
from vacantia.scratch import fresh_folder


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, digest string, archive string"
    return spark.createDataFrame([(*row, "x", "y") for row in rows], schema).repartition(3)


def plain(rows):
    digests = [hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows]
    found = []
    for (page, _, html), digest in zip(rows, digests):
        size = len((html or "").encode())
        same = [p for (p, _, _), d in zip(rows, digests) if d == digest and p is not None]
        revisit = size >= 100 and bool(same) and page != min(same)
        found.append((page, size, digest, "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(found, key=str)


def columns(rows):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


LONG = "é<p>" * 60


def test_round_trip_and_edges(spark):
    rows = [
        (5, "http://a/ b\n", LONG), (3, "http://a/é", LONG), (9, None, LONG), (None, "u", LONG),
        (3, "http://a/é", LONG), (1, "u", None), (2, "u", ""), (4, "", "short"), (6, "u", "short"),
        (-7, "u", "x" * 300_000), (2**62, "u", "x" * 300_000), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
    ]
    got = warc.round_trip(spark, pages_of(spark, rows)).collect()
    assert columns(got) == plain(rows)
    assert warc.round_trip(spark, pages_of(spark, [])).collect() == []


def test_payloads_without_any_id_are_responses(spark):
    rows = [(None, "u", LONG), (None, "v", LONG)]
    got = warc.round_trip(spark, pages_of(spark, rows)).collect()
    assert columns(got) == plain(rows) and {r["record_type"] for r in got} == {"response"}


def test_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in table.collect()]
    assert columns(warc.round_trip(spark, table).collect()) == plain(rows)


def test_dictionary_leads_and_every_record_is_its_own_frame(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").coalesce(1)
    folder = fresh_folder(spark, "warc")
    manifest = warc.write_archives(table, folder, archive_bytes=50_000).collect()
    assert sum(m["records"] for m in manifest) == table.count() and len(manifest) > 1
    for entry in manifest:
        with open(entry["archive"], "rb") as file:
            data = file.read()
        assert len(data) == entry["bytes"] and data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        at, records = 8 + size, 0
        while at < len(data):
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = one.decompress(data[at:])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            at, records = len(data) - len(one.unused_data), records + 1
        assert records == entry["records"]
        bare = zstandard.ZstdDecompressor().decompressobj()
        with pytest.raises(zstandard.ZstdError):
            bare.decompress(data[8 + size :])


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    wrong = warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False)
    pack = zstandard.ZstdCompressor().compress
    for name, data in (("wrong", pack(wrong)), ("cut", pack(good[:-9]))):
        (tmp_path / name).write_bytes(data)
        manifest = spark.createDataFrame([(str(tmp_path / name),)], "archive string")
        with pytest.raises(Exception, match="differs from its digest|cut off"):
            warc.read_archives(manifest).collect()
    (tmp_path / "good").write_bytes(pack(good) + pack(good))
    manifest = spark.createDataFrame([(f"file:{tmp_path}/good",)], "archive string")
    assert [r["page_id"] for r in warc.read_archives(manifest).collect()] == [1, 1]


def test_record_ids_hold_any_page():
    for page in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(page)) == page
