"""WARC archives with a Zstandard dictionary.

An archive is a leading skippable frame that holds a dictionary trained on archived records,
then one Zstandard frame per record, so a record can be read by itself.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.scratch import fresh_folder, stage
from vacantia.sources.commit_log import qualified

# --- fixed values: the archive format ---
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
# --- end of fixed values ---
DICTIONARY_BYTES = 1 << 16
# The dictionary is trained on so many records at most, each no longer than this.
SAMPLE_RECORDS = 512
SAMPLE_RECORD_BYTES = 1 << 17
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
CAPTURED = "1970-01-01T00:00:00Z"  # pages carry no time of capture


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page's number and whether there is one."""
    value = 1 << 64 if page_id is None else page_id & ((1 << 64) - 1)
    high, low = value >> 62, value & ((1 << 62) - 1)
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | 2 << 62 | low)}>"


def page_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier[len("<urn:uuid:") : -1]).int
    value = (number >> 80) << 62 | number & ((1 << 62) - 1)
    if value >> 64:
        return None
    return value - (1 << 64) if value >> 63 else value


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", CAPTURED),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%!#$&'()*+,/:;=?@[]~ ").strip()))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return header.encode() + block + b"\r\n\r\n"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _as_spark_sees_it(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, unless it is on a local disk: without one it would be in the
    cluster's store to Spark and on a disk of their own to tasks."""
    path = qualified(spark, folder)
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive in order: header fields and block."""
    files, name = _file_system(path)
    with files.open_input_stream(name, compression=None) as source:
        first = source.read(8)
        trained = None
        if len(first) == 8 and struct.unpack("<I", first[:4])[0] == DICTIONARY_MAGIC:
            trained = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", first[4:])[0]))
            first = b""
        reader = io.BufferedReader(
            zstandard.ZstdDecompressor(dict_data=trained).stream_reader(
                _Joined(first, source), read_across_frames=True
            ),
            1 << 20,
        )
        while version := reader.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: not a WARC record: {version[:40]!r}")
            fields = {}
            while (line := reader.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().partition(":")
                fields[key] = value.strip()
            block = reader.read(int(fields["Content-Length"]))
            if len(block) != int(fields["Content-Length"]) or reader.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is cut off")
            yield fields, block


class _Joined(io.RawIOBase):
    """A stream with some bytes put back in front."""

    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.first:
            given, self.first = self.first, b""
            return given
        return self.rest.read(size)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to for the rows that become revisits, once each.

    Of rows whose payloads are equal and have `min_bytes` at least, the smallest page_id is
    the response. Only digests and ids are shuffled; counts combine on the map side. Both sides
    of the join are written tables, so that a digest with a large part of the pages is split.
    """
    keyed = pages.select("page_id", "digest", "payload_bytes").where(
        F.col("payload_bytes") >= min_bytes
    )
    rows = stage(keyed.groupBy("page_id", "digest").agg(F.count("*").alias("copies")), "digests")
    first = stage(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to")), "first-pages")
    return rows.join(first, "digest").where(
        F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    ).select("page_id", "digest", "refers_to")


def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """From a bounded sample, the first by a hash of the id; empty if there is too little."""
    short = pages.where(F.col("payload_bytes") <= SAMPLE_RECORD_BYTES)
    ids = [
        row[0]
        for row in short.where(F.col("page_id").isNotNull())
        .select("page_id", F.xxhash64("page_id").alias("h"))
        .orderBy("h", "page_id")
        .limit(SAMPLE_RECORDS)
        .collect()
    ]
    sample = short.where(F.col("page_id").isin(ids)).limit(2 * SAMPLE_RECORDS) if ids else short.limit(0)
    records = [
        record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], None, False)
        for r in sample.collect()
    ]
    try:
        return zstandard.train_dictionary(size, sorted(records)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the manifest: archive,
    records, bytes.

    Null html is an empty payload. Rows without page_id have records without a number; among
    equal payloads they revisit the smallest id. Rows that repeat the response's page_id and
    payload are responses too. Other columns are not read. Archives have names of their own
    attempt, and the manifest lists those of tasks that ended well, so a lost executor leaves
    no record twice or half.
    """
    folder = _as_spark_sees_it(pages.sparkSession, folder)
    payload = F.coalesce("html", F.lit(""))
    prepared = pages.select(
        "page_id", "url", payload.alias("payload"),
        F.octet_length(payload).alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    revisits = plan_records(prepared).select(
        F.col("page_id").alias("revisit_page"), F.col("digest").alias("revisit_digest"), "refers_to"
    )
    same = F.col("page_id").eqNullSafe(F.col("revisit_page")) & (
        F.col("digest") == F.col("revisit_digest")
    )
    rows = prepared.join(revisits, same, "left").select(
        "page_id", "url", "payload", "digest", "refers_to"
    )
    trained = prepared.sparkSession.sparkContext.broadcast(train_dictionary(prepared))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _file_system(folder)
        files.create_dir(place, recursive=True)
        dictionary = zstandard.ZstdCompressionDict(trained.value) if trained.value else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(trained.value)) + trained.value
        out, name, records, written = None, "", 0, 0

        def manifest() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"archive": [f"{folder}/{name}"], "records": [records], "bytes": [written]}
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))
            for page_id, url, payload, digest, refers_to in zip(*columns):
                if out is None:
                    name, records, written = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                    if dictionary is not None:
                        written += out.write(lead)
                frame = packer.compress(record(
                    page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(),
                    refers_to.as_py(), refers_to.is_valid,
                ))
                written += out.write(frame)
                records += 1
                if written >= archive_bytes:
                    out.close()
                    out = None
                    yield manifest()
        if out is not None:
            out.close()
            yield manifest()

    return stage(rows.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record,
    read from the archives of the manifest.

    A response's digest is taken of its payload and must be the recorded one; a revisit's
    digest and size are those of the response, from its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows = []
                for fields, block in read_archive(path):
                    rows.append(_read_record(path, fields, block))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string"
    )
    # One archive is one read, so each is a task's share of its own.
    spread = manifest.select("archive").repartition("archive")
    return spread.mapInArrow(read, schema)


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
])


def _read_record(path: str, fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (
        len(payload) != size or hashlib.sha256(payload).hexdigest() != digest
    ):
        raise ValueError(f"{path}: {fields['WARC-Record-ID']} differs from its digest")
    refers_to = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers_to is None else page_of(refers_to),
        "url": fields.get("WARC-Target-URI"),
    }


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_folder(spark, "warc")))
