"""WARC archives, each record a Zstandard frame of its own, compressed with a dictionary built from the archive's records.

The dictionary is trained on the first records of an archive and stands, compressed itself, in a leading skippable frame. Of records with equal
payloads of at least ``least`` bytes the one of smallest id is written as response, the others as revisits that refer to it.
Archives are closed at ``archive_bytes`` of records, so neither writer nor reader holds more than one archive's dictionary
sample. A task writes under a name of its own and renames the archive when it is whole; only archives named in the list that
successful tasks return are read, so lost or repeated tasks leave no trace in the result.

Defined cases: a null payload is empty; a null or unprintable URL is written as a URN or percent-encoded; rows that repeat the
smallest id of a payload are all responses; a null id comes after all others, and if all ids of a payload are null all are
responses; an empty table gives no archives. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, small_batches

SKIPPABLE = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """The record of one row: id, row, url, payload, digest, refers_to, revisit."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(PLACE, str(page))}>"
    payload, revisit = row["payload"] or b"", row["revisit"]
    url = quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~") if row["url"] else f"urn:page:{row['id']}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", name(f"{row['id']}/{row['row']}" if revisit else row["id"])), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Payload-Length", str(len(payload)))]
    if row["id"] is not None:
        headers.append(("X-Page-Id", str(row["id"])))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"])), ("X-Refers-To-Page-Id", str(row["refers_to"]))]
    return _record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records; too few of them serve as they are."""
    size = sum(map(len, samples))
    try:
        if len(samples) < 16 or size < 16 << 10:
            raise ValueError
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 20), samples, k=256, d=8)
    except (ValueError, zstandard.ZstdError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: records wait until the dictionary can be built from them."""

    def __init__(self, folder: str, date: str):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.root, self.waiting, self.size, self.n, self.out = f"{root}/.{self.name}", root, [], 0, 0, None
        self.add(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.n += 1
        if self.out is None:
            self.waiting.append(record)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.compressor.compress(record))

    def _open(self) -> None:
        built = dictionary(self.waiting)
        raw = zstandard.compress(built.as_bytes(), 6)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=built)
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        self.out.close()
        self.files.move(self.path, f"{self.root}/{self.name}")
        return self.name, self.n - 1, self.size


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches):
        open_, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                open_ = open_ or Archive(folder, date)
                open_.add(page_record(row, date))
                if open_.size >= archive_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_:
            done.append(open_.close())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return run


def _classified(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, row, url, payload, digest, refers_to and revisit of each row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= least
    first = rows.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & long & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first.hint("merge"), "digest", "left").select("id", "row", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archive_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages' records under ``folder``, a URI that all executors reach; the list of archives: archive, n_records, n_bytes."""
    small_batches(pages.sparkSession)
    rows = _classified(pages, id_col, url_col, payload_col, least)
    return materialise(rows.mapInArrow(_write(folder, date, archive_bytes), "archive string, n_records long, n_bytes long"), "warc-list")


def records(stream):
    """(type, headers in lower case, block) of each record of an archive, read as a stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    known = zstandard.ZstdCompressionDict(zstandard.decompress(stream.read(size)))
    with zstandard.ZstdDecompressor(dict_data=known).stream_reader(stream, read_across_frames=True) as plain:
        text = io.BufferedReader(plain, 1 << 20)
        while line := text.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("a record does not begin with its version")
            headers = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().partition(":")
                headers[key.strip().lower()] = value.strip()
            block = text.read(int(headers["content-length"]))
            if len(block) != int(headers["content-length"]) or text.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield headers["warc-type"], headers, block


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, listed: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page record (with ``payloads`` also url and the response's payload); payloads are checked against their digests."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["url", "payload"] * payloads

    def rows(name):
        files, root = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for kind, h, block in records(stream):
                if kind == "warcinfo":
                    continue
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload and digest of {h['warc-record-id']} differ")
                number = lambda key: int(h[key]) if key in h else None
                yield number("x-page-id"), number("x-payload-length"), digest, kind, number("x-refers-to-page-id"), *([h["warc-target-uri"], payload if kind == "response" else None] if payloads else [])

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                kept, size = [], 0
                for row in rows(name):
                    kept.append(row)
                    size += 200 + (len(row[-1] or b"") if payloads else 0)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names=names)
                        kept, size = [], 0
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names=names)

    return listed.select("archive").repartition(max(1, listed.count())).mapInArrow(run, FIELDS + ", url string, payload binary" * payloads)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """The pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, **how), folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
