"""WARC archives with an index first: byte offset, length, URL and digest per record, then coalesced range reads.

Writing: equal payloads are found by a combinable maximum of page_id per digest. Each task streams its pages into archives of
gzip members, one per record, in the shared folder, and emits the index row of every record. The index is a table that
Spark commits, so it only names archives of tasks that succeeded; a repeated task writes a file of its own.

Reading: the selected index rows are sorted by archive and offset, neighbours whose gap is small are joined into one byte
range of about READ bytes, and each range is one read in a task.

Defined cases: null html is an empty payload. A null url has no target header. All rows that hold the largest page_id of a
payload are responses (repeated rows alike); where all ids are null, all are responses. Null ids among others revisit.
Control characters of a url are percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.staging import Scratch

ROLL = 256 << 20  # bytes after which a task begins another archive
READ, GAP = 4 << 20, 64 << 10
#: Bytes of archive that a task reads back.
TASK = 128 << 20
LEVEL = 3

_INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    is_response = fields["WARC-Type"] == "response"
    if is_response and (len(payload) != full or digest(payload) != known):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": full, "payload_digest": known, "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To"), "payload": payload.decode() if is_response else None}


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, at, archive = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if sink is None or at >= ROLL:
                        if sink is not None:
                            sink.close()
                        archive = f"pages-{uuid.uuid4().hex}.warc.gz"
                        sink, at = store.open_output_stream(f"{root}/{archive}", compression=None), 0
                    payload = (html or "").encode()
                    member = _gzip(record(page_id, url, payload, refers_to, date))
                    sink.write(member)
                    rows.append((page_id, url, archive, at, len(member), digest(payload), "response" if refers_to is None else "revisit"))
                    at += len(member)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type"])
        finally:
            if sink is not None:
                sink.close()

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write `pages` (page_id, url, html) as archives below the scratch folder; returns the index. Of equal payloads of at
    least `least` bytes only that of the largest page_id is stored."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("same", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    sized = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least).select("page_id", "same")
    winners = sized.groupBy("same").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1 AND winner IS NOT NULL")
    revisits = sized.join(winners, "same").where("page_id IS NULL OR page_id <> winner").select(F.col("page_id").alias("r_id"), F.col("same").alias("r_same"), F.col("winner").alias("refers_to")).distinct()
    rows = pages.join(revisits, pages.page_id.eqNullSafe(revisits.r_id) & (pages.same == revisits.r_same), "left").select("page_id", "url", "html", "refers_to")
    return scratch.keep(rows.mapInArrow(_write(scratch.path("archives"), date), _INDEX), "index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _RECORD.split(", ")]
        for batch in batches:
            for span in batch.to_pylist():
                with store.open_input_file(f"{root}/{span['archive']}") as source:
                    data = source.read_at(span["high"] - span["low"], span["low"])
                found = []
                for r in span["records"]:
                    start = r["offset"] - span["low"]
                    found.append(parse(zlib.decompress(data[start : start + r["length"]], 31)))
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names=names)

    return run


def read_ranges(selected: DataFrame) -> DataFrame:
    """(archive, low, high, records): byte ranges that cover the selected index rows."""
    near = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    before = F.lag(end).over(near)
    new = before.isNull() | (F.col("offset") - before > GAP) | (F.floor(F.col("offset") / READ) != F.floor(F.lag("offset").over(near) / READ))
    spans = selected.select("archive", "offset", "length").distinct().withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(near))
    return spans.groupBy("archive", "span").agg(F.min("offset").alias("low"), F.max(end).alias("high"), F.collect_list(F.struct("offset", "length")).alias("records")).drop("span")


def read_archives(selected: DataFrame, scratch: Scratch) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, for
    responses, the payload. Ranges are dealt by the bytes of archive behind them, not by the few bytes that name them."""
    spark = selected.sparkSession
    size = selected.agg(F.sum("length")).first()[0] or 0
    spans = read_ranges(selected).repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK)), "archive", "low")
    return spans.mapInArrow(_read(scratch.path("archives")), _RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back from the archives."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = write_archives(pages, scratch)
    return read_archives(index, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
