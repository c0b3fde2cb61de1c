"""WARC (9): archives written through Spark's commit protocol and read back in byte ranges.

Writing: one gzip member per record. Rows are written with the text sink, whose line separator is
NUL: a member's last byte is the top byte of its length, NUL for members under 16 MiB, and is left
to the sink; after a larger member an empty one (whose last byte is NUL) is added. The files are
plain concatenated members, byte for byte.

Reading: files are cut into byte ranges; each task scans its ranges for the gzip magic, accepts a
candidate only if it inflates to a WARC header, and owns the records whose member starts inside
its range, reading past the end to finish the last one. Neither a file nor a range is held whole.
(A payload that is itself an uncompressible archive could show members of its own to a scan that
starts inside it; pages of text cannot.)

Defined results: a null payload counts as empty; equal payloads of at least ``MIN_REVISIT`` bytes
become revisits of the one with the smallest id (rows that repeat that id are responses too); a
null id counts as larger than any, is read back as null, and alone among its equals is a response; an id of
any text, the empty one too, is percent-encoded in its record and read back as it was;
control characters in a URL are percent-encoded, a null URL is left out; extra columns are ignored;
no pages, no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.llm.common import written
from txgraph.session import scratch_path

MIN_REVISIT = 100
RANGE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 5
_READ = 256 << 10
_MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_NO_ID = "urn:no-page"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def _member(record: bytes, level: int = LEVEL) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _urn(page_id: str | None) -> str:
    return _NO_ID if page_id is None else _ID + quote(page_id, safe="")


def _page_id(urn: str | None) -> str | None:
    """The id of a record of ours; other archives' record ids as they stand."""
    if urn is None:
        return None
    urn = urn.removeprefix("<").removesuffix(">")
    return None if urn == _NO_ID else unquote(urn.removeprefix(_ID)) if urn.startswith(_ID) else urn


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = "".join(quote(c) if ord(c) < 0x21 or ord(c) == 0x7F else c for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _rows_to_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        ids, urls, payloads, digests, refers = (batch.column(k) for k in range(5))
        for i in range(batch.num_rows):
            payload = payloads[i].as_buffer()
            member = _member(record_bytes(ids[i].as_py(), urls[i].as_py(), payload.to_pybytes(), digests[i].as_py(), refers[i].as_py()))
            if member[-1]:
                member += _member(b"")
            out.append(member[:-1])
            size += len(member)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Write the pages as gzipped WARC files under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = (src.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
            .where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    # written first, so that the join with the wide rows is planned from its known size
    rows = src.join(written(same, "warc-equal"), "digest", "left")
    refers = F.when(F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first_id"))), F.col("first_id").cast("string"))
    members = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_rows_to_members, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _open(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if not rest:
        return fs.LocalFileSystem().open_input_file(uri)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, path = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)
    return system.open_input_file(path)


class _Window:
    """Forward reads of a file with a small buffer."""

    def __init__(self, f):
        self.f, self.size, self.at, self.buf = f, f.size(), 0, b""

    def get(self, offset: int, n: int = _READ) -> bytes:
        """Up to n bytes from an offset (fewer only at the file's end)."""
        if not self.at <= offset or offset + n > self.at + len(self.buf):
            self.at, self.buf = offset, self.f.read_at(max(0, min(max(4 * _READ, n), self.size - offset)), offset)
        return self.buf[offset - self.at : offset - self.at + n]


def _inflate(w: _Window, offset: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at an offset, or None if it is not a sound member that
    is empty or holds a WARC record."""
    d, out, at, seen = zlib.decompressobj(31), [], offset, b""
    try:
        while not d.eof:
            chunk = w.get(at, 32 << 10)
            if not chunk:
                return None
            out.append(d.decompress(chunk))
            at += len(chunk)
            if len(seen) < 5:
                seen += out[-1][:8]
                if not b"WARC/".startswith(seen[:5]):
                    return None
    except zlib.error:
        return None
    return b"".join(out), at - len(d.unused_data)


def range_records(f, begin: int, end: int) -> Iterator[bytes]:
    """The records whose gzip member starts in [begin, end)."""
    w, at = _Window(f), begin
    end = min(end, w.size)
    while at < end:
        got = None
        if w.get(at, len(_MAGIC)) == _MAGIC:
            got = _inflate(w, at)
        if got is None:  # not at a member: scan for the next candidate
            chunk = w.get(at + 1, min(_READ, end - at - 1) + len(_MAGIC) - 1)
            found = chunk.find(_MAGIC)
            at = at + 1 + found if found >= 0 else at + 1 + max(len(chunk) - len(_MAGIC) + 1, 1)
            continue
        if got[0]:
            yield got[0]
        at = got[1]


def parse_record(raw: bytes) -> dict:
    """Headers, and size, digest and body of the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        http_fields = dict(x.lower().partition(": ")[::2] for x in http.decode("latin-1").split("\r\n")[1:])
        size, digest = int(http_fields["content-length"]), fields["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {"record_id": _page_id(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": _page_id(fields.get("warc-refers-to")),
            "payload_bytes": size, "payload_digest": digest, "payload": payload}


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("begin"))
    n = max(1, ranges.count())
    schema = RECORD_SCHEMA + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if " long" in x else pa.binary() if " binary" in x else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[dict] = []
                size = 0
                with _open(uri) as f:
                    for raw in range_records(f, begin, begin + range_bytes):
                        rows.append(parse_record(raw))
                        if not with_payload:
                            rows[-1]["payload"] = b""
                        size += len(rows[-1]["payload"])
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    return ranges.repartition(n).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id") -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, id_col)
    kind = pages.schema[id_col].dataType
    return read_warc(spark, path).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
