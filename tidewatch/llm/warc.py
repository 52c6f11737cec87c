"""WARC archives: a writer in DataFrame functions, and a reader that salvages damaged files.

The writer emits WARC/1.1 through Spark's text sink, whose line separator is the last byte of a member, so it reaches any
store that Spark does; every record is a gzip member of its own, so damage costs the records that it hits.  The reader takes plain records and
gzip members of one or more records.  A record whose header, length, end or block digest fails its check is quarantined:
the reader looks for the next version line or member that passes, logs the byte gap before it, and goes on.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch, small_batches, written

END = "\r\n\r\n"
#: Payloads shorter than this are never stored by reference.
LEAST = 100
#: Bytes of members that go to the sink at once, and how often for one file: a file has at most their product, or one record.
CHUNK = 4 << 20
CHUNKS = 4
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ID = "urn:tidewatch:page:"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = LEAST) -> DataFrame:
    """(id, url, html, digest, refers_to): of equal payloads of at least ``least`` bytes all but the smallest id's refer to it.

    Null payloads are empty.  Null ids are never referred to and never refer; rows with the smallest id's own id are kept whole.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "digest", "left").select("id", "url", "html", "digest", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def records(planned: DataFrame) -> DataFrame:
    """One string for each row of :func:`plan`: a whole record without its terminator."""
    size = F.octet_length("html")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.concat(F.lit(_ID), F.coalesce(F.col("id").cast("string"), F.lit("none"))))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2("block", 256)),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return planned.withColumn("block", block).select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.col("block")).alias("record"))


#: An empty member: it follows one whose last byte is not zero, as of records from 16 MB.
_EMPTY = gzip.compress(b"", mtime=0)


def _members(chunk: int):
    """Runs of about ``chunk`` bytes of members, one for each record, without their last byte, which is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                member = gzip.compress(record.as_py() + END.encode(), 6, mtime=0)
                held.append(member if member[-1] == 0 else member + _EMPTY)
                size += len(held[-1])
                if size >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["member"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["member"])

    return run


def write(pages: DataFrame, path: str, *, chunk: int = CHUNK, chunks: int = CHUNKS, **columns: str) -> None:
    """Writes the archives of ``pages`` into the folder ``path``; a file has at most ``chunk * chunks`` bytes, or one record."""
    small_batches(pages.sparkSession)
    members = records(plan(pages, **columns)).select(F.col("record").cast("binary")).mapInArrow(_members(chunk), "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", chunks).option("compression", "none").text(path)


def _parsed(data: bytes, at: int) -> tuple[dict, int] | None:
    """The plain record at ``at`` and the place after it, if all its checks hold."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        return None
    fields, at = {}, at + 10
    while (line_end := data.find(b"\r\n", at)) > at:
        key, colon, value = data[at:line_end].partition(b":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
        at = line_end + 2
    if line_end < 0:
        return None
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return None
    start, end = line_end + 2, line_end + 2 + length
    if length < 0 or end > len(data) or data[end : end + 4] not in (b"\r\n\r\n", b""):
        return None
    block = data[start:end]
    declared = fields.get(b"warc-block-digest", b"").split(b":")
    if len(declared) == 2 and declared[0] in (b"sha256", b"sha1", b"md5") and len(declared[1]) == hashlib.new(declared[0].decode()).digest_size * 2:
        if hashlib.new(declared[0].decode(), block).hexdigest().encode() != declared[1].lower():
            return None
    if data[end : end + 4] != b"\r\n\r\n" and end != len(data):
        return None
    return {"fields": fields, "block": block}, end + 4 if end < len(data) else end


def _until(member, data: bytes) -> tuple[bytes, int]:
    """All that a decompressor makes of ``data`` before it fails, and the place of the byte that it fails at."""
    plain, step, size = [], 1 << 16, len(data)
    while step:
        trial = member.copy()
        try:
            piece = trial.decompress(data, step)
        except zlib.error:
            step >>= 1
            continue
        if not piece:
            break
        plain.append(piece)
        member, data = trial, trial.unconsumed_tail
    for i in range(len(data)):  # a call that ends the data fails with its last byte
        try:
            plain.append(member.decompress(data[i : i + 1]))
        except zlib.error:
            return b"".join(plain), size - len(data) + i
    return b"".join(plain), size


def _member(data: bytes, at: int) -> tuple[bytes, int | None, bool]:
    """What a gzip member holds, as far as it can be read, the place after it (None if it is damaged), and whether what was read may be wrong."""
    member, plain = zlib.decompressobj(31), []
    for a in range(at, len(data), 1 << 16):
        part, before = data[a : a + (1 << 16)], member.copy()
        try:
            plain.append(member.decompress(part))
        except zlib.error:
            rest, failed = _until(before, part)
            inside = b"".join((*plain, rest))
            own, last = zlib.crc32(inside).to_bytes(4, "little"), a + failed + 1
            # the checksum holds and the size does not, or one byte of the checksum alone differs
            trailer = data[last - 8 : last - 4] == own or sum(x != y for x, y in zip(data[last - 4 : last], own, strict=False)) == 1
            return inside, None, not trailer
        if member.eof:
            return b"".join(plain), min(a + (1 << 16), len(data)) - len(member.unused_data), False
    return b"".join(plain), None, False


def _plain(data: bytes, at: int = 0) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) of plain records from ``at`` to the first byte that is no part of one, or of a gap."""
    bad = None
    while at < len(data):
        got = _parsed(data, at)
        if got is not None:
            if bad is not None:
                yield bad, at, None
                bad = None
            yield at, got[1], got[0]
            at = got[1]
            if data[at : at + 3] == _MAGIC:
                return
            continue
        bad = at if bad is None else bad
        later = _START.search(data, at + 1)
        at = later.start() if later else len(data)
        if data[at : at + 3] == _MAGIC and _member(data, at)[1] is not None:
            yield bad, at, None
            return
    if bad is not None:
        yield bad, len(data), None


def salvage(data: bytes) -> Iterator[tuple[int, int, int | None, dict | None]]:
    """(start, end, inner, record) in order of an archive of plain records and of gzip members of one or more records.

    The record is None for a quarantined gap.  Places are bytes of the file; a record in a member has the member's place
    and its own place inside, ``inner``.  Of a damaged member the sound records before the first that fails count (all, where only its
    checksum or end is hurt), and the member's
    bytes up to the next record or member are a gap.
    """
    at = 0
    while at < len(data):
        if data[at : at + 3] != _MAGIC:
            for start, end, got in _plain(data, at):
                yield start, end, None, got
                at = end
            continue
        inside, end, wrong = _member(data, at)
        sound = end is not None
        if not sound:
            later = at + 1
            while (found := _START.search(data, later)) and not (_parsed(data, found.start()) or data[found.start() : found.start() + 3] == _MAGIC and _member(data, found.start())[1] is not None):
                later = found.start() + 1
            end = found.start() if found else len(data)
        found = list(_plain(inside))
        if wrong:
            # digests do not cover headers: where no record fails, any header may be the damaged place
            found = found[: next((i for i, (_, _, got) in enumerate(found) if got is None), 0)]
        for start, _, got in found:
            if got or sound:
                yield at, end, start, got
        if not sound:
            yield at, end, None, None
        at = end


_SCHEMA = "file string, start long, end long, inner long, ok boolean, type string, id string, refers_to string, uri string, declared_digest string, http_length long, payload binary"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner", pa.int64()), ("ok", pa.bool_()), ("type", pa.string()), ("id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"], strict=True):
            name, rows, size = file.as_py(), [], 0
            for start, end, inner, got in salvage(content.as_py()):
                row = {"file": name, "start": start, "end": end, "inner": inner, "ok": got is not None}
                if got:
                    field = lambda k, f=got["fields"]: f[k].decode(errors="replace") if k in f else None
                    head, cut, body = got["block"].partition(b"\r\n\r\n")
                    http = bool(cut) and head.startswith(b"HTTP/")
                    length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})", head) if http else None
                    row |= {"type": field(b"warc-type"), "id": field(b"warc-record-id"), "refers_to": field(b"warc-refers-to"), "uri": field(b"warc-target-uri"), "declared_digest": field(b"warc-payload-digest"), "http_length": int(length[1]) if length else None, "payload": body if http else got["block"]}
                rows.append(row)
                size += len(got["block"]) if got else 0
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path`` (ok), and every quarantined gap (not ok: file, start and end alone)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read_task, _SCHEMA)


def page_id(name: str) -> F.Column:
    """The page's id in a record's name; null where there is none."""
    return F.regexp_extract(F.col(name), rf"^<{_ID}(-?[0-9]+)>$", 1).try_cast("long")


def salvaged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, log) of what :func:`read` found.

    ``pages`` are (page_id, payload_bytes, payload_digest, record_type, refers_to) of sound records.  A revisit has the size
    and digest of the response that it refers to by id and by declared digest; where that was lost, those that it declares.
    ``log`` has the quarantined gaps (file, start, end).
    """
    kinds = [page_id("id").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.col("type").alias("record_type"), page_id("refers_to").alias("refers_to"), F.regexp_replace("declared_digest", "^sha256:", "").alias("declared"), "http_length"]
    rows = written(found.select("ok", "file", "start", "end", *kinds), "records")
    responses, again = (rows.where(F.col("ok") & (F.col("record_type") == kind)) for kind in ("response", "revisit"))
    whole = responses.where("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared"), F.col("bytes").alias("whole")).distinct()
    pages = again.join(whole, ["refers_to", "declared"], "left").select("page_id", F.coalesce("whole", "http_length").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    pages = pages.unionByName(responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")))
    return pages, rows.where(~F.col("ok")).select("file", "start", "end")


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, **columns)
    return salvaged(read(pages.sparkSession, path))[0]
