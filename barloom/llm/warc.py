"""WARC archives: a record per page, written by Spark, and a reader that checks every record and goes on after damage."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_dealt, scratch_dir

ARCHIVE_BYTES = 32 << 20
"""Size at which an archive is closed."""
LEAST_BYTES = 100
"""Payloads of fewer bytes are stored again rather than revisited."""
BROADCAST_ROWS = 200_000
PIECE = 16 << 10
URN, NO_KEY = "urn:x-page:", "urn:x-page-null"
VERSION, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
MAX_HEADER = 1 << 20


class Damage(ValueError):
    """Why bytes are no valid record."""


def urn(key: str | None) -> str:
    return NO_KEY if key is None else URN + quote(key, safe="")


def key_of(record_id: str | None) -> str | None:
    name = (record_id or "").strip("<>")
    return unquote(name.removeprefix(URN)) if name.startswith(URN) else None


def member(data: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


EMPTY = member(b"", 6)


def record(kind: str, key: str | None, uri: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """The bytes of one record. A revisit has the HTTP header of its response, with the full length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn(key)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {''.join(quote(c) if c <= ' ' or c == chr(127) else c for c in uri)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{urn(first)}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_first(pages: DataFrame) -> DataFrame:
    """Adds __first to rows of (__key, __body, ...): the least key of the rows with this payload, if others have it too and it isn't small."""
    measured = pages.withColumns({"__body": F.coalesce("__body", F.lit(""))}).withColumns({"__digest": F.sha2(F.encode("__body", "UTF-8"), 256)})
    many = measured.where(F.octet_length("__body") >= LEAST_BYTES).groupBy("__digest").agg(F.count("*").alias("n"), F.min("__key").alias("__first")).where("n > 1").drop("n")
    many = cut(many)
    if many.count() <= BROADCAST_ROWS:
        return measured.join(F.broadcast(many), "__digest", "left")
    return join_dealt(measured, many, ["__digest"])


def write_archives(pages: DataFrame, path: str | None = None, *, key: str = "page_id", body: str = "html", uri: str = "url", level: int = 6, date: str | None = None) -> str:
    """Writes a record per row to archives of about ARCHIVE_BYTES below ``path`` (a new scratch folder if None) and returns it; a row's html isn't shuffled.

    The payload is ``body`` in UTF-8 (null: empty). Of rows with equal payloads of LEAST_BYTES or more, those of the least key are response, the others revisit
    it; all else is response. A null key comes last, and payloads that only rows without a key have are all response. Repeated rows get a record each,
    so rows of one key share a record id. Control characters and spaces of a uri are escaped; a null one has no header. An empty table gives no record.

    Each record is a gzip member of its own. Spark's text writer stores them, as it commits each task's files once: the bytes of an archive are its one line,
    and the line's end stands for its last byte. That byte is the highest of the last member's length and so zero, or an empty member follows.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark)
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_first(pages.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{body}`").alias("__body"), F.col(f"`{uri}`").cast("string").alias("__uri")))
    kind = F.when(F.col("__first").isNull() | F.col("__key").eqNullSafe(F.col("__first")), "response").otherwise("revisit")
    rows = rows.select(kind.alias("kind"), F.col("__key").cast("string").alias("key"), F.col("__uri").alias("uri"), F.col("__body").alias("body"), F.col("__digest").alias("digest"), F.col("__first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            archive = b"".join(held)
            archive = archive if archive.endswith(b"\0") else archive + EMPTY
            return pa.RecordBatch.from_pydict({"archive": pa.array([archive[:-1]], pa.binary())})

        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "key", "uri", "body", "digest", "first")]
            for i in range(batch.num_rows):
                what, own, where, text, digest, first = (c[i] for c in columns)
                held.append(member(record(what.as_py(), own.as_py(), where.as_py(), text.as_buffer().to_pybytes(), digest.as_py(), first.as_py(), stamp), level))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def unpacked(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that begins at ``at``, whose checksum and length are right, and its end."""
    squeezed, parts, end = zlib.decompressobj(31), [], at
    try:
        while not squeezed.eof:
            if end >= len(data):
                raise Damage("member is cut off")
            piece = data[end : end + PIECE]
            end += len(piece)
            parts.append(squeezed.decompress(piece))
    except zlib.error as e:
        raise Damage(f"member is damaged: {e}") from None
    return b"".join(parts), end - len(squeezed.unused_data)


def digest_fails(stated: str, data: bytes) -> bool:
    """Whether a stated digest of a known kind (hexadecimal or base 32) isn't that of the data."""
    kind, _, value = stated.partition(":")
    if kind.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return False
    made = hashlib.new(kind.lower(), data).digest()
    return value.lower() != made.hex() and value.upper().rstrip("=") != base64.b32encode(made).decode().rstrip("=")


def parsed(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """The record whose version line begins at ``at``, with all its checks, and its end."""
    head = bytes(data[at : at + 4096])
    if not head.startswith(VERSION):
        raise Damage("no version line")
    size = 4096
    while (stop := head.find(b"\r\n\r\n")) < 0:
        if size >= MAX_HEADER or at + size >= len(data):
            raise Damage("header has no end")
        size *= 8
        head = bytes(data[at : at + size])
    lines = head[:stop].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage("header line without a colon")
        last = name.strip().lower()
        fields[last] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no content length")
    begin = at + stop + 4
    end = begin + int(length)
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Damage("record doesn't end where its length says")
    block = bytes(data[begin:end])
    if digest_fails(fields.get("warc-block-digest", ""), block):
        raise Damage("block digest differs")
    kind = fields.get("warc-type", "").lower()
    http, payload = {}, block
    if fields.get("content-type", "").lower().startswith("application/http"):
        lines, _, payload = block.partition(b"\r\n\r\n")
        http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}
    stated = fields.get("warc-payload-digest", "")
    out = {"key": key_of(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": key_of(fields.get("warc-refers-to"))}
    if kind == "revisit":
        length = http.get("content-length", "")
        return out | {"payload": None, "payload_bytes": int(length) if length.isascii() and length.isdigit() else None, "payload_digest": stated.partition(":")[2].lower() or None}, end + 4
    if digest_fails(stated, payload):
        raise Damage("payload digest differs")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}, end + 4


def records(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(begin, end, record, None) of every valid record of an archive, and (begin, end, None, reason) of every gap, in order.

    A record stands alone or in a gzip member, which may hold several. Where a check fails, the archive is searched for the next place at which a member or a version
    line begins and that passes all checks; the bytes up to there are a gap. Members and gaps cover the archive without overlap, but for empty members. What a
    whole member holds besides records is a gap with the member's bounds. A record inside the payload of a damaged one is taken for a record.
    """
    view, at, end = memoryview(data), 0, len(data)
    ahead = {GZIP: -1, VERSION: -1}

    def taken(at: int) -> tuple[list[tuple[dict | None, str | None]], int]:
        if view[at : at + 3] == GZIP:
            content, stop = unpacked(view, at)
            if not content:
                return [], stop
            found = [(r, why) for _, _, r, why in records(content)] if content.startswith(VERSION) else [(None, "member without a record")]
            return found, stop
        found, stop = parsed(view, at)
        return [(found, None)], stop

    while at < end:
        try:
            found, stop = taken(at)
        except Damage as e:
            why, begin, found = str(e), at, []
            while at < end:
                for mark in ahead:  # found once, not again from each place
                    if ahead[mark] <= at:
                        place = data.find(mark, at + 1)
                        ahead[mark] = end if place < 0 else place
                at = min(ahead.values())
                if at == end:
                    break
                try:
                    found, stop = taken(at)
                except Damage:
                    continue
                if any(r for r, _ in found):
                    break
                found = []
            yield begin, at, None, why
            if at == end:
                return
        for one, why in found:
            yield at, stop, one, why
        at = stop


FIELDS = ("key", "record_type", "target_uri", "date", "payload", "payload_bytes", "payload_digest", "refers_to")


def read_archives(spark: SparkSession, path: str, *, payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives below ``path``, checked and salvaged as in ``records``; each archive is read whole by one task.

    Records: file, offset, n_bytes, key, record_type, target_uri, date, payload (only if asked for), payload_bytes, payload_digest, refers_to. A revisit's
    bytes and digest are those of the payload it refers to, as its headers state them; key and refers_to are null where a record's id isn't
    one of ``write_archives``. Gaps: file, offset, n_bytes, reason. Empty files and folders give no rows. Both come from one pass, whose rows are written
    to the shared checkpoint folder.
    """
    names = [f for f in FIELDS if payload or f != "payload"]
    types = {"payload": "binary", "payload_bytes": "bigint"}
    schema = "file string, offset bigint, n_bytes bigint, reason string, " + ", ".join(f"{n} {types.get(n, 'string')}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

        def out(rows: list) -> pa.RecordBatch:
            cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            cells += [pa.array([(r[4] or {}).get(n) for r in rows], kinds.get(n, pa.string())) for n in names]
            return pa.RecordBatch.from_arrays(cells, ["file", "offset", "n_bytes", "reason", *names])

        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column(0)[i].as_py(), [], 0
                for begin, end, one, why in records(batch.column(1)[i].as_buffer().to_pybytes()):
                    if one and not payload:
                        del one["payload"]
                    rows.append((file, begin, end - begin, why, one))
                    held += (one or {}).get("payload_bytes") or 0 if payload else 0
                    if len(rows) == 10_000 or held >= ARCHIVE_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    found = cut(files.mapInArrow(run, schema))
    gaps = found.where("reason IS NOT NULL").select("file", "offset", "n_bytes", "reason")
    return found.where("reason IS NULL").drop("reason"), gaps
