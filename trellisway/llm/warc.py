"""WARC archives: writing, and reading with segment reassembly.

Writing: each row is a record (version 1.1) with an HTTP response whose body is framed in
chunks. Blocks over `segment_bytes` are cut: the first part is segment 1, the others are
continuation records that name its id, the last one with the total length. Spark's text
writer puts the records out, so archives land on any file system that Spark writes to;
each record is a gzip member of its own, for readers that seek by record, and the writer's
line separator is the member of the end mark. Files hold at most `records_per_file` records
and have the names that Spark gives them.

Reading: files are read whole by Spark and parsed by their content lengths, record after
record. Parts of a segmented record are grouped by the origin's id, ordered by segment
number, checked (numbers without gaps, total length), joined, and the chunk framing is
decoded. Whole records send no payload through the shuffle.

Bounds: a file holds at most `records_per_file` * `segment_bytes` bytes of blocks, and one
record's payload is in one row, as on the way in. Files of others may be up to 2 GB, as
Spark reads each whole.

Defined results: a null payload is empty; null keys and urls have no header and read back
as null; control characters of urls are percent-encoded; repeated rows are records of
their own, and so are records without an id; a record with a missing part, a wrong total or a broken frame has a null payload
and `complete` false.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisway.llm.common import checkpointed, no_clash, shared_folder

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(part := body[at : at + size]), part) for at in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The body of chunked framing; null if the frame is broken or doesn't end."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(framed[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + END


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def records(key: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None, record_id: str, segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The record of one row, and its continuations, each without the end mark."""
    response = kind == "response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes) if response else b"\r\n")
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    many = len(parts) > 1
    for n, part in enumerate(parts, 1):
        first, last = n == 1, n == len(parts)
        own = record_id if first else f"<urn:uuid:{uuid.uuid4()}>"
        fields: list[tuple[str, object]] = [("WARC-Type", kind if first else "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
        if first:
            fields += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("X-Payload-Length", len(payload)), ("X-Record-Key", key), ("X-Refers-To-Key", refers_to), ("WARC-Profile", None if response else PROFILE), ("Content-Type", "application/http; msgtype=response")]
        if many:
            fields += [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", None if first else record_id), ("WARC-Segment-Total-Length", len(block) if last else None)]
        yield _header([*fields, ("Content-Length", len(part))]) + part


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal data are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(rows: DataFrame, path: str, segment_bytes: int = 1 << 18, chunk_bytes: int = 1 << 13, records_per_file: int = 2048, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes `rows` (key string, url string, payload binary, record_type string, refers_to string) to archives under `path`."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for key, url, payload, kind, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for record in records(key, url, payload or b"", kind, refers, f"<urn:uuid:{uuid.uuid4()}>", segment_bytes, chunk_bytes, date):
                    out.append(member(record))
                    size += len(out[-1])
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    built = rows.select("key", "url", F.col("payload").cast("binary").alias("payload"), "record_type", "refers_to").mapInArrow(build, "record binary")
    # the cast leaves the bytes as they are; the separator's are given as characters of one byte
    lines = built.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", member(END).decode("latin-1"))
    lines.option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


_PIECE = 1 << 14


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of gzip members that follow one another, or of a plain file, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        # a bounded piece at a time: what a member leaves of it is copied, and not all that follows in the file
        piece = data[at : at + _PIECE]
        at += len(piece)
        while piece:
            yield member.decompress(piece, 1 << 22)
            while not member.eof and member.unconsumed_tail:
                yield member.decompress(member.unconsumed_tail, 1 << 22)
            piece = b""
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of a file; a cut-off last record ends it."""
    source, held = _inflated(data), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end = held.find(END)
        while end < 0:
            if not fill(len(held) + 1):
                return
            end = held.find(END)
        fields = {}
        for line in bytes(held[:end]).strip(b"\r\n").split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        n = int(fields.get("content-length", 0))
        if not fill(end + 4 + n):
            return
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]
        fill(4)
        while held[:2] == b"\r\n":
            del held[:2]


def http_body(block: bytes) -> bytes | None:
    head, mark, body = block.partition(END)
    if not mark:
        return None
    framed = any(line.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return dechunked(body) if framed else body


_PARSED = "origin string, number int, total long, record_type string, key string, url string, refers_to string, stated_digest string, stated_bytes long, payload_bytes long, payload_digest string, complete boolean, block binary"


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record that is no continuation: key, url, record_type, refers_to, stated_digest, stated_bytes,
    payload_bytes and payload_digest of the decoded payload (null for revisits), complete[, payload]."""

    def decoded(kind: str | None, block: bytes | None) -> tuple:
        body = http_body(block) if block is not None and kind == "response" else None
        return len(body) if body is not None else None, hashlib.sha256(body).hexdigest() if body is not None else None, body is not None or (block is not None and kind != "response"), body

    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), *[(n, pa.string()) for n in ("record_type", "key", "url", "refers_to", "stated_digest")], ("stated_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("block", pa.binary())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                out, size = [], 0
                for place, (fields, block) in enumerate(parse(batch.column(1)[k].as_py())):
                    kind, number = fields.get("warc-type"), _number(fields, "warc-segment-number")
                    n, digest, whole, body = decoded(kind, block) if number is None else (None, None, None, None)
                    kept = block if number is not None else body if with_payload else None
                    first = kind != "continuation"
                    origin = fields.get("warc-record-id" if first else "warc-segment-origin-id") or f"{batch.column(0)[k].as_py()}#{place}"
                    out.append((origin, number, _number(fields, "warc-segment-total-length"), kind if first else None, fields.get("x-record-key"), fields.get("warc-target-uri"), fields.get("x-refers-to-key"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, _number(fields, "x-payload-length"), n, digest, whole, kept))
                    size += len(kept or b"") + 500
                    if size > 1 << 22:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    parsed = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows_of, _PARSED)
    names = ["record_type", "key", "url", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest", "complete"]
    # a whole record is a group of its own; its row is narrow unless payloads are asked for
    grouped = parsed.groupBy("origin").agg(
        *[F.max(F.when(F.coalesce(F.col("number"), F.lit(1)) == 1, F.col(n))).alias(n) for n in names],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    out_schema = pa.schema([*[(n, schema.field(n).type) for n in names], *[("payload", pa.binary())] * with_payload])

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = r.pop("parts")
                payload = parts[0]["block"]
                if parts[0]["number"] is not None or len(parts) > 1:
                    whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and r["total"] == sum(len(p["block"]) for p in parts) and r["record_type"] is not None
                    r["payload_bytes"], r["payload_digest"], r["complete"], payload = decoded(r["record_type"], b"".join(p["block"] for p in parts) if whole else None)
                rows.append((*(r[n] for n in names), *[payload] * with_payload))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    kinds = ", ".join(f"{n} {dict(parsed.dtypes)[n]}" for n in names)
    return grouped.mapInArrow(join_parts, kinds + ", payload binary" * with_payload)


def revisit_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 100, salts: int = 16, prefix: str = "") -> DataFrame:
    """Columns of `pages` with {prefix}digest, {prefix}record_type and {prefix}refers_to: of equal payloads of at least
    `least_bytes`, the one with the smallest id is the response, others revisit it. Rows with a null id are responses. A
    payload may be on a large part of all rows, so the firsts are copied to `salts` and rows are dealt over them. A column
    of an added name raises."""
    digest, kind, refers = (f"{prefix}{c}" for c in ("digest", "record_type", "refers_to"))
    no_clash(pages, [digest, kind, refers, "_long", "_of", "_first", "_copy", "_salt"])
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.withColumn(digest, F.sha2(body, 256)).withColumn("_long", F.length(body) >= least_bytes)
    firsts = rows.where("_long").groupBy(F.col(digest).alias("_of")).agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = checkpointed(firsts).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col, digest), F.lit(salts)).cast("int"))
    met = salted.join(copies, (F.col(digest) == F.col("_of")) & (F.col("_salt") == F.col("_copy")) & F.col("_long"), "left")
    again = F.col("_first").isNotNull() & (F.col(id_col) > F.col("_first"))
    return met.withColumns({kind: F.when(again, F.lit("revisit")).otherwise(F.lit("response")), refers: F.when(again, F.col("_first"))}).drop("_long", "_of", "_first", "_copy", "_salt")


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
