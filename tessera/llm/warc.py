"""WARC archives written and read through Spark, with segmented records and chunked transfer framing.

Writing: a response record holds an HTTP message whose body is the payload in chunked framing; records longer than a
segment are split into a first record and continuation records that name its id and their segment number.  Of equal
payloads the one with the smallest page id is the response; the others are revisit records that refer to it.  Every
record, its closing CRLF CRLF included, is a gzip member of its own.  The text writer puts members into files - its line
separator is a member of no bytes, which readers of gzip skip - so archives land in any store that Spark can write, in
files of a bounded number of bounded records.

Reading: files are inflated and parsed member by member, record by record, by content length.  Whole records are decoded
where they are met; segments are dealt by their origin's id, sorted by segment number, and decoded one origin at a time:
checked for gaps and against the total length, their chunked framing undone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import release
from tessera.llm.workspace import Workspace, few, lookup, table

SEGMENT, CHUNK, PER_FILE = 16384, 4096, 4000
#: bytes inflated at a time, and bytes of rows of an Arrow batch
PART, BATCH = 1 << 18, 1 << 21
#: a gzip member of no bytes
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
FILES = "*.{warc,warc.gz,txt,txt.gz}"
_DATE = "2024-01-01T00:00:00Z"
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are skipped, a cut frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut")
        at = end + 4 + size


def _uri(page_id: int | None, url: str | None) -> bytes:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}").encode()


def _record(kind: bytes, name: str, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", f"<urn:page:{name}>".encode()), (b"WARC-Date", _DATE.encode()), *fields, (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, row: int, first: int | None) -> Iterator[bytes]:
    """The records of one page; ``first`` is the row that a revisit refers to."""
    fields = [(b"WARC-Target-URI", _uri(page_id, url)), (b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode())]
    if page_id is not None:
        fields.append((b"X-Page-ID", b"%d" % page_id))
    if first is not None:
        yield _record(b"revisit", str(row), [*fields, (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", f"<urn:page:{first}>".encode()), (b"Content-Type", b"application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
    fields.append((b"Content-Type", b"application/http;msgtype=response"))
    cuts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield _record(b"response", str(row), fields + [(b"WARC-Segment-Number", b"1")] * (len(cuts) > 1), cuts[0])
    for n, cut in enumerate(cuts[1:], 2):
        more = [(b"WARC-Segment-Origin-ID", f"<urn:page:{row}>".encode()), (b"WARC-Segment-Number", b"%d" % n), (b"WARC-Target-URI", _uri(page_id, url))]
        if n == len(cuts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(b"continuation", f"{row}:{n}", more, cut)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Rows:
    """Rows gathered into Arrow batches of about ``BATCH`` bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows(pa.schema([("record", pa.binary())]))
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            for record in records(*(c[i].as_py() for c in columns)):
                member = _member(record)
                yield from out.add((member,), len(member))
    yield from out.flush()
    release()


def write(pages: DataFrame, ws: Workspace, name: str) -> str:
    """Archive ``pages`` (page_id, url, html), a record per row, as the workspace's ``name``; returns the path.

    Null html is an empty payload.  Of rows with equal payloads that with the smallest page_id is the response, of equal
    ids the first row; rows without an id come last and have no X-Page-ID header.  Rows are named by their place in
    the table, which has to be read alike each time, as files are.  An empty table is an archive without records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    keys = ws.save(rows.select("row", "page_id", F.sha1("payload").alias("key")), f"{name}_keys")
    first = keys.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")).alias("low"), F.count("*").alias("times"))
    first = ws.save(first.where("times > 1").select("key", F.col("low.row").alias("first")), f"{name}_first")
    again = ws.save(lookup(keys, first, "key").where("first is not null and first <> row").select("row", "first"), f"{name}_again")
    members = rows.join(few(again), "row", "left").select("page_id", "url", "payload", "row", "first").mapInArrow(_written, "record binary")
    out = members.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", PER_FILE)
    out.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(ws.path(name))
    ws.drop(f"{name}_keys", f"{name}_first", f"{name}_again")
    return ws.path(name)


def inflated(data) -> Iterator[bytes]:
    """The bytes of a file in parts, gzip members undone one after the other."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + PART]) for i in range(0, len(data), PART))
        return
    at, member, begun = 0, zlib.decompressobj(31), False
    while at < len(data):
        given = bytes(data[at : at + PART])
        at += len(given)
        while given:
            out, begun = member.decompress(given, PART), not member.eof
            if out:
                yield out
            if member.eof:
                given, member, begun = member.unused_data, zlib.decompressobj(31), False
            else:
                given = member.unconsumed_tail
    if begun:
        raise ValueError("a gzip member is cut")


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one archive; no more than a record and a part is held."""
    parts, held, at, over = inflated(data), bytearray(), 0, False

    def need(n: int) -> bool:
        nonlocal held, at, over
        while len(held) - at < n and not over:
            if at:
                del held[:at]
                at = 0
            part = next(parts, None)
            over = part is None
            held += part or b""
        return len(held) - at >= n

    while need(1):
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not need(len(held) - at + 1):
                raise ValueError("a record's header is cut")
        if not held.startswith(b"WARC/1.", at):
            raise ValueError("no record where one should begin")
        heads = {m[1].decode().lower(): m[2].decode() for m in _HEADER.finditer(held, held.index(b"\r\n", at) + 2, end)}
        at, size = end + 4, int(heads["content-length"])
        if not need(size):
            raise ValueError("a record is cut")
        yield heads, bytes(held[at : at + size])
        if not need(size + 4):
            raise ValueError("a record's end is cut")
        at += size + 4


_SEGMENTED = "type string, name string, page_id long, digest string, refers_to string, payload_bytes long, payload binary, origin string, segment int, total long, block binary"
_READ = "page_id long, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", head) else body


def _checked(block: bytes, stated: str | None) -> bytes:
    payload = payload_of(block)
    if stated is not None and digest(payload) != stated:
        raise ValueError("a payload doesn't match its digest")
    return payload


def _parsed(with_payload: bool):
    """Whole records decoded, segments as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_schema(_SEGMENTED))
        for batch in batches:
            for content in batch.column(0):
                for h, block in parse(content.as_buffer()):
                    kind, name, stated = h["warc-type"], h["warc-record-id"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    page, total = (int(h[x]) if x in h else None for x in ("x-page-id", "warc-segment-total-length"))
                    row = (kind, name, page, stated, h.get("warc-refers-to"))
                    if segment := int(h.get("warc-segment-number", 0)):
                        yield from out.add((*row, None, None, h.get("warc-segment-origin-id", name), segment, total, block), len(block))
                    elif kind == "revisit":
                        yield from out.add((*row, None, None, None, 0, None, None), 0)
                    elif kind == "response":
                        payload = _checked(block, stated)
                        yield from out.add((*row, len(payload), payload if with_payload else None, None, 0, None, None), len(payload) * with_payload)
        yield from out.flush()
        release()

    return run


def _joined(with_payload: bool):
    """Segments sorted by origin and number, one origin at a time."""

    def whole(origin: str, parts: list[tuple]) -> tuple:
        block = b"".join(p[-1] for p in parts)
        if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != len(block):
            raise ValueError(f"segments are missing of {origin}")
        kind, page, stated, refers = parts[0][2:6]
        payload = _checked(block, stated)
        return page, kind, origin, refers, len(payload), stated, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, origin, parts = _Rows(_schema(_READ)), None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("origin", "segment", "total", "type", "page_id", "digest", "refers_to", "block")]
            for i in range(batch.num_rows):
                name, *part = (c[i].as_py() for c in columns)
                if name != origin:
                    if parts:
                        row = whole(origin, parts)
                        yield from out.add(row, row[4] * with_payload)
                    origin, parts = name, []
                parts.append(tuple(part))
        if parts:
            row = whole(origin, parts)
            yield from out.add(row, row[4] * with_payload)
        yield from out.flush()
        release()

    return run


def read(ws: Workspace, path: str, payload: bool = True) -> DataFrame:
    """Per response or revisit record: page_id, record_type, record_id, refers_to_id, payload_bytes, payload_digest, payload.

    Reads ``.warc`` and ``.warc.gz`` files and those of ``write`` below ``path``, each file of at most 2 GB as stored.
    Segmented records are whole again; a missing segment, a wrong total length or a payload unlike its digest is an error.
    A revisit's payload and size are null here, and so is every payload where it isn't asked for.  Records of other kinds
    are skipped.  An empty archive has no rows.
    """
    files = ws.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", FILES).load(path).select("content")
    parts = ws.save(files.mapInArrow(_parsed(payload), _SEGMENTED), "parsed")
    whole = parts.where("segment = 0").select("page_id", F.col("type").alias("record_type"), F.col("name").alias("record_id"), F.col("refers_to").alias("refers_to_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "payload")
    dealt = parts.where("segment > 0").select("origin", "segment", "total", "type", "page_id", "digest", "refers_to", "block").repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(dealt.mapInArrow(_joined(payload), _READ))


def round_trip(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to - written as archives and read back.

    A revisit's size is that of the response it refers to; refers_to is that response's page_id, null where it has none.
    Null html is an empty payload, repeated rows and null ids have records of their own, an empty table has no rows,
    other columns are ignored.
    """
    path = write(pages, ws, "archives")
    back = ws.save(read(ws, path, payload=False).drop("payload"), "index")
    ws.drop("archives", "parsed")
    known = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("there"), F.col("page_id").alias("refers_to"))
    return lookup(back, known, "refers_to_id").select("page_id", F.coalesce("payload_bytes", "there").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def query(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
