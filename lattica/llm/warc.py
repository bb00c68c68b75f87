"""WARC archives as a Spark data source ("warc"), read and written in Python.

Reading plans a partition for each range of a file. A record belongs to the range it begins in, and a
reader finds the first one by its magic bytes and by what its headers say, so large archives split, compressed
by record or not (an uncompressed archive that holds another archive as a payload needs split above its size).
Predicates on header columns are pushed down (with spark.sql.python.filterPushdown.enabled, which
read_warc() sets; a record type can also be asked for by option). Headers are parsed first; a record that
fails a predicate, or whose payload is not asked for, is skipped: uncompressed ones by their length,
compressed ones by the skip length that the WARC standard's annex on gzip defines, where the writer left it.
Writing gives each task a file of its own under a hidden name, renamed when all tasks have succeeded, so
lost executors and repeated attempts leave neither gaps nor repeats.

Payloads equal to an earlier one are written as revisit records (identical-payload-digest): HTTP headers
only, with the digest and the record they refer to.

Of equal payloads the row with the smallest id is the response, of rows that repeat that id one; rows without an id
come after all others, and a revisit to one names its record alone. Each row has a record id of its own.

Edge cases: a null payload is empty; a null URL or id leaves its header out; line breaks in a URL are
percent-encoded; truncated archives give the records before the damage, and an error only with
option strict; an empty folder or table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import Scratch
from .store import Store

SCHEMA = "record_type string, record_id string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to_record string, refers_to long, content_length long, payload binary, file string, offset long"
#: Bytes of a partition, and how far a reader looks at a time.
SPLIT, CHUNK = 64 << 20, 1 << 20
#: Smallest payload that is replaced by a revisit.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = {"record_type": b"warc-type", "record_id": b"warc-record-id", "page_id": b"x-page-id", "target_uri": b"warc-target-uri", "date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to_record": b"warc-refers-to", "refers_to": b"x-refers-to-page-id"}
_NUMBERS = {"page_id", "refers_to"}


def _value(column: str, headers: dict[bytes, bytes]):
    raw = headers.get(_COLUMNS[column])
    if raw is None:
        return None
    text = raw.decode("utf-8", "replace")
    if column == "payload_digest":
        text = text.removeprefix("sha256:")
    return int(text) if column in _NUMBERS else text


def _headers(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


# --- writing


def _field(name: str, value) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n".encode("utf-8", "replace")


def record(row: dict, date: str = DATE) -> bytes:
    """The bytes of one record: response, or revisit if the row says so."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _field("WARC-Type", row["record_type"]) + _field("WARC-Record-ID", row["record_id"]) + _field("WARC-Date", date)
    head += _field("Content-Type", "application/http; msgtype=response") + _field("Content-Length", len(block)) + _field("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")
    for name, key in (("WARC-Target-URI", "target_uri"), ("X-Page-ID", "page_id")):
        if row.get(key) is not None:
            head += _field(name, row[key])
    if revisit:
        head += _field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", row["refers_to_record"])
        if row["refers_to"] is not None:
            head += _field("X-Refers-To-Page-ID", row["refers_to"])
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length in an extra field, so that readers can step over it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    hidden: str
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.level, self.date = options["path"], int(options.get("level", 6)), options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, own = Store(self.uri), Store.unique()
        done = _Written(f".{own}.warc.gz", f"part-{own}.warc.gz", 0)
        out = None
        for b in iterator:
            for row in b.to_pylist():
                if out is None:
                    out = store.create(done.hidden)
                out.write(member(record(row, self.date), self.level))
                done.records += 1
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.records:
                Store(self.uri).move(m.hidden, m.name)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                Store(self.uri).delete(m.hidden)


# --- reading


class _Window:
    """Bytes of a file from a position on, read as needed."""

    def __init__(self, f: BinaryIO, at: int, size: int):
        self.f, self.at, self.size, self.buf = f, at, size, b""
        f.seek(at)

    def need(self, n: int) -> bool:
        while len(self.buf) < n:
            more = self.f.read(max(CHUNK, n - len(self.buf)))
            if not more:
                return False
            self.buf += more
        return True

    def drop(self, n: int) -> None:
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.f.seek(self.at + n)
            self.buf = b""
        self.at += n


def _skip_length(buf: bytes) -> int:
    """The skip length in a gzip member's extra field, or 0."""
    if len(buf) >= 24 and buf[3] & 4:
        end = 12 + struct.unpack_from("<H", buf, 10)[0]
        at = 12
        while at + 4 <= min(end, len(buf)):
            kind, n = buf[at : at + 2], struct.unpack_from("<H", buf, at + 2)[0]
            if kind == b"sl" and n == 8 and at + 12 <= len(buf):
                return struct.unpack_from("<I", buf, at + 4)[0]
            at += 4 + n
    return 0


def _plausible(w: _Window, at: int) -> bool:
    """Whether an uncompressed record begins `at` bytes into the window: its headers name a type and a length, and a record or the end of the file follows."""
    stop = -1
    while (stop := w.buf.find(b"\r\n\r\n", at)) < 0 and len(w.buf) - at < CHUNK:
        if not w.need(len(w.buf) + 1):
            break
    head = w.buf[at:stop] if stop >= 0 else b""
    h = _headers(head)
    if b"warc-type" not in h or not h.get(b"content-length", b"").isdigit():
        return False
    after = w.at + stop + 4 + int(h[b"content-length"])
    w.f.seek(after)
    follows = w.f.read(11)
    w.f.seek(w.at + len(w.buf))
    return after > w.size or follows[:4] == b"\r\n\r\n" and follows[4:] in (b"", b"WARC/1.")


def _start(w: _Window, end: int, gz: bool) -> bool:
    """Move to the first record at or after the window's position that begins before `end`."""
    magic = b"\x1f\x8b\x08" if gz else b"WARC/1."
    first = True
    while w.at < end:
        if not w.need(64) and not w.buf:
            return False
        at = w.buf.find(magic)
        if at < 0:
            n = max(len(w.buf) - 16, 0)
            w.drop(n or len(w.buf))
            if not n:
                return False
            first = False
            continue
        if w.at + at >= end:
            return False
        begins = w.at == 0 and at == 0 and first
        if not begins and not gz and at < 4:  # what stands before decides, and it is in the range before
            w.f.seek(max(0, w.at + at - 4))
            begins = w.f.read(4) == b"\r\n\r\n"
            w.f.seek(w.at + len(w.buf))
        elif not gz:
            begins = begins or w.buf[at - 4 : at] == b"\r\n\r\n"
        if begins and not gz and w.at + at:
            begins = _plausible(w, at)
        if gz:
            try:
                w.need(at + 512)
                begins = zlib.decompressobj(31).decompress(w.buf[at : at + 4096], 7) == b"WARC/1."
            except zlib.error:
                begins = False
        w.drop(at if begins else at + 1)
        first = False
        if begins:
            return True
    return False


def records(store: Store, name: str, size: int, begin: int, end: int, wanted, payload_of, strict: bool = False) -> Iterator[tuple[dict, bytes | None, int]]:
    """Headers, payload (None where payload_of() declines) and offset of the records beginning in [begin, end) that wanted() admits."""
    with store.open(name) as f:
        gz = (store.path(name)).endswith(".gz")
        w = _Window(f, begin, size)
        if not _start(w, end, gz):
            return
        while w.at < end and (w.need(12) or w.buf):
            offset = w.at
            try:
                if gz:
                    w.need(24)
                    skip = _skip_length(w.buf)
                    z, raw, used = zlib.decompressobj(31), b"", 0

                    def more(limit: int) -> bytes:
                        nonlocal used
                        if z.eof:
                            return b""
                        data = z.unconsumed_tail or None
                        if data is None:
                            if not w.need(used + 1):
                                raise EOFError("the archive ends within a record")
                            data = w.buf[used:]
                            used = len(w.buf)
                        return z.decompress(data, limit)

                    while b"\r\n\r\n" not in raw:
                        raw += more(2048)
                        if z.eof and b"\r\n\r\n" not in raw:
                            raise ValueError("a record without the end of its headers")
                    head, _, body = raw.partition(b"\r\n\r\n")
                    h = _headers(head)
                    keep = wanted(h)
                    decode = keep and payload_of(h)
                    need_http = keep and not decode
                    if decode:
                        parts = [body]
                        while not z.eof:
                            parts.append(more(CHUNK))
                        body = b"".join(parts)
                    elif need_http:
                        while b"\r\n\r\n" not in body and not z.eof and len(body) < CHUNK:
                            body += more(2048)
                    if not skip:
                        while not z.eof:
                            more(CHUNK)
                        skip = used - len(z.unused_data)
                else:
                    at = -1
                    while (at := w.buf.find(b"\r\n\r\n")) < 0:
                        if not w.need(len(w.buf) + 1):
                            raise EOFError("the archive ends within headers")
                    h = _headers(w.buf[:at])
                    n = int(h.get(b"content-length", b"0"))
                    keep = wanted(h)
                    decode = keep and payload_of(h)
                    skip = at + 4 + n + 4
                    if keep:
                        w.need(at + 4 + (n if decode else min(n, CHUNK)))
                        body = w.buf[at + 4 : at + 4 + n]
                        if decode and len(body) < n:
                            raise EOFError("the archive ends within a record")
            except (EOFError, ValueError, zlib.error):
                if strict:
                    raise
                return
            if keep:
                n = int(h.get(b"content-length", b"0"))
                http, sep, rest = body[:n].partition(b"\r\n\r\n") if b"http" in h.get(b"content-type", b"") else (b"", b"", body[:n])
                if sep:
                    h[b"payload-length"] = _headers(http).get(b"content-length", str(n - len(http) - 4).encode())
                else:
                    h[b"payload-length"] = str(n).encode()
                yield h, rest if decode else None, offset
            w.drop(skip)


@dataclass
class _Range(InputPartition):
    name: str
    size: int
    begin: int
    end: int


class WarcReader(DataSourceReader):
    """Options: path; payload: all, none, or record types by comma (default response); split: bytes; types: record types by comma; strict."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split, self.strict = int(options.get("split", SPLIT)), options.get("strict", "false") == "true"
        self.payload = options.get("payload", "response")
        self.tests: list[tuple[str, str, object]] = []
        if "types" in options:
            self.tests.append(("in", "record_type", frozenset(options["types"].split(","))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _COLUMNS and isinstance(f, EqualTo):
                self.tests.append(("in", column, frozenset([f.value])))
            elif column in _COLUMNS and isinstance(f, In):
                self.tests.append(("in", column, frozenset(f.value)))
            elif column in _COLUMNS and isinstance(f, IsNotNull):
                self.tests.append(("set", column, None))
            elif column in _COLUMNS and column not in _NUMBERS and isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        return [_Range(name, size, b, min(size, b + self.split)) for name, size in Store(self.uri).files() if ".warc" in (name or self.uri) for b in range(0, size, self.split)] or [_Range("", 0, 0, 0)]

    def _wanted(self, h: dict[bytes, bytes]) -> bool:
        for kind, column, against in self.tests:
            v = _value(column, h)
            if v is None or kind == "in" and v not in against or kind == "starts" and not v.startswith(against):
                return False
        return True

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.begin:
            return
        types = None if self.payload == "all" else frozenset(() if self.payload == "none" else self.payload.split(","))
        decode = lambda h: types is None or h.get(b"warc-type", b"").decode("latin1") in types
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "content_length": pa.int64(), "payload": pa.binary(), "offset": pa.int64()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(x, kinds.get(x, pa.string())) for x in names])
        rows, held = [], 0
        for h, payload, offset in records(Store(self.uri), part.name, part.size, part.begin, part.end, self._wanted, decode, self.strict):
            row = {c: _value(c, h) for c in _COLUMNS}
            rows.append(row | {"payload_bytes": int(h[b"payload-length"]), "content_length": int(h.get(b"content-length", b"0")), "payload": payload, "file": part.name, "offset": offset})
            held += len(payload or b"") + 500
            if held > 4 * CHUNK:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def _urn(ident, row) -> F.Column:
    h = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("/"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Rows for the writer. Of equal payloads of `least` bytes or more the smallest id is the response, others are revisits."""
    scratch = Scratch(pages.sparkSession, "warc-rows")
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload"))
    # digests are taken, and rows numbered, once: what counts digests reads no payload
    rows = scratch.keep(rows.select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").alias("size"), F.monotonically_increasing_id().alias("row")), "rows")
    # only payloads that occur again: sizes stay small where copies are rare, and counting comes before any join
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row")
    again = rows.where(F.col("size") >= least).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("payload_digest", "first")
    # kept as a table, so that the join can split a common digest
    rows = rows.join(scratch.keep(again, "again"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    return rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), _urn(F.col("page_id"), F.col("row")).alias("record_id"), "page_id", "target_uri", "payload_digest", F.when(revisit, _urn(F.col("first.page_id"), F.col("first.row"))).alias("refers_to_record"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), "payload")


def write_warc(records_: DataFrame, path: str, level: int = 6) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").option("level", str(level)).mode("append").save(path)
