"""10. WARC archives as a PySpark Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Registered by ``register(spark)``. Options: ``path``; ``partitionBytes`` (read: files are put together up to so many bytes);
``fileBytes`` (write: a task begins a new file after so many); ``date`` (write: WARC-Date).
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmatch.llm.common import Scratch, ship, table
from quillmatch.llm.files import listing, open_input, open_output, remove

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Columns and the headers that hold them.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
END = b"\r\n\r\n"
CHUNK = 1 << 14
#: A header block beyond this, which none has, is an error; so a file that is no archive does not fill the memory.
LONGEST_HEADER = 1 << 28
#: Names that the writer gives.
PART = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")


# --- records ------------------------------------------------------------------------------------------------------------


_UNCLEAN = re.compile(r"[\x00-\x1f\x7f]|^[ <]+|[ >]+$")


def clean(value: str) -> str:
    """A value for a header line: control characters, and so line ends, are percent-encoded, as are blanks and brackets at its ends."""
    return _UNCLEAN.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def record(row: dict, date: str) -> bytes:
    """A response or revisit record; a revisit has the HTTP header of the payload that it leaves out."""
    payload = row.get("payload") or b""
    revisit = row.get("record_type") == "revisit"
    size = row.get("payload_bytes") if revisit and row.get("payload_bytes") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {clean(row.get('record_type') or 'response')}", f"WARC-Record-ID: <{clean(row.get('record_id') or f'urn:uuid:{uuid.uuid4()}')}>", f"WARC-Date: {clean(row.get('date') or date)}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    if row.get("payload_digest"):
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: <{clean(row['refers_to'])}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes, level: int = 3) -> bytes:
    """A gzip member of one record; its extra field ``sl`` has the lengths that let a reader skip it."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out[name := name.strip().lower()] = value.strip()
    return out


def bare(value: str | None) -> str | None:
    """A header's value without brackets around it."""
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


class Inflated:
    """The bytes of a gzip member, or of a file itself, from the start of a record, read as far as asked for."""

    def __init__(self, f: BinaryIO, packed: bool):
        self.f, self.d, self.buffer, self.out = f, zlib.decompressobj(31) if packed else None, bytearray(), False

    def more(self, n: int = CHUNK) -> bool:
        data = self.f.read(max(n, CHUNK) if self.d is None else CHUNK)
        self.buffer += self.d.decompress(data) if self.d is not None else data
        self.out = not data or (self.d is not None and self.d.eof)
        return not self.out

    def until_end(self, within: int = LONGEST_HEADER) -> bytes | None:
        """A header block, of any length up to ``within``; what follows it stays. None, and nothing read, if no block ends there."""
        looked = 0
        while True:
            at = self.buffer.find(END, max(0, looked - len(END) + 1), within)
            if at >= 0:
                head = bytes(self.buffer[:at])
                del self.buffer[: at + len(END)]
                return head
            looked = len(self.buffer)
            if looked >= within or self.out:
                return None
            self.more()

    def take(self, n: int) -> bytes:
        """The next n bytes; an error if there are fewer."""
        parts, have = [self.buffer], len(self.buffer)
        while have < n and not self.out:
            self.buffer = bytearray()
            self.more(n - have)
            parts.append(self.buffer)
            have += len(self.buffer)
        if have < n:
            raise ValueError(f"a record ends after {have} of {n} bytes")
        data = b"".join(parts)
        self.buffer = bytearray(data[n:])
        return data[:n]

    def drain(self) -> None:
        """Reads to the end of the member without keeping what is read; an error if it is cut."""
        self.buffer.clear()
        while not self.out:
            self.more()
            self.buffer.clear()
        if self.d is not None and not self.d.eof:
            raise ValueError("a compressed record is cut")


def records(f: BinaryIO, wanted: Callable[[dict[str, str]], bool], payloads: bool) -> Iterator[dict]:
    """Rows of a file's records, plain or a gzip member each.

    The headers of a record come first. If they are not wanted, the rest is skipped without being inflated, where the member says how
    long it is or the file is plain. Without ``payloads`` only the HTTP header of a wanted record is read too. A gzip
    member without its length is inflated to its end, in pieces. A header or payload of any length comes back whole; one that is cut is
    an error, never a short row.
    """
    at = 0
    while True:
        f.seek(at)
        start = f.read(12)
        if not start:
            return
        packed, after = start[:2] == b"\x1f\x8b", None
        if packed and start[3] & 4 and len(start) == 12:
            extra = f.read(struct.unpack("<H", start[10:12])[0])
            if extra[:2] == b"sl" and len(extra) >= 12:
                total, raw = struct.unpack("<II", extra[4:12])
                after = at + total if raw < 1 << 31 else None
        if not packed:  # line ends before a record are no part of it
            lead = len(start) - len(start.lstrip(b"\r\n"))
            if lead == len(start):
                at += lead
                continue
            if not b"WARC/".startswith(start[lead : lead + 5]):
                raise ValueError(f"no WARC record at byte {at}")
            at += lead
        f.seek(at)
        got = Inflated(f, packed)
        head = got.until_end()
        if head is None:
            if not got.buffer.strip(b"\r\n"):
                return
            raise ValueError(f"the headers of the record at byte {at} do not end")
        h = fields(head)
        length = int(h.get("content-length", 0))
        if not packed:
            after = at + len(head) + len(END) + length + len(END)
        if wanted(h):
            kind = h.get("warc-type", "")
            http = kind in ("response", "revisit") and h.get("content-type", "").replace(" ", "").startswith("application/http")
            inner, skipped = {}, 0
            if http:
                top = got.until_end(length)
                if top is not None:
                    inner, skipped = fields(top), len(top) + len(END)
            size = length - skipped
            if kind == "revisit" and inner.get("content-length", "").isdigit():
                size = int(inner["content-length"])
            digest = h.get("warc-payload-digest", "")
            if digest.lower().startswith("sha1:"):
                value = digest[5:]
                digest = value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else ""
            row = {c: bare(h.get(n)) for c, n in HEADERS.items()}
            row |= {"payload_digest": digest or None, "payload_bytes": size, "payload": (got.take(length - skipped) if kind != "revisit" else b"") if payloads else None}
            yield row
        if after is None:
            got.drain()
            after = f.tell() - len(got.d.unused_data)
        at = after


# --- data source --------------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists and prefixes on columns that are headers are decided before a record's payload is touched."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in order, put together up to ``partitionBytes``; a writer's files are no larger than ``fileBytes``."""
        out, names, size = [], [], 0
        for name, n in committed(self.path):
            if names and size + n > self.bytes:
                out.append(Files(tuple(names)))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, Files(tuple(names))]

    def wanted(self, h: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            v = bare(h.get(name))
            if v is None or (v not in values if how == "in" else not v.startswith(values)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        payloads, rows, size = "payload" in schema.names, [], 0
        for name in partition.names:
            with open_input(name) as f:
                for row in records(f, self.wanted, payloads):
                    rows.append({c: row[c] for c in schema.names})
                    size += 200 + len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def committed(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files to read. Where markers are, files of the writer's form of name that none of them names are left
    out, as attempts lost with their worker left them; files that others put there are read."""
    markers = [x for x, _ in listing(path, hidden=True) if x.rsplit("/", 1)[-1].startswith("_COMMITTED-")]
    named: set[str] = set()
    for x in markers:
        with open_input(x) as f:
            named.update(json.loads(f.read()))
    for name, n in listing(path):
        base = name.rsplit("/", 1)[-1]
        if not markers or base in named or not PART.fullmatch(base):
            yield name, n


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own names; those of failed attempts go when they fail or the job does."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.bytes = int(options.get("fileBytes", 64 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.old = [x for x, _ in listing(self.path)] if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        f, size = None, 0
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        if f is None or size > self.bytes:
                            if f:
                                f.close()
                            names.append(f"{self.path}/part-{uuid.uuid4().hex}.warc.gz")
                            f, size = open_output(names[-1]), 0
                        size += f.write(member(record(row, self.date)))
            if f:
                f.close()
        except BaseException:
            if f:
                f.close()
            for n in names:
                remove(n)
            raise
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        for n in self.old:
            remove(n)
        kept = {n.rsplit("/", 1)[1] for m in messages if m for n in m.names}
        with open_output(f"{self.path}/_COMMITTED-{uuid.uuid4().hex}") as f:
            f.write(json.dumps(sorted(kept)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for n in m.names if m else ():
                remove(n)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages --------------------------------------------------------------------------------------------------------------

REVISIT_BYTES = 1000
PREFIX = "urn:x-page:"


def archived(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """A row to write for each page. Of equal payloads of at least ``least`` bytes the one with the largest id is a response,
    the others revisit it; smaller ones are all responses. Null html is empty; a page without id never is the one revisited, and
    a group that has none but such is all responses. Pages of one id are all responses if it is the largest. Payloads and URLs are
    kept whole, whatever their length. An empty table makes an empty archive; other columns are ignored, whatever their names.

    Payloads are compared by digest, in a small table with partial aggregation; digests of several pages are joined back to
    the pages, in a skewed join, which adaptive execution splits, if they are too many to broadcast.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("target_uri"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.keep(groups.select("digest", "kept"), "groups")
    rows = rows.join(groups, rows["payload_digest"] == groups["digest"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    return rows.select(
        F.concat(F.lit(PREFIX), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, F.concat(F.lit(PREFIX), F.col("kept").cast("string"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, scratch: Scratch, **columns) -> None:
    register(pages.sparkSession)
    archived(pages, scratch, **columns).write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit record.

    Responses are read with their payloads, from which size and digest are found; revisits in a scan of headers alone. Both ask for
    their type of record, which the reader decides by the headers, so of other records nothing more is inflated.
    """
    register(spark)
    found = spark.read.format("warc").load(path)

    def number(c: str):
        return F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) as bigint)").alias({"record_id": "page_id"}.get(c, c))

    whole = found.where("record_type = 'response'").select(number("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", number("refers_to"))
    heads = spark.read.format("warc").schema(SCHEMA.rpartition(",")[0]).load(path).where("record_type = 'revisit'")
    return whole.unionByName(heads.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = f"{scratch.root}/archives"
    write_pages(table(spark, sf_dir, "pages"), path, scratch)
    return read_pages(spark, path)


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to FROM r
"""
