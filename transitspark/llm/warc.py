"""WARC archives as a PySpark data source, format "warc".

Reading plans partitions of whole files, or of byte ranges of files that are compressed record by record: a range
owns the records whose gzip member begins in it. Filters on record_type, page_id and target_uri are pushed down:
the headers of a record are parsed first, and a record that no filter lets through is passed over without decoding its
payload. With option("payload", "false") no payload is decoded at all.

Writing takes rows (page_id, url, payload, digest, refers_to). A task writes one archive under a name of its own, and
the commit lists the archives of accepted tasks in `_archives.json`; readers take no other file, so what a lost or
repeated task leaves behind is never read. Writing again to a folder replaces what it lists.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_folder, table

LIST = "_archives.json"
#: Bytes of an archive that one task reads, and rows that a reader hands over at once.
RANGE, ROWS = 32 << 20, 256
SCHEMA = "record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int, url: str | None, payload: bytes, sha1: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload but says how long the one that it refers to is."""
    block = HTTP % length + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%~-._''')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if kind == "revisit" else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """Header lines below the first, names in lower case; a line that begins with white space goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


@dataclass
class Archive(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class Members:
    """The gzip members of an archive that begin in a range, each read no further than is asked for."""

    def __init__(self, f, begin: int, end: int, size: int):
        self.f, self.at, self.end, self.size = f, begin, end, size
        self.held = b""

    def _more(self) -> bool:
        new = self.f.read_at(min(1 << 20, self.size - self.at - len(self.held)), self.at + len(self.held)) if self.at + len(self.held) < self.size else b""
        self.held += new
        return bool(new)

    def _sync(self) -> bool:
        """Goes to the next place at or after `at` where a record's member begins."""
        while True:
            k = self.held.find(b"\x1f\x8b\x08")
            while k >= 0:
                if len(self.held) < k + 4096 and self._more():
                    k = self.held.find(b"\x1f\x8b\x08")
                    continue
                try:
                    if zlib.decompressobj(31).decompress(self.held[k : k + 4096], 5) == b"WARC/":
                        self.at, self.held = self.at + k, self.held[k:]
                        return self.at < self.end
                except zlib.error:
                    pass
                k = self.held.find(b"\x1f\x8b\x08", k + 1)
            keep = self.held[-2:]
            self.at, self.held = self.at + len(self.held) - len(keep), keep
            if self.at >= self.end or not self._more():
                return False

    def __iter__(self) -> Iterator["Member"]:
        if not self._sync():
            return
        while self.at < self.end:
            if not self.held and not self._more():
                return
            m = Member(self)
            yield m
            m.close()

    def advance(self, n: int) -> None:
        self.at, self.held = self.at + n, self.held[n:]


class Member:
    def __init__(self, owner: Members):
        self.owner, self.inflate, self.data = owner, zlib.decompressobj(31), b""
        self.used = 0

    def _feed(self) -> bool:
        o = self.owner
        if self.inflate.eof:
            return False
        if len(o.held) <= self.used and not o._more():
            raise EOFError("an archive ends within a record")
        part = o.held[self.used : self.used + 65536]
        self.data += self.inflate.decompress(part)
        self.used += len(part) - len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes, at: int = 0) -> int:
        while (k := self.data.find(mark, at)) < 0:
            if not self._feed():
                raise ValueError("a record without an end of its headers")
        return k

    def whole(self) -> bytes:
        while self._feed():
            pass
        return self.data

    def close(self) -> None:
        """Goes past the member: what is left of it is inflated, but not kept or decoded."""
        while not self.inflate.eof:
            self._feed()
            self.data = b""
        self.owner.advance(self.used)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.columns = [f.name for f in schema.fields]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if name in ("record_type", "page_id", "target_uri") and getattr(f, "value", 0) is not None:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = file_system(self.path)
        with fs.open_input_stream(f"{base}/{LIST}") as f:
            listed = json.loads(f.read())
        return [Archive(x["name"], at, min(at + RANGE, x["bytes"])) for x in listed for at in range(0, x["bytes"], RANGE)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no archive is listed
            return
        fs, base = file_system(self.path)
        rows: list[dict] = []
        types = {"record_type": pa.string(), "page_id": pa.int64(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types[c]) for c in self.columns])
        path = f"{base}/{partition.path}"
        with fs.open_input_file(path) as f:
            held = 0
            for member in Members(f, partition.begin, partition.end, f.size()):
                row = self.parse(member)
                if row is not None:
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                if len(rows) >= ROWS or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def parse(self, member: Member) -> dict | None:
        top = member.until(b"\r\n\r\n")
        h = headers(member.data[:top])
        row = {"record_type": h.get("warc-type"), "page_id": page_of(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri")}
        if any(row[k] not in v for k, v in self.wanted.items()):
            return None  # before anything of the payload is looked at
        row |= {"payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": page_of(h.get("warc-refers-to"))}
        mid = member.until(b"\r\n\r\n", top + 4)
        row["payload_bytes"] = int(headers(member.data[top + 4 : mid]).get("content-length", 0))
        if self.payload and row["record_type"] == "response":
            end = top + 4 + int(h["content-length"])
            row["payload"] = member.whole()[mid + 4 : end]
        return row


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in iterator:
                for page, url, payload, n, sha1, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to"))):
                    kind = "response" if first is None else "revisit"
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = z.compress(record(kind, page, url, payload or b"", sha1, n, first)) + z.flush()
                    f.write(data)
                    size += len(data)
        return Written(name, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{LIST}") as f:
            f.write(json.dumps([{"name": m.name, "bytes": m.bytes} for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_pages(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html) as archives: null html is empty, null page_ids are left out.

    Of pages with equal payloads of at least `least` bytes the one with the smallest page_id is a response and the
    others are revisits of it; rows with a page_id of their group's smallest are responses. Which page a revisit refers
    to is found on rows of ids and digests alone; html moves once, dealt by page_id, so the pages of a payload that is
    everywhere are spread like any others. A revisit has no html from there on.
    """
    pages.sparkSession.dataSource.register(WarcDataSource)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    own = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    own = own.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    firsts = own.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    revisits = own.select("page_id", "sha1").join(firsts, "sha1").where("page_id <> first").distinct()
    rows = own.join(revisits, ["page_id", "sha1"], "left").withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha1 = [base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("sha1").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("payload"), b.column("size"), pa.array(sha1, pa.string()), b.column("refers_to")], ["page_id", "url", "payload", "size", "digest", "refers_to"])

    rows = rows.select("page_id", "url", "payload", "size", "sha1", F.col("first").alias("refers_to"))
    rows.mapInArrow(named, "page_id long, url string, payload binary, size long, digest string, refers_to long").write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives; turns on, for the session, that filters are pushed into Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of pages with a page_id, what its record in the archives says: length and digest of the payload, its
    type, and what a revisit refers to. A null html is an empty payload; no pages give no rows."""
    folder = shared_folder(spark)
    write_pages(table(spark, sf_dir, "pages"), folder)
    got = read_archives(spark, folder)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length and digest of what was read; a revisit has only its headers."""
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            full = [p if k == "response" else None for k, p in zip(c["record_type"], c["payload"])]
            size = [n if p is None else len(p) for p, n in zip(full, c["payload_bytes"])]
            sha1 = [d if p is None else digest(p) for p, d in zip(full, c["payload_digest"])]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(size, pa.int64()), pa.array(sha1), b.column("record_type"), b.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return got.mapInArrow(checked, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


QUERIES = {"op5_warc": op5_warc}
ORACLES: dict[str, str] = {}
