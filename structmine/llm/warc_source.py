"""WARC archives as a Spark data source written in Python: ``format("warc")``.

Reading plans one partition for every ``partition_bytes`` of files.  Equality and membership predicates
on ``record_type`` and the other header columns are pushed down; a record's headers are parsed first
and its block is read only where they pass and the schema asked for has ``payload``.  In compressed
archives every record is a gzip member of its own whose header names its length (subfield ``sl``), so of a
record that isn't wanted no more than its headers are decompressed, ``STEP_BYTES`` at a time; members without
that field are read through.  An archive is read by one task, so archives should be of ordinary size (a GB).

A block is an HTTP message where its content type says so, or where it has none and the record is a request,
response or revisit; the payload is what follows the HTTP head, however long that is (nothing where the head
doesn't end).  Every other block is the payload as it stands.  ``payload_length`` counts the payload in the
record; for a revisit, which leaves it out, it is what the HTTP head says, or null.

Writing makes one archive for about ``file_bytes`` of records in each task, in a folder of the job's own;
files move to their place when the job commits and the folder goes then, or when the job is given up.

``dedupe`` says which records repeat a payload.  Edge cases: a null payload is empty; a null URL has no
header; line breaks in a URL are percent-encoded; records of equal ids are written each; an empty table
gives no archive, and a folder without archives reads as an empty table.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from structmine.llm.shared import local_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_length long, payload binary"
)
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
READ_BYTES = 64 * 1024
STEP_BYTES = 1024
BATCH_BYTES = 8 * 1024 * 1024


# -- records as bytes ------------------------------------------------------------------------------


def record_bytes(row) -> bytes:
    """A record: named headers, then an HTTP response whose body a revisit leaves out."""
    clean = lambda text: text.replace("\r", "%0D").replace("\n", "%0A")
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n"
    block = http.encode() + (b"" if revisit else bytes(row["payload"] or b""))
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['date'] or EPOCH}",
        *([f"WARC-Target-URI: {clean(row['target_uri'])}"] if row["target_uri"] is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member that names its own length and that of the record."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _member_size(head: bytes) -> int | None:
    if len(head) < 12 or not head[3] & 4:
        return None
    fields, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(fields):
        size = struct.unpack_from("<H", fields, at + 2)[0]
        if fields[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", fields, at + 4)[0]
        at += 4 + size
    return None


def parse_head(head: bytes) -> tuple[dict[str, str], int]:
    """Headers by lower-case name, and where the block begins; raises where the head isn't whole."""
    end = head.index(b"\r\n\r\n")
    version, *lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    named = (line.partition(":") for line in lines)
    return {n.strip().lower(): v.strip() for n, _, v in named}, end + 4


class _Compressed:
    """Records of an archive of gzip members, from a seekable file; ``decoded`` counts decompressed bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.decoded = file, size, 0, 0

    def heads(self) -> Iterator[tuple[dict[str, str], int]]:
        while self.at < self.size:
            self.file.seek(self.at)
            self.raw = self.file.read(min(READ_BYTES, self.size - self.at))
            length = _member_size(self.raw)
            self.unzip, self.plain = zlib.decompressobj(31), bytearray()
            while b"\r\n\r\n" not in self.plain and not self.unzip.eof:
                self.plain += self._more(STEP_BYTES)
            yield parse_head(self.plain)
            if length is None:
                while not self.unzip.eof:  # how long the member is shows only at its end
                    self._more(READ_BYTES)
                self.at = self.file.tell() - len(self.unzip.unused_data)
            else:
                self.at += length

    def _more(self, most: int) -> bytes:
        raw = self.raw or self.file.read(READ_BYTES)
        out = self.unzip.decompress(raw, most)
        self.raw = self.unzip.unconsumed_tail
        self.decoded += len(out)
        if not raw and not out and not self.unzip.eof:
            raise ValueError("a gzip member breaks off")
        return out

    def block(self, start: int, length: int) -> bytes:
        while (missing := start + length - len(self.plain)) > 0 and not self.unzip.eof:
            self.plain += self._more(missing)
        return bytes(self.plain[start : start + length])


class _Plain:
    """Records of an archive that isn't compressed."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def heads(self) -> Iterator[tuple[dict[str, str], int]]:
        while self.at < self.size:
            self.file.seek(self.at)
            head = bytearray()
            while b"\r\n\r\n" not in head and (more := self.file.read(STEP_BYTES)):
                head += more
            headers, start = parse_head(head)
            yield headers, start
            self.at += start + int(headers.get("content-length", 0)) + 4

    def block(self, start: int, length: int) -> bytes:
        self.file.seek(self.at + start)
        return self.file.read(length)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(local_path(path))


# -- reading ---------------------------------------------------------------------------------------


@dataclass
class Archives(InputPartition):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: Sequence[str]):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 * 1024 * 1024))
        self.columns = list(columns)
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self):
        store, root = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))
        groups, room = [], 0
        for path, size in files:
            if not groups or room + size > self.partition_bytes:
                groups.append([])
                room = 0
            groups[-1].append((path, size))
            room += size
        return [Archives(tuple(g)) for g in groups] or [Archives(())]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        kinds = {c: pa.binary() if c == "payload" else pa.int64() if c == "payload_length" else pa.string() for c in self.columns}
        schema = pa.schema(list(kinds.items()))
        store, _ = _filesystem(self.path)
        rows: list[dict] = []
        size = 0
        for path, length in partition.files:
            with store.open_input_file(path) as file:
                for row in self._records((_Compressed if path.endswith(".gz") else _Plain)(file, length)):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, archive) -> Iterator[dict]:
        body = "payload" in self.columns or "payload_length" in self.columns
        for headers, start in archive.heads():
            row = {c: _header_value(c, headers.get(h)) for c, h in HEADERS.items()}
            if any(row[c] not in values for c, values in self.wanted.items()):
                continue
            if body:
                all_of = int(headers.get("content-length", 0))
                head = _http_head(archive, start, all_of) if _is_http(headers) else b""
                if row["record_type"] == "revisit":
                    row["payload_length"], row["payload"] = _http_length(head), None
                else:
                    row["payload_length"] = all_of - len(head)
                    if "payload" in self.columns:
                        row["payload"] = archive.block(start, all_of)[len(head) :]
            yield {c: row.get(c) for c in self.columns}


def _header_value(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column == "payload_digest":
        return base64.b32decode(value.removeprefix("sha1:")).hex() if value.startswith("sha1:") else value
    return value.removeprefix("<").removesuffix(">") if column in ("record_id", "refers_to") else value


def _is_http(headers: dict[str, str]) -> bool:
    kind = headers.get("content-type")
    if kind is None:
        return headers.get("warc-type") in ("request", "response", "revisit")
    return kind.lower().startswith("application/http")


def _http_head(archive, start: int, length: int) -> bytes:
    """The block up to its first empty line, all of it where there is none; read in growing steps."""
    have = 0
    while have < length:
        have = min(length, max(STEP_BYTES, 2 * have))
        block = archive.block(start, have)
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4]
        if len(block) < have:
            break
    return archive.block(start, have)


def _http_length(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


# -- writing ---------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.staging = f"_staging-{uuid.uuid4().hex}"
        self.file_bytes = int(options.get("file_bytes", 64 * 1024 * 1024))
        self.compressed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator) -> Written:
        store, root = _filesystem(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        files, out, room = [], None, 0
        for row in iterator:
            if out is None or room <= 0:
                if out is not None:
                    out.close()
                files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}")
                out, room = store.open_output_stream(f"{root}/{self.staging}/{files[-1]}.part", compression=None), self.file_bytes
            data = record_bytes(row)
            data = member(data) if self.compressed else data
            out.write(data)
            room -= len(data)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages) -> None:
        store, root = _filesystem(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.move(f"{root}/{self.staging}/{name}.part", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        """What failed, repeated and given up tasks wrote goes with the job's folder."""
        store, root = _filesystem(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages -----------------------------------------------------------------------------------------

LEAST_BYTES = 1000


def dedupe(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as records: of equal payloads the largest page_id is the response.

    Payloads are told apart by SHA-1 in narrow tables; the payloads themselves move once, by page_id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    whole = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")}
    )
    narrow = whole.where(F.col("payload_length") >= least_bytes).select("page_id", "payload_digest")
    first = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last"))
    repeated = first.where("first <> last").select("payload_digest", "first")
    revisits = narrow.join(repeated, "payload_digest").where("page_id <> first")
    revisits = revisits.select("page_id", "payload_digest", "first").distinct()
    records = whole.join(revisits, ["page_id", "payload_digest"], "left")
    revisit = F.col("first").isNotNull()
    return records.select(
        _urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("date"),
        "payload_digest",
        F.when(revisit, _urn(F.col("first"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _urn(page_id):
    return F.concat(F.lit("urn:page:"), page_id.cast("string"))


def page_of(urn):
    return F.substring_index(urn, ":", -1).cast("long")


def write(records: DataFrame, folder: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(folder)


def read(spark: SparkSession, folder: str, columns: Sequence[str] = (), **options) -> DataFrame:
    """The records; with ``columns`` only those are made, and blocks are left alone unless needed."""
    register(spark)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    asked = ", ".join(f"{c} {kinds[c]}" for c in columns) if columns else SCHEMA
    return spark.read.format("warc").schema(asked).options(**options).load(folder)
