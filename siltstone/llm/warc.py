"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes archives of bounded size, records without
compression around HTTP responses whose bodies are gzip-coded, and the commit
on the driver lists the finished files in a manifest, so that files of lost or
repeated tasks are never read.  Reading: one partition per archive of the
manifest (of the folder, where there is none); the header of a record is parsed
first, filters on headers pushed down by Spark decide about it, and the block
of an unwanted record is skipped by its length, or read but not decoded with
``payload=false``.  Archives compressed by record (``.warc.gz``) can be read too.

Columns: ``record_id, record_type, target_uri, refers_to, payload_digest``
(header fields), ``payload_bytes`` (of the full payload, also of a revisit) and
``payload`` (null for revisits and with ``payload=false``).  ``verify=true``
recomputes length and digest of each payload that is there.

Defined cases: a null payload is an empty one; null header fields are left out
and come back null; signs that a header line can't hold are percent-coded; an
empty table gives an archive folder with an empty manifest; further columns are
refused by the writer, so select the named ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
# Header fields of a record; the last is an extension, allowed by the format.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "WARC-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest.json"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>%]")


def file_system(path: str):
    """Any store that pyarrow knows, by the scheme of the path."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|7F|3C|3E|25)", lambda m: chr(int(m[1], 16)), value)


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n"
    block = http if revisit else http + gzip.compress(payload, 6, mtime=0)
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}"]
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            head.append(f"{FIELDS[column]}: <{_safe(row[column])}>")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest'] or digest_of(payload)}")
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    head += [f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The header fields of the next record, by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _columns(fields: dict[str, str]) -> dict:
    row = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            row[column] = _plain(row[column].strip("<>"))
    if row["target_uri"] is not None:
        row["target_uri"] = _plain(row["target_uri"])
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    row["payload_bytes"] = None if row["payload_bytes"] is None else int(row["payload_bytes"])
    return row


def _payload(block: bytes) -> bytes:
    """The body of an HTTP response, its coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^content-encoding:\s*gzip\s*$", head):
        return zlib.decompress(body, 31)
    return body


def read_records(stream, wanted, payload: bool = True, verify: bool = False):
    """Rows of one archive for whose header fields ``wanted(row)`` holds.

    ``stream`` needs ``readline``, ``read`` and ``seek``.
    """
    while (fields := _header(stream)) is not None:
        length = int(fields["content-length"])
        row = _columns(fields)
        if not wanted(row) or (not payload and not verify):
            stream.seek(length, io.SEEK_CUR)
            if wanted(row):
                yield row | {"payload": None}
            continue
        body = stream.read(length)
        if len(body) < length:
            raise ValueError("an archive ends within a record")
        body = _payload(body) if row["record_type"] == "response" else None
        if verify and body is not None:
            if len(body) != row["payload_bytes"] or digest_of(body) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} differs from its header")
        yield row | {"payload": body if payload else None}


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.allowed: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Takes equality, membership and presence of header fields; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in FIELDS:
                yield f
            elif isinstance(f, EqualTo):
                self.allowed[column] = self.allowed.get(column, {f.value}) & {f.value}
            elif isinstance(f, In):
                self.allowed[column] = self.allowed.get(column, set(f.value)) & set(f.value)
            elif isinstance(f, IsNotNull):
                self.present.add(column)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = file_system(self.folder)
        manifest = f"{root.rstrip('/')}/{MANIFEST}"
        if store.get_file_info(manifest).type == fs.FileType.NotFound:
            found = store.get_file_info(fs.FileSelector(root))
            names = sorted(i.base_name for i in found if re.search(r"\.warc(\.gz)?$", i.base_name))
        else:
            with store.open_input_stream(manifest) as file:
                names = json.loads(file.read())
        return [ArchivePartition(f"{self.folder.rstrip('/')}/{name}") for name in names]

    def read(self, partition):
        if not isinstance(partition, ArchivePartition):
            return  # a folder without archives
        allowed, present = self.allowed, self.present

        def wanted(row):
            return all(row[c] in values for c, values in allowed.items()) and all(row[c] is not None for c in present)

        store, path = file_system(partition.path)
        with store.open_input_file(path) as file:
            stream = gzip.GzipFile(fileobj=file) if path.endswith(".gz") else io.BufferedReader(file, 1 << 20)
            rows, size = [], 0
            for row in read_records(stream, wanted, self.payload, self.verify):
                rows.append(row)
                size += 300 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator):
        store, root = file_system(self.folder)
        store.create_dir(root, recursive=True)
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc")
                        out, size = store.open_output_stream(f"{root.rstrip('/')}/{names[-1]}"), 0
                    data = record_bytes(row, self.date)
                    out.write(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        store, root = file_system(self.folder)
        store.create_dir(root, recursive=True)
        names = sorted(name for m in messages if m is not None for name in m.names)
        with store.open_output_stream(f"{root.rstrip('/')}/{MANIFEST}") as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages):
        """Files that no manifest names are never read."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        have = [f.name for f in schema.fields]
        if have != ARROW.names:
            raise ValueError(f"expected the columns {ARROW.names}, got {have}")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, key: str, payload: str, extra: tuple[str, ...] = (), min_bytes: int = 0) -> DataFrame:
    """``key``, ``_payload``, ``extra`` with ``digest`` (hex), ``bytes`` and ``first``.

    ``first`` is the smallest key among the rows of an equal payload of at
    least ``min_bytes`` bytes, else null: rows above it are revisits.  Only
    keys and digests meet by digest; payloads move once, by their own key.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(key, *extra, text.alias("_payload"), F.sha1(text).alias("digest"), F.octet_length(text).alias("bytes"))
    narrow = rows.where(F.col("bytes") >= min_bytes).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"))
    firsts = narrow.groupBy(F.col("_digest").alias("_of")).agg(F.min("_key").alias("first"), F.count("*").alias("_n"))
    later = narrow.join(firsts.where("_n > 1"), F.col("_digest") == F.col("_of"))
    later = later.where("first IS NOT NULL AND (_key IS NULL OR _key > first)")
    later = later.select("_key", "_digest", "first").distinct()
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    return rows.join(later.hint("shuffle_hash"), same, "left").select(
        key, *extra, "_payload", "digest", "bytes", "first"
    )
