"""WARC archives as a Python data source, and revisit records for equal payloads.

Writing: every task writes archives of gzip members, a record each; a commit
lists the archives of the tasks that succeeded in a manifest of its own, so
files of failed attempts are never read and appends add up. A member carries
its own and its content's length in the gzip "sl" field, which lets a reader
pass it by unread.

Reading: the files of all manifests, or in a folder without one all .warc and
.warc.gz files, are dealt to partitions by size. Filters on the record type and
on header columns are pushed down; a record's headers are read first, and the
rest of an unwanted record is passed by: unread where a member has an "sl"
field or the file is plain, else inflated and thrown away in pieces. Records of
other writers may lack a digest (it is computed if the payload is read) or a
page id (null).
"""
from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import shared_path, table, written

MANIFEST = "_manifest"
#: Bytes of archives that a read task is given, as far as files allow, and that a write task puts in one file.
PART_BYTES, FILE_BYTES = 64 << 20, 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "warc_type string, page_id long, refers_to long, target_uri string, record_id string, payload_digest string, payload_bytes long, payload binary"
#: Header of each column that filters may name.
HEADERS = {"warc_type": "WARC-Type", "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page-ID", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID", "payload_digest": "WARC-Payload-Digest"}
_CASE = {k.lower(): k for k in (*HEADERS.values(), "Content-Length", "Content-Type", "WARC-Date")}
_BATCH, _BATCH_BYTES = 1000, 16 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{of}')}>"


def member(content: bytes) -> bytes:
    """A gzip member with an "sl" field: compressed length (of the member) and length of the content."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def _one_line(value) -> str:
    """A header value: control characters, which would end the line, as percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record(page_id, url, payload: bytes, refers_to, of: str) -> bytes:
    """A response, or a revisit if refers_to isn't None: then the payload is left out and its length stays in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, of)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", url)] if url is not None else []
    head += [("X-Page-ID", page_id)] if page_id is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{of}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, of)), ("X-Refers-To-Page-ID", refers_to)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    """Header lines by name as the known ones are written; continued lines are joined, names are compared without case."""
    lines = re.sub(r"\r?\n[ \t]+", " ", text.decode("utf-8", "replace")).splitlines()[1:]
    return {_CASE.get(k.strip().lower(), k.strip()): v.strip() for k, c, v in (line.partition(":") for line in lines) if c}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]{1,18}", text) else None


class _Source:
    """Bytes of one archive from a record's start on, inflated where the file is gzip."""

    def __init__(self, file, at: int, gzip: bool, size: int):
        self.file, self.at, self.gzip, self.size = file, at, gzip, size
        self.held, self.inflate, self.jump = b"", None, None
        file.seek(at)
        if gzip:
            fixed = file.read(24)
            if fixed[:4] == b"\x1f\x8b\x08\x04" and fixed[12:14] == b"sl":
                self.jump = at + struct.unpack("<I", fixed[16:20])[0]
            file.seek(at)
            self.inflate = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        """n bytes more, or what is left."""
        parts, size = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while size < n:
            if self.gzip and self.inflate.eof:
                break
            piece = self.file.read(min(n - size, 1 << 20) if not self.gzip else 1 << 14)
            if not piece:
                break
            piece = self.inflate.decompress(piece) if self.gzip else piece
            parts.append(piece[: n - size])
            self.held += piece[n - size :]
            size += len(parts[-1])
        return b"".join(parts)

    def until_blank(self) -> bytes | None:
        """Bytes up to an empty line, which is passed; null where there is none."""
        out = b""
        while True:
            found = re.search(rb"\r?\n\r?\n", out)
            if found:
                self.held = out[found.end() :] + self.held
                return out[: found.start()]
            piece = self.read(1024)
            if not piece:
                return None
            out += piece

    def next(self, left: int) -> int:
        """Where the next record begins, ``left`` bytes of this one being unread."""
        if self.jump is not None:
            return self.jump
        if not self.gzip:
            return self.file.tell() - len(self.held) + left
        while not self.inflate.eof:  # an unwanted member, in pieces
            piece = self.file.read(1 << 16)
            if not piece:
                return self.size
            while piece and not self.inflate.eof:
                self.inflate.decompress(piece, 1 << 20)
                piece = self.inflate.unconsumed_tail
        return self.file.tell() - len(self.inflate.unused_data)


#: Names that Hadoop has for stores which tasks reach by another.
STORES = {"s3a://": "s3://", "s3n://": "s3://", "gcs://": "gs://", "dbfs:/": "file:///dbfs/", "wasbs://": "abfss://"}


def address(path: str) -> str:
    """A path of Spark's as Python tasks open it."""
    return next((new + path[len(old) :] for old, new in STORES.items() if path.startswith(old)), path)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address(path))


@dataclass
class _Files(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files)}.warc.gz"
                    out, size = store.open_output_stream(f"{root}/{name}", compression=None), 0
                payload = (html or "").encode()
                data = member(record(page_id, url, payload, refers_to, digest(payload)))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    files.append([name, size])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return _Files(files)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                store.delete_file(f"{root}/{name}")


@dataclass
class _Part(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, (str(f.value),)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, tuple(map(str, f.value))))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, ()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _open(self.path)
        found = [store.get_file_info(root)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
        manifests = sorted(f.path for f in found if f.base_name.startswith(MANIFEST))
        files = []
        for path in manifests:
            with store.open_input_stream(path, compression=None) as f:
                files += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        if not manifests:
            files = sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))
        parts: list[list] = []
        room = 0
        for name, size in files:
            if not parts or room < size:
                parts.append([])
                room = PART_BYTES
            parts[-1].append(name)
            room -= size
        return [_Part(p) for p in parts] or [_Part([])]

    def _keeps(self, headers: dict[str, str]) -> bool:
        for column, values in self.wanted:
            value = headers.get(HEADERS[column])
            if value is not None and column == "payload_digest":
                value = value.removeprefix("sha1:")
            if value is None or (values and value not in values):
                return False
        return True

    def read(self, partition):
        import pyarrow as pa

        fields = [("warc_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])

        store, _ = _open(self.path)
        rows, held = [], 0
        for name in partition.files:
            with store.open_input_file(name) as file:
                size, at = file.size(), 0
                gzip = file.read(2) == b"\x1f\x8b"
                while at < size:
                    source = _Source(file, at, gzip, size)
                    head = source.until_blank()
                    while head is not None and not head.strip():  # empty lines between records
                        head = source.until_blank()
                    if head is None:
                        if gzip and source.inflate.eof and not source.held.strip():
                            at = source.next(0)  # a member without a record
                            continue
                        if not gzip and not source.held.strip():
                            break
                        raise ValueError(f"{name}, byte {at}: a record without end of headers")
                    headers = _headers(head.lstrip())
                    length = _number(headers.get("Content-Length"))
                    if length is None or "WARC-Type" not in headers:
                        raise ValueError(f"{name}, byte {at}: no record of a known length")
                    left = length
                    if self._keeps(headers):
                        row, left = self._row(headers, source, length, f"{name}, byte {at}")
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if len(rows) >= _BATCH or held >= _BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                    at = source.next(left)
        if rows:
            yield batch(rows)

    def _row(self, headers: dict[str, str], source: _Source, length: int, where: str) -> tuple[tuple, int]:
        """A record's row, and how many bytes of its block are unread."""
        http = headers.get("Content-Type", "").startswith("application/http")
        wanted = self.payload != "skip" and headers["WARC-Type"] != "revisit"
        stated, payload, left = None if http else length, None, length
        if wanted:
            payload, left = source.read(length), 0
            if len(payload) < length:
                raise ValueError(f"{where}: the record ends early")
            if http:
                top = re.search(rb"\r?\n\r?\n", payload)
                head, payload = (payload[: top.start()], payload[top.end() :]) if top else (payload, b"")
                stated = len(payload)
        elif http:
            head = b""
            while left and not re.search(rb"\r?\n\r?\n", head):
                piece = source.read(min(1024, left))
                if not piece:
                    break
                head, left = head + piece, left - len(piece)
            top = re.search(rb"\r?\n\r?\n", head)
            stated = _number(_headers(head[: top.start()] if top else head).get("Content-Length"))
            if stated is None and headers["WARC-Type"] != "revisit":
                stated = length - (top.end() if top else length)
        of = headers.get("WARC-Payload-Digest")
        kind, _, of = of.rpartition(":") if of else ("", "", None)
        if payload is not None:
            own = digest(payload)
            if of is None:
                of = own
            elif kind == "sha1" and len(of) == 32 and of.upper() != own:
                raise ValueError(f"{where}: the payload doesn't match its digest")
            if self.payload == "check":
                payload = None
        row = (headers["WARC-Type"], _number(headers.get("X-Page-ID")), _number(headers.get("X-Refers-To-Page-ID")), headers.get("WARC-Target-URI"), headers.get("WARC-Record-ID"), of, stated, payload)
        return row, left


class WarcSource(DataSource):
    """Format "warc". Options: path; payload = bytes (default), check (decode and compare with the digest, then drop) or skip."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


#: Rows of the table of revisits up to which it is broadcast.
BROADCAST_ROWS = 100_000


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: of rows with equal html of ``least`` bytes or more, the largest page_id; null in that row itself.

    A null html is an empty one. Rows that also share the largest page_id are
    all responses, as they are one page; null page_ids are less than any other.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha_", F.sha1("html"))
    narrow = pages.select("page_id", "sha_", F.octet_length("html").alias("size_"))
    groups = narrow.filter(F.col("size_") >= least).groupBy("sha_").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null").select("sha_", "top")
    # Texts meet only the few rows that refer to another, not the groups: a hot group isn't gathered.
    revisits = written(narrow.join(groups, "sha_").filter("page_id is null or page_id < top").select(F.col("page_id").alias("page_"), F.col("sha_").alias("of_"), F.col("top").alias("refers_to")).distinct(), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    joined = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("page_")) & (F.col("sha_") == F.col("of_")), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def archive(pages: DataFrame, path: str) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    pages.write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: str = "bytes") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def op7(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back: responses with their payloads decoded and compared, revisits by their headers."""
    path = shared_path(spark, "warc")
    archive(with_revisits(table(spark, sf_dir, "pages")), path)
    responses = read(spark, path, "check").filter("warc_type = 'response'")
    revisits = read(spark, path, "skip").filter("warc_type = 'revisit'")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
