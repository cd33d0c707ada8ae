"""WARC archives as a Spark data source (format ``warc``).

Writing: each task writes records, one gzip member each, to files of its own under a temporary name;
the commit renames those of the successful attempts, so a lost executor leaves no half file behind.

Equal payloads are found by their SHA-1 in rows without payloads; what refers to another page is joined with the
pages by id, so a payload that many pages have is no key that payloads are dealt by.

Reading: files are planned into partitions of about MAX_PARTITION bytes; a file is never split, and none is written
beyond that size.  Predicates on headers (record
type, page id, URL, digest, length, reference) are pushed down.  Of each record the headers are read
first: a gzip member written here carries its length in the gzip extra field, so the reader inflates only
the beginning, tests the predicates, and seeks over the payload unless a wanted column needs it.  Other
WARC files, compressed or not, are read as well; without that field a member is inflated to find its end.

Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to from headers, and payload
where the schema asks for it or where option verify is true (then length and digest of every payload that
is read are compared with the headers, and a difference is an error).

Defined results: a null payload is empty; null page ids and URLs have no header and come back null; rows
with one page id and equal payloads are all responses; an empty table makes no file; extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

from ..ship import ship
from .common import counted, scratch

#: Bytes of the files of a partition; a task that writes begins a new file beyond MAX_FILE.
MAX_PARTITION, MAX_FILE = 64 << 20, 60 << 20
#: References that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_ID = "urn:x-page:"
_CHUNK = 1 << 20


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response of another page."""
    digest, revisit = digest_of(payload), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", f"<{_ID}{refers_to}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member whose extra field WL holds the member's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    extra = b"WL" + struct.pack("<HQ", 8, size)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _length(head: bytes) -> int | None:
    """Length of a gzip member from its extra field WL."""
    if len(head) >= 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"WL":
        return struct.unpack("<Q", head[16:24])[0]
    return None


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    value = (value or "").strip("<>")
    return int(value[len(_ID) :]) if value.startswith(_ID) else None


def _row(fields: dict[str, str], http: dict[str, str]) -> dict[str, object]:
    size = http.get("content-length")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "payload_bytes": int(size) if size and size.isdigit() else None,
        "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None,
        "refers_to": _page(fields.get("warc-refers-to")),
    }


class _Need(Exception):
    """More of the record has to be inflated before its headers end."""


def _heads(data: bytes) -> tuple[dict[str, str], dict[str, str], int, int]:
    """WARC fields, HTTP fields, where the payload begins and where the record's block ends."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise _Need
    fields = _fields(data[:end])
    begin, size = end + 4, int(fields.get("content-length", 0))
    http: dict[str, str] = {}
    if fields.get("content-type", "").startswith("application/http"):
        stop = data.find(b"\r\n\r\n", begin)
        if stop < 0 and len(data) < begin + size:
            raise _Need
        if 0 <= stop < begin + size:
            http = _fields(data[begin:stop])
            return fields, http, stop + 4, begin + size
    return fields, http, begin, begin + size


def read_records(file, wanted: Callable[[dict], bool], payload: Callable[[dict], bool]) -> Iterator[tuple[dict, bytes | None]]:
    """Rows of the wanted records of an open file, with their payloads where payload(row) is true."""
    at, total = 0, file.size()
    buffer, base = b"", 0

    def bytes_at(begin: int, n: int) -> bytes:
        nonlocal buffer, base
        if begin < base or begin + n > base + len(buffer):
            file.seek(begin)
            buffer, base = file.read(max(n, _CHUNK)), begin
        return buffer[begin - base : begin - base + n]

    while at < total:
        first = bytes_at(at, 24)
        if first[:2] in (b"\r\n", b"\n\n"):
            at += 2
            continue
        packed = first[:2] == b"\x1f\x8b"
        size = _length(first) if packed else None
        inflate, data, taken = zlib.decompressobj(31), b"", 0
        step = 1024
        while True:  # inflate until the headers end
            if packed:
                part = bytes_at(at + taken, min(step, (size or total - at) - taken))
                data += inflate.decompress(part)
                taken += len(part)
            else:
                data = bytes_at(at, min(step, total - at))
                taken = len(data)
            try:
                fields, http, begin, end = _heads(data)
                break
            except _Need:
                if taken >= (size or total - at) or inflate.eof:
                    raise ValueError(f"no WARC record at byte {at}") from None
                step *= 4
        row = _row(fields, http)
        take = wanted(row)
        full = take and payload(row)
        if packed and (full or size is None):
            while not inflate.eof and taken < total - at:
                part = bytes_at(at + taken, min(_CHUNK, (size or total - at) - taken))
                if not part:
                    break
                data += inflate.decompress(part)
                taken += len(part)
            at += size or taken - len(inflate.unused_data)
        elif packed:
            at += size
        else:
            data = bytes_at(at, end) if full else data
            at += end
        if take:
            yield row, data[begin:end] if full else None


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """A predicate on a header as a function of a row, or None where it isn't one."""
    if isinstance(f, Not) and isinstance(f.child, (EqualTo, In, StringStartsWith)):
        test, c = _test(f.child), getattr(f.child, "attribute", ())
        return None if test is None else lambda r: r[c[0]] is not None and not test(r)
    path = getattr(f, "attribute", ())
    if len(path) != 1 or path[0] not in {x.split()[0] for x in HEADERS.split(", ")}:
        return None
    c, value = path[0], getattr(f, "value", None)
    tests = {
        EqualTo: lambda r: r[c] is not None and r[c] == value,
        EqualNullSafe: lambda r: r[c] == value,
        In: lambda r: r[c] is not None and r[c] in value,
        IsNull: lambda r: r[c] is None,
        IsNotNull: lambda r: r[c] is not None,
        GreaterThan: lambda r: r[c] is not None and r[c] > value,
        GreaterThanOrEqual: lambda r: r[c] is not None and r[c] >= value,
        LessThan: lambda r: r[c] is not None and r[c] < value,
        LessThanOrEqual: lambda r: r[c] is not None and r[c] <= value,
        StringStartsWith: lambda r: r[c] is not None and r[c].startswith(value),
    }
    return tests.get(type(f))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.value = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], schema: pa.Schema, verify: bool):
        self.path, self.names, self.schema, self.verify = path, names, schema, verify
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.size)
        parts, held = [], 0
        for name, size in files:
            if not parts or held + size > MAX_PARTITION:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        tests = [_test(f) for f in self.filters]
        asks = "payload" in self.names
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_pylist([{n: r[n] for n in self.names} for r in rows], schema=self.schema)

        for name in partition.value:
            with store.open_input_file(name) as file:
                for row, payload in read_records(file, lambda r: all(t(r) for t in tests), lambda r: asks or self.verify and r["record_type"] == "response"):
                    if self.verify and payload is not None and row["record_type"] == "response":
                        seen = len(payload), digest_of(payload)
                        if seen != (row["payload_bytes"], row["payload_digest"]):
                            raise ValueError(f"{name}: payload of page {row['page_id']} is {seen}, its headers say {row['payload_bytes'], row['payload_digest']}")
                    row["payload"] = payload if asks else None
                    rows.append(row)
                    held += len(payload or b"") if asks else 100
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class _Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.overwrite, self.level = path, overwrite, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        part, files, out = TaskContext.get().partitionId(), [], None
        try:
            for b in iterator:
                for page_id, url, payload, refers_to in zip(*(b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "refers_to"))):
                    if out is None or out.tell() > MAX_FILE:
                        if out is not None:
                            out.close()
                        name = f"part-{part:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz"
                        files.append((f"{path}/_{name}", f"{path}/{name}"))
                        out = store.open_output_stream(files[-1][0], compression=None)
                    out.write(member(record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()), self.level))
        finally:
            if out is not None:
                out.close()
        return _Wrote(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.path)
        if self.overwrite:
            for f in store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
                if f.is_file and not f.base_name.startswith("_"):
                    store.delete_file(f.path)
        for m in messages:
            for temporary, name in m.files if m else []:
                store.move(temporary, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for temporary, _ in m.files if m else []:
                store.delete_file(temporary)


class WarcDataSource(DataSource):
    """Options: path; verify (true or false); level (of compression, 0 to 9)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return HEADERS + ", payload binary"

    def reader(self, schema) -> DataSourceReader:
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]
        return WarcReader(self.options["path"], [n for n, _ in fields], pa.schema(fields), self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", "4")))


def register(spark: SparkSession) -> None:
    """Make the format known, here and to executors, and let filters reach Python data sources."""
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: the smallest page id of an equal payload, null for that page itself and for smaller payloads."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    slim = rows.where(F.octet_length("payload") >= least_bytes).select(F.col("page_id").alias("_page"), F.sha1("payload").alias("_sha1"))
    first = slim.groupBy("_sha1").agg(F.min("_page").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies, n = counted(slim.where("_page is not null").distinct().join(first, "_sha1").where("_page != _first"), "copies")
    copies = F.broadcast(copies) if n <= BROADCAST_IDS else copies.hint("merge")
    same = (F.col("page_id") == F.col("_page")) & (F.sha1("payload") == F.col("_sha1"))
    return rows.join(copies, same, "left").select("page_id", "url", "payload", F.col("_first").alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """WARC records of pages (page_id, url, html) under path."""
    register(pages.sparkSession)
    with_references(pages, least_bytes).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = False, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(HEADERS + ", payload binary" * payload).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """op8's result: archives of all pages, written to the shared folder and read back by record type.

    Payloads of responses are decoded and checked; those of other records are skipped, by a predicate that the source is given.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    full = read(spark, path, verify=True).where("record_type = 'response'")
    heads = read(spark, path).where("record_type != 'response'")
    return full.unionByName(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
