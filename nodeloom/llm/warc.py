"""WARC as a PySpark data source, and page archives with revisit records.

Reading: the files of a folder are planned into partitions by size; predicates on record type,
record id, target URI and date are pushed down and tested on the headers, which are
parsed first; a payload that is not wanted (filtered record, or option ``payload`` = false) is
not decoded.  ``records`` hands predicates over as an option of the load.  Spark's own filter pushdown is
served too (option ``pushdown`` = true, and the session's spark.sql.python.filterPushdown.enabled), but Spark 4.1 keeps the
filters that it pushed last for a loaded frame: with it, use each frame that ``load`` gives in one query only, or another query's
filters apply.  Each gzip member carries its lengths in the 'sl' extra field, so skipping it is
a seek; foreign archives without that field, with many records in a member or with empty members, and
plain ``.warc`` files, are read too.  Names of headers have no case.  Folders are read with their subfolders.
One task reads a file as a stream from its start (gzip can't be entered elsewhere), so files should stay at a few GB; the
writer makes one of each task.  Only a record that is read is held whole.

Writing: each task writes one file, one gzip member a record, under a name of its own;
the driver moves the files of the tasks that committed into the folder.

Paths are opened with ``pyarrow.fs``, so any store it knows works.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from nodeloom.llm.storage import checkpointed, fresh_path

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_length bigint, headers map<string,string>, http_headers string, payload binary"
#: Header of each column that predicates are pushed down for.
HEADER_OF = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date"}
CHUNK = 1 << 16
EPOCH = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI (Hadoop's ``file:/x`` included) or absolute path."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def header_block(warc_type: str, headers: dict[str, str], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {warc_type}", *(f"{k}: {clean(v)}" for k, v in headers.items()), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member whose 'sl' extra field holds its compressed and plain lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class PlainBytes:
    """Plain bytes of one file, its gzip members (if it has any) one after another, with a cheap way past what isn't wanted."""

    def __init__(self, file, size: int):
        self.file, self.size, self.raw, self.buffer = file, size, 0, b""
        file.seek(0)
        self.zipped = file.read(2) == b"\x1f\x8b"
        self.inflate, self.start, self.told, self.made = None, 0, None, 0

    def fill(self) -> bool:
        """Add plain bytes to the buffer; false at the file's end."""
        if not self.zipped:
            self.file.seek(self.raw)
            data = self.file.read(CHUNK)
            self.raw += len(data)
            self.buffer += data
            return bool(data)
        while True:
            if self.inflate is None or self.inflate.eof:
                if self.inflate is not None:
                    self.raw -= len(self.inflate.unused_data)
                self.file.seek(self.raw)
                head = self.file.read(24)
                if not head.strip(b"\0"):
                    return False
                is_told = head[3:4] == b"\x04" and head[12:14] == b"sl" and head[10:12] == b"\x0c\x00"
                self.start, self.made, self.told = self.raw, 0, struct.unpack("<II", head[16:24]) if is_told else None
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.unconsumed_tail
            if not data:
                self.file.seek(self.raw)
                data = self.file.read(CHUNK)
                self.raw += len(data)
            if not data:
                raise ValueError(f"a gzip member is cut off: it starts at byte {self.start}")
            plain = self.inflate.decompress(data, CHUNK)
            self.made += len(plain)
            if plain:
                self.buffer += plain
                return True

    def header(self) -> bytes | None:
        """The next record's header lines; None at the end."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            cut = self.buffer.find(b"\r\n\r\n")
            if cut >= 0:
                head, self.buffer = self.buffer[:cut], self.buffer[cut + 4 :]
                return head
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError(f"no end of the WARC headers before byte {self.raw}")
                return None

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.buffer and not self.fill():
                raise ValueError(f"a record is cut off at byte {self.raw}")
            parts.append(self.buffer[:n])
            self.buffer = self.buffer[n:]
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes; a seek in plain files, and to the end of a member that tells its lengths."""
        while True:
            passed = min(n, len(self.buffer))
            self.buffer = self.buffer[passed:]
            n -= passed
            if not n:
                return
            if not self.zipped:
                if self.raw + n > self.size:
                    raise ValueError(f"a record is cut off at byte {self.size}")
                self.raw += n
                return
            if self.inflate is not None and self.told and n >= self.told[1] - self.made > 0:
                n -= self.told[1] - self.made
                self.raw, self.inflate = self.start + self.told[0], None
            elif not self.fill():
                raise ValueError(f"a record is cut off at byte {self.raw}")

    def records(self) -> Iterator[Record]:
        while (head := self.header()) is not None:
            record = Record(self, head)
            yield record
            self.skip(record.left)


class Record:
    """A record at its file's place: headers first, the block on demand."""

    def __init__(self, source: PlainBytes, head: bytes):
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record before byte {source.raw}")
        self.source = source
        self.headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        #: By lower-case name: names of headers have no case.
        self.named = {k.lower(): v for k, v in self.headers.items()}
        self.content_length = self.left = int(self.named.get("content-length", 0))

    def block(self) -> bytes:
        n, self.left = self.left, 0
        return self.source.take(n)


def test_of(filter: Filter):
    """(header, test of its value) for a filter that the headers decide; None for others."""
    if len(getattr(filter, "attribute", ())) != 1 or filter.attribute[0] not in HEADER_OF:
        return None
    header = HEADER_OF[filter.attribute[0]]
    tests = {
        EqualTo: lambda v: v == filter.value,
        In: lambda v: v in filter.value,
        IsNotNull: lambda v: True,
        StringStartsWith: lambda v: v.startswith(filter.value),
        StringEndsWith: lambda v: v.endswith(filter.value),
        StringContains: lambda v: filter.value in v,
    }
    if type(filter) not in tests or (type(filter) in (EqualTo, In) and filter.value is None):
        return None
    return header, tests[type(filter)]


def header_tests(column: str, wanted: str | list[str] | dict[str, str]) -> list:
    """(header, test) pairs of an option: a value, a list of values, or ``startsWith``, ``endsWith`` and ``contains``."""
    header = HEADER_OF[column]
    if not isinstance(wanted, dict):
        values = {wanted} if isinstance(wanted, str) else set(wanted)
        return [(header, lambda v: v in values)]
    tests = {"startsWith": lambda x: lambda v: v.startswith(x), "endsWith": lambda x: lambda v: v.endswith(x), "contains": lambda x: lambda v: x in v}
    return [(header, tests[kind](x)) for kind, x in wanted.items()]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", 32 << 20))
        self.headers = json.loads(options.get("headers", "{}"))
        self.filters: list[Filter] = []

    def partitions(self) -> list[Files]:
        fs, root = opened(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        found = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path) and "/_uncommitted-" not in i.path)
        plans, size = [[]], 0
        for path, n in found:
            if plans[-1] and size + n > self.partition_bytes:
                plans.append([])
                size = 0
            plans[-1].append((path, n))
            size += n
        return [Files(p) for p in plans]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [test_of(f) for f in self.filters] + [t for column, wanted in self.headers.items() for t in header_tests(column, wanted)]
        fs, _ = opened(self.path)
        rows, size = [], 0
        for path, n in partition.paths:
            with fs.open_input_file(path) as file:
                for record in PlainBytes(file, n).records():
                    h = record.named
                    if not all(name in h and test(h[name]) for name, test in tests):
                        continue
                    http = payload = None
                    if self.payload:
                        block = record.block()
                        is_http = h.get("content-type", "").startswith("application/http")
                        head, _, payload = block.partition(b"\r\n\r\n") if is_http else (None, b"", block)
                        http = head.decode("utf-8", "replace") if head is not None else None
                        size += len(block)
                    rows.append((*(h.get(name) for name in HEADER_OF.values()), record.content_length, list(record.headers.items()), http, payload))
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield record_batch(rows)
                        rows, size = [], 0
        if rows:
            yield record_batch(rows)


class PushingWarcReader(WarcReader):
    def pushFilters(self, filters):
        for f in filters:
            if test_of(f):
                self.filters.append(f)
            else:
                yield f


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows of (warc_type, record_id, target_uri, warc_date, headers, http_headers, payload)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 3)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        name = f"records-{self.job[:8]}-{TaskContext.get().partitionId():05d}.warc.gz"
        folder = f"{root}/_uncommitted-{self.job}"
        temporary = f"{folder}/{uuid.uuid4().hex}-{name}"
        fs.create_dir(folder, recursive=True)
        count = 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip_member(self.record(row), self.level))
                    count += 1
        if not count:
            fs.delete_file(temporary)
        return Written(temporary, name) if count else Written(None, None)

    def record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        http = row.get("http_headers")
        block = http.encode() + b"\r\n\r\n" + payload if http is not None else payload
        headers = {"WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"] or EPOCH}
        if row["target_uri"] is not None:
            headers["WARC-Target-URI"] = row["target_uri"]
        if http is not None:
            headers["Content-Type"] = "application/http; msgtype=response"
        headers |= {k: v for k, v in row["headers"] or () if v is not None}
        return header_block(row["warc_type"], headers, len(block)) + block + b"\r\n\r\n"

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.type == pafs.FileType.File:
                    fs.delete_file(i.path)
        for m in messages:
            if m and m.name:
                fs.move(m.temporary, f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/_uncommitted-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_uncommitted-{self.job}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options: payload, headers (JSON), pushdown, partitionBytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingWarcReader if options.get("pushdown") == "true" else WarcReader)(options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(WarcDataSource)


def records(spark: SparkSession, path: str, payload: bool = True, **headers) -> DataFrame:
    """Records of the archives at ``path`` whose headers pass: a value, a list of values, or a dict of
    ``startsWith``, ``endsWith``, ``contains`` for any of ``warc_type``, ``record_id``, ``target_uri``, ``warc_date``.

    A record without a tested header doesn't pass.
    """
    if unknown := set(headers) - set(HEADER_OF):
        raise ValueError(f"no header predicates on {sorted(unknown)}")
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("headers", json.dumps(headers)).load()


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100) -> None:
    """A record for each row: of rows with equal payloads of at least ``least_bytes`` the least key is the response, the others revisit it.

    A null html is an empty payload; a null url is left out.  A row with a null key is a
    revisit if a row with a key has its payload, else a response; rows that repeat
    the least key are all responses.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # Digests only are shuffled to find copies; the pages meet the decisions by row, not by payload.
    small = rows.where(F.col("bytes") >= least_bytes).select("key", "digest")
    first = small.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # A table of its own, so that the join is between plain exchanges and Spark can split a hot payload.
    again = small.join(checkpointed(first), "digest").where(~F.col("key").eqNullSafe(F.col("first"))).select(F.xxhash64("key", "digest").alias("row"), "digest", "first").distinct()
    told = rows.withColumn("row", F.xxhash64("key", "digest")).join(checkpointed(again), ["row", "digest"], "left")
    is_again = F.col("first").isNotNull()
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(">"))
    headers = F.map_from_arrays(
        F.array(*map(F.lit, ("WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Refers-To", "WARC-Profile"))),
        F.array(
            F.concat(F.lit("sha256:"), "digest"),
            F.col("bytes").cast("string"),
            F.when(is_again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
            F.when(is_again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"))
    told.select(
        F.when(is_again, F.lit("revisit")).otherwise(F.lit("response")).alias("warc_type"),
        record_id.alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("warc_date"),
        headers.alias("headers"),
        http.alias("http_headers"),
        F.when(~is_again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records of an archive: ``page_id``, ``record_type``, ``refers_to``, ``payload`` (null for revisits), ``told_bytes`` and ``told_digest`` from the headers.

    Page ids that aren't integers read as null (their record ids are in the ``warc`` source's ``record_id``).
    """
    found = records(spark, path, warc_type=["response", "revisit"])
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")
    return found.select(
        page("record_id").alias("page_id"),
        F.col("warc_type").alias("record_type"),
        page("headers['WARC-Refers-To']").alias("refers_to"),
        F.when(F.col("warc_type") == "response", F.col("payload")).alias("payload"),
        F.col("headers")["WARC-Payload-Length"].cast("long").alias("told_bytes"),
        F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1).alias("told_digest"),
    )


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Pages written to a fresh archive in the shared folder and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_pages(pages, path, **options)
    return read_pages(pages.sparkSession, path)
