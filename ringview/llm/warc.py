"""WARC archives as a Python data source, ``format("warc")``.

Writing puts one record per row into ``.warc`` files, or ``.warc.gz`` with the option ``compression`` set to ``gzip`` (a
member for each record); a task starts a new file at ``maxFileBytes``. The files of the attempts that counted are listed in ``_files.json``
with the places of records about ``splitBytes`` apart. Reading takes an archive written so, any other folder of ``.warc`` and ``.warc.gz`` files, or one file. It plans partitions
of about ``partitionBytes``: between listed places, else whole files, since a record's start is known only from the one before. It
takes predicates on the record type and on headers, reads each record's headers first, and steps over the
content of records that a predicate rejects or whose payload no column asks for.

Predicates come from ``filter()`` when ``spark.sql.python.filterPushdown.enabled`` is on (equality, ``in`` and
``startswith`` on ``record_type``, ``record_id``, ``target_uri``, ``payload_digest``, ``refers_to``), or from the option ``recordTypes``
(comma-separated). The option ``payload`` set to ``false`` leaves payloads unread.

Columns: ``record_type, record_id, target_uri, date, payload_digest, payload_length, refers_to, payload``. The payload of
a record of an HTTP message is its body, chunks joined, content coding left as it is; a message without a head is all body. The payload of any
other record is its whole block; a revisit has none, its digest and length are those of the payload it refers to. ``payload_length`` is what the archive's header says,
else the block's length where that is the payload, else null.

Defined results: an archive or record that ends early, or a record that does not begin with ``WARC/``, raises ``ValueError``; a header that is missing
is null; nulls in a row written leave their header out; a null type is written as ``resource``; a null payload is empty; control characters in headers are percent-encoded.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, filesystem, prepare, shared_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
_HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
_PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CHUNKED = re.compile(rb"^transfer-encoding:[^\r\n]*\bchunked\b", re.I | re.M)
_BATCH_BYTES = 4 << 20
_READ_BYTES = 1 << 14


def header_value(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict) -> bytes:
    """One WARC record: headers, then for a response an HTTP head and the payload, for a revisit nothing, else the payload."""
    type_, payload = row["record_type"] or "resource", row["payload"] or b""
    block, kind = payload, "application/octet-stream"
    if type_ in ("response", "revisit"):
        block, kind = b"", "application/http; msgtype=response"
    if type_ == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    row = row | {"record_type": type_}
    lines = ["WARC/1.1", *(f"{name}: {header_value(str(row[k]))}" for k, name in _HEADERS.items() if row.get(k) is not None)]
    if type_ == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, each with the places between which it may be split."""

    files: list[tuple[str, list[int]]]


@dataclass
class Ranges(InputPartition):
    """Parts of files: a path, where the part begins, and where it ends (None: the file's end)."""

    parts: list[tuple[str, int, int | None]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int, split_bytes: int, gzip: bool, job: str) -> None:
        self.path, self.max_bytes, self.split_bytes, self.gzip, self.job = path, max_bytes, split_bytes, gzip, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        fs, base = filesystem(self.path)
        fs.create_dir(base)
        files, out, size = [], None, 0
        for batch in iterator:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    if out is None or size >= self.max_bytes:
                        if out is not None:
                            out.close()
                        name = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc{'.gz' if self.gzip else ''}"
                        files.append((name, [0]))
                        out, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    if size - files[-1][1][-1] >= self.split_bytes:
                        files[-1][1].append(size)
                    data = record(row)
                    size += out.write(zlib.compress(data, 6, 31) if self.gzip else data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base)
        known = listed(self.path) or []
        with fs.open_output_stream(f"{base}/_files.json") as f:
            f.write(json.dumps(known + [x for m in messages if m for x in m.files]).encode())


def listed(path: str) -> list[tuple[str, list[int]]] | None:
    """The files that writes have committed and their places, if the folder has a list."""
    fs, base = filesystem(path)
    if not fs.get_file_info(f"{base}/_files.json").is_file:
        return None
    with fs.open_input_stream(f"{base}/_files.json") as f:
        return [(name, places) for name, places in json.loads(f.read())]


class _Bytes:
    """A part of a file as a stream with some look-ahead; gzip members follow each other as one stream."""

    def __init__(self, f: pa.NativeFile, start: int, end: int | None, gzip: bool) -> None:
        self.f, self.gzip, self.held, self.raw = f, gzip, b"", b""
        self.left = (f.size() if end is None else end) - start
        self.inflate = None
        if start:
            f.seek(start)

    def _file(self, n: int) -> bytes:
        data = self.f.read(min(n, self.left)) if self.left > 0 else b""
        self.left -= len(data)
        return data

    def more(self, n: int = _READ_BYTES) -> bool:
        """Read about ``n`` bytes more; false at the end."""
        if not self.gzip:
            data = self._file(n)
            self.held += data
            return bool(data)
        while True:
            if not self.raw:
                self.raw = self._file(_READ_BYTES)
            if not self.raw:
                if self.inflate is not None:
                    raise ValueError("the archive ends inside a compressed member")
                return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(self.raw, max(n, _READ_BYTES))
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None
            if data:
                self.held += data
                return True

    def headers(self) -> dict[str, str] | None:
        """The next record's headers by lower-case name; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if (end := self.held.find(b"\r\n\r\n")) >= 0:
                break
            if not self.more():
                if self.held:
                    raise ValueError(f"the archive ends inside a record's headers: {self.held[:40]!r}")
                return None
        lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
        self.held = self.held[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one is due: {lines[0][:40]!r}")
        out, name = {}, ""
        for x in lines[1:]:
            if x[:1] in (" ", "\t") and name:
                out[name] += " " + x.strip()
            else:
                name, _, value = x.partition(":")
                name = name.strip().lower()
                out[name] = value.strip()
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(n - have):
                raise ValueError(f"the archive ends {n - have} bytes before a record does")
            parts.append(self.held)
            have += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        """Step over content: in a plain file without reading it."""
        if n > len(self.held) and not self.gzip:
            ahead = n - len(self.held)
            if ahead > self.left:
                raise ValueError(f"the archive ends {ahead - self.left} bytes before a record does")
            self.f.seek(self.f.tell() + ahead)
            self.left -= ahead
            self.held = b""
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.more():
                raise ValueError(f"the archive ends {n} bytes before a record does")
        self.held = self.held[n:]


def joined_chunks(body: bytes) -> bytes:
    """The body of a chunked message; what does not follow the coding stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9a-fA-F]{1,15})[ \t]*(;.*)?", body[at:end], re.S) if end >= 0 else None
        if size is None or end + 2 + (n := int(size[1], 16)) > len(body):
            return body
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, the whole block of anything else."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    head = block.find(b"\r\n\r\n")
    if head < 0 or not re.match(rb"HTTP/|[A-Z]+ ", block):
        return block
    body = block[head + 4 :]
    return joined_chunks(body) if _CHUNKED.search(block[: head + 2]) else body


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.names = path, schema.names
        self.tests: list[tuple[str, str, object]] = []
        if types := options.get("recordtypes"):
            self.tests.append(("record_type", "in", tuple(x.strip() for x in types.split(","))))
        self.payload = options.get("payload", "true").lower() != "false" and "payload" in self.names
        self.group_bytes = int(options.get("partitionbytes", 32 << 20))
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what headers can decide; Spark applies the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in _PUSHED:
                yield f
            elif isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        fs, base = filesystem(self.path)
        known = listed(self.path)
        if known is not None:
            infos = fs.get_file_info([f"{base}/{name}" for name, _ in known])
            parts = [(i.path, a, b, (i.size if b is None else b) - a) for i, (_, places) in zip(infos, known, strict=True) for a, b in zip(places, [*places[1:], None], strict=True)]
        else:
            infos = [fs.get_file_info(base)] if fs.get_file_info(base).is_file else sorted(fs.get_file_info(FileSelector(base, recursive=True)), key=lambda x: x.path)
            parts = [(x.path, 0, None, x.size) for x in infos if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        groups, size = [[]], 0
        for path, a, b, n in parts:
            if size + n > self.group_bytes and groups[-1]:
                groups.append([])
                size = 0
            if groups[-1] and groups[-1][-1][0] == path:
                groups[-1][-1] = (path, groups[-1][-1][1], b)
            else:
                groups[-1].append((path, a, b))
            size += n
        return [Ranges(x) for x in groups]

    def wanted(self, row: dict) -> bool:
        for name, how, value in self.tests:
            x = row[name]
            if x is None or (x not in value if how == "in" else not x.startswith(value)):
                return False
        return True

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        types = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema])
        rows, size = [], 0
        for path, start, end in partition.parts:
            with fs.open_input_file(path) as f:
                stream = _Bytes(f, start, end, path.endswith(".gz"))
                while (headers := stream.headers()) is not None:
                    if not headers.get("content-length", "").isdigit():
                        raise ValueError(f"a record without a content length: {headers}")
                    length = int(headers["content-length"])
                    row = {k: headers.get(name.lower()) for k, name in _HEADERS.items()}
                    is_http = headers.get("content-type", "").lower().startswith("application/http")
                    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None if is_http or row["record_type"] == "revisit" else length
                    row["payload"] = None
                    keep = self.wanted(row)
                    if keep and self.payload and row["record_type"] != "revisit":
                        row["payload"] = payload_of(headers, stream.take(length))
                    else:
                        stream.skip(length)
                    if keep:
                        rows.append({k: row[k] for k in self.names})
                        size += len(row["payload"] or b"") + 256
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        get = self.options.get
        return WarcWriter(self.options["path"], int(get("maxfilebytes", 256 << 20)), int(get("splitbytes", 16 << 20)), get("compression", "") == "gzip", uuid.uuid4().hex[:12])


def archive_rows(pages: DataFrame, least: int = 100, broadcast_rows: int = 100_000) -> DataFrame:
    """The records of ``pages (page_id, url, html)``: equal payloads of at least ``least`` bytes are kept once.

    The smallest page id of a payload is its response, the others revisit it; rows that repeat that smallest
    id are responses too. A null id is the response only where no other page has the payload. Payloads that
    occur once need no partner, so only repeated digests are joined: as a broadcast up to ``broadcast_rows``
    digests, beyond it by page, with the payload itself never moving by digest.
    """
    rows = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    repeated = cut(
        rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first_id")).where("copies > 1").select("digest", "first_id"),
        "repeated-digests",
    )
    if repeated.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        revisits = rows.select("page_id", "digest").join(repeated, "digest").dropDuplicates(["page_id", "digest"])
        rows = rows.alias("a").join(revisits.alias("b"), F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")), "left").select("a.*", "b.first_id")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        "payload_length",
        F.when(revisit, record_id(F.col("first_id"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str | None = None, **kw: int) -> str:
    """Write the pages as WARC files under the shared folder; the folder comes back."""
    spark = pages.sparkSession
    prepare(spark)
    spark.dataSource.register(WarcSource)
    folder = path or shared_path(spark, "warc")
    archive_rows(pages, **kw).write.format("warc").mode("append").save(folder)
    return folder


def read_archive(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """The records under a path; ``columns`` names those to read, since Spark asks a Python source for all: without ``payload`` contents are stepped over."""
    prepare(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").options(**options)
    if columns is not None:
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)
