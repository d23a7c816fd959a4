from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ringview.llm import warc

KINDS = {"string": StringType(), "long": LongType(), "binary": BinaryType()}
SCHEMA = StructType([StructField(n, KINDS[k]) for n, k in (x.split() for x in warc.SCHEMA.split(", "))])


def rec(kind, block, content_type=None, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
    lines += [f"Content-Type: {content_type}"] if content_type else []
    return "\r\n".join([*lines, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n4\r\nWiki\r\n6;x=y\r\npedia \r\nE\r\nin \r\n\r\nchunks.\r\n0\r\n\r\n"
RECORDS = [
    (rec("warcinfo", b"software: x\r\n", "application/warc-fields"), b"software: x\r\n", 13),
    (rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"), b"", None),
    (rec("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\nWARC/1.0\r\n\r\n", HTTP, WARC_Target_URI="http://x\r\n /folded"), b"<p>\r\n\r\nWARC/1.0\r\n\r\n", None),
    (rec("response", b"no head at all", HTTP), b"no head at all", None),
    (rec("response", CHUNKED, HTTP), b"Wikipedia in \r\n\r\nchunks.", None),
    (rec("response", CHUNKED[:-30], HTTP), CHUNKED[:-30].partition(b"\r\n\r\n")[2], None),
    (rec("resource", b"GIF89a\r\n\r\nxx", "image/gif"), b"GIF89a\r\n\r\nxx", 12),
    (rec("conversion", "é".encode() * 20000), "é".encode() * 20000, 40000),
    (rec("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", HTTP, WARC_Refers_To="<urn:y>"), None, None),
    (rec("metadata", b""), b"", 0),
]


def read(path, names=None, options=None, filters=()):
    schema = SCHEMA if names is None else StructType([SCHEMA[n] for n in names])
    reader = warc.WarcReader(str(path), schema, options or {})
    reader.tests += list(filters)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("kind", ["warc", "member", "one member"])
def test_archives_of_others(tmp_path, kind) -> None:
    parts = [x for x, _, _ in RECORDS]
    if kind == "warc":
        (tmp_path / "a.warc").write_bytes(b"".join(parts))
    else:
        (tmp_path / "sub").mkdir()
        (tmp_path / "sub/a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) if kind == "member" else gzip.compress(b"".join(parts)))
    (tmp_path / "b.txt").write_text("not an archive")
    got = read(tmp_path)
    assert [(r["payload"], r["payload_length"]) for r in got] == [(p, n) for _, p, n in RECORDS]
    assert got[2]["target_uri"] == "http://x /folded" and got[8]["refers_to"] == "<urn:y>"
    assert [r["record_type"] for r in read(next(tmp_path.rglob("a.warc*")), ["record_type"])] == [r["record_type"] for r in got]


@pytest.mark.parametrize("packed", [False, True])
def test_archives_that_end_early_raise(tmp_path, packed) -> None:
    whole = RECORDS[2][0] + RECORDS[7][0]
    for i, n in enumerate((10, 60, len(RECORDS[2][0]) - 12, len(RECORDS[2][0]) + 30, len(whole) - 100)):
        data = gzip.compress(whole)[: -(i + 1)] if packed else whole[:n]
        (tmp_path / f"{i}.warc{'.gz' if packed else ''}").write_bytes(data)
        for names in (None, ["record_type"]):
            with pytest.raises(ValueError, match="ends"):
                read(tmp_path / f"{i}.warc{'.gz' if packed else ''}", names)
    (tmp_path / "x.warc").write_bytes(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="no WARC record"):
        read(tmp_path / "x.warc")
    (tmp_path / "y.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")
    with pytest.raises(ValueError, match="content length"):
        read(tmp_path / "y.warc")


class Counted:
    """A file that counts the bytes read from it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def read(self, n):
        data = self.f.read(n)
        Counted.total += len(data)
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_payloads_that_nobody_wants_are_not_read(tmp_path, monkeypatch) -> None:
    big = [rec("response", b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(i).randbytes(1 << 20), HTTP, WARC_Target_URI=f"http://{i}") for i in range(8)]
    (tmp_path / "a.warc").write_bytes(b"".join(big))
    real = warc.filesystem

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            return Counted(self.fs.open_input_file(path))

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(warc, "filesystem", lambda uri: (Fs(real(uri)[0]), real(uri)[1]))
    assert len(read(tmp_path)) == 8 and Counted.total >= 8 << 20
    for kw, rows in (({"names": ["record_id"]}, 8), ({"options": {"payload": "false"}}, 8), ({"options": {"recordtypes": "revisit, request"}}, 0)):
        Counted.total = 0
        assert len(read(tmp_path, **kw)) == rows and Counted.total < 1 << 19
    Counted.total = 0
    assert len(read(tmp_path, filters=[("target_uri", "in", ("http://3",))])) == 1 and Counted.total < 2 << 20


def test_filters_are_pushed(spark, tmp_path) -> None:
    (tmp_path / "a.warc").write_bytes(b"".join(x for x, _, _ in RECORDS))
    wanted = "record_type = 'response' AND target_uri LIKE 'http://%'"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = warc.read_archive(spark, str(tmp_path)).where(wanted)
    assert df.count() == 1
    assert "= response" in df._jdf.queryExecution().analyzed().toString()
    assert "= response" not in plan(df) and "StartsWith" not in plan(df)
    few = warc.read_archive(spark, str(tmp_path), columns=["record_id", "payload_length"])
    assert few.columns == ["record_id", "payload_length"] and few.count() == len(RECORDS)


@pytest.mark.parametrize("compression", ["", "gzip"])
def test_files_are_split_between_records(spark, tmp_path, compression) -> None:
    spark.dataSource.register(warc.WarcSource)
    rows = [("resource" if i % 3 else "response", f"<urn:{i}>", random.Random(i).randbytes(i * 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, payload binary").coalesce(1)
    full = df.selectExpr("record_type", "record_id", "null AS target_uri", "null AS date", "null AS payload_digest", "null AS payload_length", "null AS refers_to", "payload")
    full.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMA]).write.format("warc").options(splitBytes=5000, compression=compression).mode("append").save(f"{tmp_path}/a")
    reader = warc.WarcReader(f"{tmp_path}/a", SCHEMA, {"partitionbytes": "20000"})
    parts = reader.partitions()
    assert len(parts) > 5 and len(list((tmp_path / "a").glob("*.warc*"))) == 1
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_type"], r["record_id"], r["payload"]) for r in got] == rows
    assert warc.read_archive(spark, f"{tmp_path}/a", partitionBytes="20000").count() == 300
