"""Shared helpers of the training-data operators: tables, the shared folder, row slices."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="ringview-")
    with zipfile.ZipFile(f"{folder}/{PACKAGE.name}.zip", "w") as z:
        for x in sorted(PACKAGE.rglob("*.py")):
            z.write(x, x.relative_to(PACKAGE.parent))
    context.addPyFile(f"{folder}/{PACKAGE.name}.zip")
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), f"ringview-{spark.sparkContext.applicationId}").as_uri()
    return f"{base.rstrip('/')}/ringview/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, for tasks that read or write the shared folder."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else Path(uri).absolute().as_uri())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that a task's memory follows a few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, _UPPER, _LOWER)
