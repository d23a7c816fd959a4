"""Sources: delimited and fixed-width files, deletion flags, multiplexed streams, order books, constants and random rows.

Every source declares its schema. Empty fields take the type's zero: 0, 0.0, false, 1900-01-01, and the empty string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StructType

from ..operators.ordered import running_sums

EMPTY_DATE = "1900-01-01"


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _zero(kind: DataType) -> Column:
    if isinstance(kind, DateType):
        return F.to_date(F.lit(EMPTY_DATE))
    if isinstance(kind, BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit("").cast(kind)


def fill_empty(df: DataFrame, schema: str | StructType) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f.name), _zero(f.dataType)).alias(f.name) if f.name in _schema(schema).names else F.col(f.name) for f in df.schema])


def read_delimited(spark: SparkSession, path: str | list[str], schema: str | StructType, delimiter: str = "|", deletions: bool = False, stream: bool = False, line_end: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Delimited text. With ``deletions`` a leading flag says which rows delete, and ``op`` is 1 or -1."""
    fields = _schema(schema)
    full = StructType.fromDDL("__del int") if deletions else StructType()
    full = StructType([*full.fields, *fields.fields])
    reader = (spark.readStream if stream else spark.read).schema(full).option("sep", delimiter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if line_end:
        reader = reader.option("lineSep", line_end)
    df = fill_empty(reader.csv(path), fields)
    return df.select(F.when(F.col("__del") == 0, 1).otherwise(-1).alias("op"), *fields.names) if deletions else df


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, str]]) -> DataFrame:
    """``fields``: name, width and type of each."""
    start, out = 1, []
    for name, width, kind in fields:
        out.append(F.trim(F.substring("value", start, width)).try_cast(kind).alias(name))
        start += width
    schema = StructType.fromDDL(", ".join(f"`{n}` {k}" for n, _, k in fields))
    return fill_empty(spark.read.text(path).select(*out), schema)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return fill_empty(spark.read.schema(_schema(schema)).json(path), schema)


def static_table(spark: SparkSession, path: str, schema: str | StructType, delimiter: str = "|") -> DataFrame:
    """A table that never changes; equal rows count once."""
    return read_delimited(spark, path, schema, delimiter).distinct()


def demultiplex(wide: DataFrame, relation: str, columns: dict[str, str], mux: str = "mux", event: str = "event") -> DataFrame:
    """One relation of a multiplexed stream: ``op`` (1 for event 1, else -1) and its own columns."""
    return wide.where(F.lower(F.col(mux)) == relation.lower()).select(F.when(F.col(event) == 1, 1).otherwise(-1).alias("op"), *[F.col(c).alias(n) for n, c in columns.items()])


def multiplex(relations: dict[str, DataFrame], order: dict[str, str], seed: int = 0, sentry: bool = False) -> DataFrame:
    """Relations interleaved at random in one wide frame, each in its own order; columns a relation lacks are null.

    ``order`` names each relation's column of distinct numbers. ``seq`` is a row's time of arrival: gaps between a relation's rows are drawn from one
    exponential distribution, so at each step every relation that is left is as likely to be next. A seed fixes the draw. With ``sentry`` a last row has
    that name, no event and no columns.
    """
    out = None
    for name, df in relations.items():
        key = order[name]
        unit = (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key)), F.lit(1 << 52)) + 1) / float(1 << 52)
        part = df if "event" in df.columns else df.withColumn("event", F.lit(1))
        part = running_sums(part.withColumn("__gap", -F.log(unit)), key, ["__gap"])
        part = part.withColumns({"mux": F.lit(name), "seq": F.col("before___gap") + F.col("__gap")}).drop("__gap", "before___gap")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if sentry:
        last = out.agg(F.coalesce(F.max("seq") + 1, F.lit(0.0)).alias("seq")).withColumn("mux", F.lit("sentry"))
        out = out.unionByName(last, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("seq", "mux", "event")]
    return out.select("seq", "mux", "event", *rest)


def order_book(messages: DataFrame, brokers: int = 10) -> tuple[DataFrame, DataFrame]:
    """Bids and asks as changes ``(op, t, id, broker_id, volume, price)`` from ``(t, id, action, volume, price)``.

    B and S place an order; D deletes what is left of it; E and F take their volume off it. The order keeps
    its price and side, found by id.
    """
    placed = messages.where(F.col("action").isin("B", "S")).select(F.col("id"), F.col("action").alias("side"), F.col("price").alias("at"), F.col("volume").alias("size"), F.col("t").alias("since"))
    taken = messages.where(F.col("action").isin("D", "E", "F"))
    broker = (F.col("id") % brokers).alias("broker_id")
    new = messages.where(F.col("action").isin("B", "S")).select(F.lit(1).alias("op"), "t", "id", broker, "volume", "price", F.col("action").alias("side"))
    known = taken.join(placed, "id")
    used = known.where("action <> 'D'").groupBy("id").agg(F.sum("volume").alias("used"))
    left = known.join(used, "id", "left").withColumn("left", F.when(F.col("action") == "D", F.col("size") - F.coalesce("used", F.lit(0.0))).otherwise(F.col("volume")))
    gone = left.where("left > 0").select(F.lit(-1).alias("op"), "t", "id", broker, F.col("left").alias("volume"), F.col("at").alias("price"), "side")
    both = new.unionByName(gone)
    return both.where("side = 'B'").drop("side"), both.where("side = 'S'").drop("side")


def constant(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), _schema(schema))


def random_rows(spark: SparkSession, n: int, schema: str | StructType, seed: int = 0) -> DataFrame:
    """``n`` rows of values of the declared types, the same for the same seed."""
    out = []
    for k, f in enumerate(_schema(schema)):
        h = F.xxhash64(F.lit(seed), F.lit(k), F.col("id"))
        unit = F.pmod(h, F.lit(1 << 53)) / float(1 << 53)
        kind = f.dataType.simpleString()
        value = unit if kind in ("double", "float") else (unit < 0.5) if kind == "boolean" else F.date_add(F.to_date(F.lit("2000-01-01")), (unit * 3650).cast("int")) if kind == "date" else F.pmod(h, F.lit(1 << 30)) if kind != "string" else F.hex(F.pmod(h, F.lit(1 << 30)))
        out.append(value.cast(f.dataType).alias(f.name))
    return spark.range(n).select(*out)


def in_sequence(*sources: DataFrame) -> DataFrame:
    """Sources one after another: ``source`` numbers them."""
    out = None
    for k, df in enumerate(sources):
        part = df.withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def repeated(source: DataFrame, times: int) -> DataFrame:
    """A source read over and over: ``round`` counts from 0."""
    return source.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else source.withColumn("round", F.lit(0)).limit(0)


def first_available(spark: SparkSession, *choices: DataFrame) -> DataFrame:
    """The first source that has rows, else the last."""
    for df in choices[:-1]:
        if not df.isEmpty():
            return df
    return choices[-1]


def write(df: DataFrame, path: str, kind: str = "csv", delimiter: str = "|", mode: str = "error") -> None:
    """A sink: csv, json or parquet."""
    w = df.write.mode(mode)
    if kind == "csv":
        w.option("sep", delimiter).csv(path)
    else:
        w.format(kind).save(path)
