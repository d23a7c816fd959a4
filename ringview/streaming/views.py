"""Maintained views: a log of changes by version, snapshots as of a version, compaction, and a streaming driver.

A view's state is a Parquet table of ``(vid, keys..., __v, __n)`` increments, one folder per version under the view's
path. A version is written to a folder of its own and replaces itself when a batch is replayed, so
``foreachBatch`` may call twice. A value at ``v`` is the sum of the increments up to ``v``: late changes need no
correction, whatever order they come in. ``__n`` counts rows, so a group whose sum is 0 is not taken for one that is gone.

Compaction writes the sum up to a version as ``upto=<vid>`` and only then deletes what it holds. A reader takes the
newest one that was written to its end (it has Spark's ``_SUCCESS``) and the increments after it, so a crash at any point loses and doubles
nothing. Batches read a relation's present rows and what came since, not its history, and shuffle of a large log only the rows at the keys that they join.
A stream writes a sum anew once as much came in since, so that all of its sums together are no more than twice what came in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.deltas import Expr, Relations
from ..operators.gmr import Gmr, Stored, V


@dataclass(frozen=True)
class ViewLog:
    """A view's increments under a path that all executors share."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def write(self, vid: int, increments: DataFrame) -> None:
        """Store a version; writing it again replaces it. One that was compacted can no longer change."""
        if (upto := self.compacted()) is not None and vid <= upto:
            raise ValueError(f"version {vid} was compacted")
        columns = [*self.keys, V, "__n"]
        summed = increments.groupBy(*self.keys).agg(F.sum(V).alias(V), F.sum("__n").alias("__n")).where(f"{V} <> 0 OR __n <> 0")
        summed.select(*columns).write.mode("overwrite").parquet(f"{self.path}/vid={vid}")

    def clear(self, vid: int) -> None:
        """A version without increments."""
        if (upto := self.compacted()) is not None and vid <= upto:
            raise ValueError(f"version {vid} was compacted")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/vid={vid}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _folders(self) -> tuple[object, list[tuple[str, int, object]]]:
        """The file system, and kind, version and path of each folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in ("vid", "upto") and number.lstrip("-").isdigit():
                found.append((kind, int(number), status.getPath()))
        return fs, found

    def compacted(self) -> int | None:
        """The version up to which increments are one sum."""
        fs, found = self._folders()
        done = [v for kind, v, path in found if kind == "upto" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
        return max(done, default=None)

    def sizes(self, vid: int | None = None) -> tuple[int, int]:
        """Bytes of the compacted sum, and of the increments after it up to a version."""
        upto, (fs, found) = self.compacted(), self._folders()
        size = lambda wanted: sum(fs.getContentSummary(path).getLength() for kind, v, path in found if wanted(kind, v))
        return size(lambda kind, v: (kind, v) == ("upto", upto)), size(lambda kind, v: kind == "vid" and (upto is None or v > upto) and (vid is None or v <= vid))

    def increments(self) -> DataFrame:
        """All increments by version; the compacted sum has the version it goes up to."""
        upto, (_, found) = self.compacted(), self._folders()
        parts = [] if upto is None else [self.spark.read.parquet(f"{self.path}/upto={upto}").withColumn("vid", F.lit(upto))]
        if live := [str(path) for kind, v, path in found if kind == "vid" and (upto is None or v > upto)]:
            parts.append(self.spark.read.option("basePath", self.path).parquet(*live))
        return reduce(DataFrame.unionByName, parts)

    def as_of(self, vid: int | None = None, strict: bool = False) -> DataFrame:
        """``(keys..., __v, __n)`` at a version, or before it; groups without rows are left out. Versions before the compacted one are gone."""
        upto = self.compacted()
        if vid is not None and upto is not None and vid - strict < upto:
            raise ValueError(f"versions before {upto} were compacted")
        log = self.increments()
        if vid is not None:
            log = log.where(F.col("vid") < vid if strict else F.col("vid") <= vid)
        return log.groupBy(*self.keys).agg(F.sum(V).alias(V), F.sum("__n").alias("__n")).where("__n <> 0")

    def compact(self, vid: int) -> None:
        """One sum for all versions up to ``vid``; snapshots from ``vid`` on stay the same."""
        if (done := self.compacted()) is None or done < vid:
            self.as_of(vid).write.mode("overwrite").parquet(f"{self.path}/upto={vid}")
        fs, found = self._folders()
        upto = self.compacted()
        for kind, v, path in found:
            if v <= upto and (kind, v) != ("upto", upto):
                fs.delete(path, True)


@dataclass(frozen=True)
class View:
    """A maintained view: ``value`` is summed by ``keys`` over the rows of ``rows``."""

    log: ViewLog
    rows: Expr
    value: Callable[[], object] | None = None

    def increments(self, g: Gmr) -> DataFrame:
        value = F.lit(1) if self.value is None else self.value()
        return g.df.select(*self.log.keys, (F.col(V) * value).alias(V), F.col(V).cast("long").alias("__n"))

    def bootstrap(self, env: Relations, vid: int = 0) -> None:
        """Evaluate the definition once over the relations as they stand."""
        self.log.write(vid, self.increments(self.rows.rows(env)))

    def apply(self, env: Relations, changes: Relations, vid: int) -> None:
        """Store the change that a batch makes; ``env`` is what stood before it."""
        d = self.rows.change(env, changes)
        if d is None:
            self.log.clear(vid)
        else:
            self.log.write(vid, self.increments(d))


def changes_of(batch: DataFrame, relation: str, columns: Sequence[str], name: str = "rel", op: str = "op") -> Gmr:
    """The rows of one relation in a batch of tagged changes; ``op`` is 1 to insert and -1 to delete."""
    return Gmr(batch.where(F.col(name) == relation).select(*columns, F.col(op).cast("long").alias(V)), tuple(columns))


@dataclass(frozen=True)
class Base:
    """Change logs of base relations, kept as views of themselves."""

    logs: dict[str, ViewLog]

    def relations(self, before: int) -> Relations:
        """The relations as they stood before a version."""
        out = {}
        for k, log in self.logs.items():
            increments = log.increments().where(F.col("vid") < before).select(*log.keys, V)
            out[k] = Stored(log.as_of(before, strict=True).select(*log.keys, V), log.keys, increments, sum(log.sizes(before - 1)))
        return out

    def write(self, changes: Relations, vid: int) -> None:
        for k, log in self.logs.items():
            if k in changes:
                log.write(vid, changes[k].df.select(*log.keys, V, F.col(V).alias("__n")))
            else:
                log.clear(vid)


def maintain(base: Base, views: dict[str, View], schemas: dict[str, Sequence[str]], batch: DataFrame, vid: int) -> None:
    """One batch: all views see the relations before it, then the relations take it in. Safe to repeat."""
    batch.persist()
    try:
        env = base.relations(vid)
        present = {r["rel"] for r in batch.select("rel").distinct().collect()}
        changes = {k: changes_of(batch, k, columns) for k, columns in schemas.items() if k in present}
        for view in views.values():
            view.apply(env, {k: g for k, g in changes.items() if k in view.rows.relations()}, vid)
        base.write(changes, vid)
    finally:
        batch.unpersist()


def stream(
    source: DataFrame, base: Base, views: dict[str, View], schemas: dict[str, Sequence[str]], checkpoint: str, first_vid: int = 1, compact_every: int | None = None
) -> StreamingQuery:
    """Drive the views from a stream of tagged changes until what is there now is used up.

    With ``compact_every``, base relations are looked at after so many versions, and those of which as much came in since the last sum as it holds
    are compacted up to the version before the last, which may yet be replayed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        vid = first_vid + batch_id
        maintain(base, views, schemas, batch, vid)
        if compact_every and batch_id and batch_id % compact_every == 0:
            for log in base.logs.values():
                held, since = log.sizes(vid - 1)
                if since >= held:
                    log.compact(vid - 1)

    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(base_path: str, spark: SparkSession, schemas: dict[str, Sequence[str]], initial: Relations | None = None) -> Base:
    """Empty or given base relations at version 0."""
    logs = {k: ViewLog(spark, f"{base_path}/{k}", tuple(c)) for k, c in schemas.items()}
    for k, log in logs.items():
        if initial and k in initial:
            log.write(0, initial[k].df.select(*log.keys, V, F.col(V).alias("__n")))
    return Base(logs)


def replace_slice(view: DataFrame, new: DataFrame, bound: Sequence[str]) -> DataFrame:
    """``:=``: rows of the view at the slices that ``new`` touches give way to ``new``; without bound keys all do."""
    return new if not bound else view.join(new.select(*bound).distinct(), list(bound), "left_anti").unionByName(new)


def runs(events: DataFrame, order: str, tag: Sequence[str], size: int | None = None, group: Sequence[str] = ()) -> DataFrame:
    """``batch``: events in order fall into batches that end where the tag changes or ``size`` is reached."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(order)
    same = F.lit(True)
    for t in tag:
        same = same & F.col(t).eqNullSafe(F.lag(t).over(w))
    marked = events.withColumn("__new", F.when(F.lag(order).over(w).isNull() | ~same, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w))
    if size is None:
        return marked.withColumn("batch", F.col("__run")).drop("__new", "__run")
    in_run = Window.partitionBy(*group, "__run").orderBy(order)
    cut = marked.withColumn("__part", F.floor((F.row_number().over(in_run) - 1) / size))
    by = Window.partitionBy(*group).orderBy("__run", "__part")
    return cut.withColumn("batch", F.dense_rank().over(by).cast("long")).drop("__new", "__run", "__part")
