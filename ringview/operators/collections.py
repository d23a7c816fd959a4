"""Collection operators over DataFrames: bags, sets, keyed maps, sequences, versioned maps and tagged logs.

A bag is a DataFrame. A set has distinct rows. A map has one row per key. A sequence or vector carries its position
in a column. A versioned map carries ``vid``, and a key's value at v is its latest at or before v. A tagged
log carries ``seq`` and ``tag``. State is never changed: each change gives a new DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _on(a: str, b: str, keys: Keys) -> Column:
    """Keys of two aliases are equal; nulls are equal to nulls."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


# Transformers


def map_rows(c: DataFrame, *exprs: Column | str, distinct: bool = False) -> DataFrame:
    """One row from each; sets stay sets."""
    out = c.select(*exprs)
    return out.distinct() if distinct else out


def filter_rows(c: DataFrame, condition: Column | str) -> DataFrame:
    return c.filter(condition)


def flatten(c: DataFrame, column: str) -> DataFrame:
    """One level: a row for each element of an array column."""
    return c.select(*[x for x in c.columns if x != column], F.explode(column).alias(column))


def fold(c: DataFrame, **aggregates: Column) -> DataFrame:
    """All rows to one; sums over nothing are 0."""
    return c.agg(*[F.coalesce(e, F.lit(0)).alias(k) for k, e in aggregates.items()])


def group_by(c: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    return c.groupBy(*keys).agg(*[e.alias(k) for k, e in aggregates.items()])


def fold_in_order(c: DataFrame, keys: Keys, order: str, value: str, zero: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A left fold over each key's values by ``order``, for steps that no aggregate expresses; a group's values must fit a row."""
    gathered = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__rows"))
    return gathered.select(*keys, F.aggregate("__rows", zero, lambda acc, x: step(acc, x[value])).alias(name))


def sort(c: DataFrame, *by: Column | str) -> DataFrame:
    return c.orderBy(*by)


def size(c: DataFrame) -> DataFrame:
    return c.agg(F.count("*").alias("size"))


def is_empty(c: DataFrame) -> bool:
    return c.isEmpty()


def equijoin(a: DataFrame, b: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    return a.join(b, list(keys), how)


def equijoin_fold(a: DataFrame, b: DataFrame, keys: Keys, **accumulators: Column) -> DataFrame:
    """All matches of an equi-join folded into accumulators; over nothing they are 0."""
    return fold(equijoin(a, b, keys), **accumulators)


def combine(a: DataFrame, b: DataFrame, kind: str = "bag", keys: Keys = ()) -> DataFrame:
    """Union by kind: bags add, sets unite, maps let the right side win."""
    if kind == "bag":
        return a.unionByName(b)
    if kind == "set":
        return a.unionByName(b).distinct()
    if kind == "map":
        left = a.alias("a").join(b.select(*keys).alias("b"), _on("a", "b", keys), "left_anti")
        return left.unionByName(b)
    raise ValueError(f"no kind {kind!r}")


def progression(spark, start: int, stride: int, steps: int, name: str = "value") -> DataFrame:
    return spark.range(steps).select((F.lit(start) + F.col("id") * stride).alias(name))


# Readers


def slice_of(c: DataFrame, **bound: object) -> DataFrame:
    """Rows whose fields equal the bound ones; fields not named are free."""
    out = c
    for k, v in bound.items():
        out = out.filter(F.col(k).eqNullSafe(F.lit(v)))
    return out


def nearest(c: DataFrame, key: str, value: object, side: str, group: Keys = ()) -> DataFrame:
    """The row whose key is nearest to a value: ``lt leq gt geq``; for each group if given. A pre-aggregating top-1, no sort."""
    test = {"lt": F.col(key) < value, "leq": F.col(key) <= value, "gt": F.col(key) > value, "geq": F.col(key) >= value}[side]
    best = F.max_by if side in ("lt", "leq") else F.min_by
    rest = [x for x in c.columns if x not in group]
    chosen = c.filter(test).groupBy(*group).agg(best(F.struct(*rest), F.col(key)).alias("__best"))
    return chosen.where("__best IS NOT NULL").select(*group, "__best.*")


def beyond(c: DataFrame, key: str, value: object, side: str) -> DataFrame:
    """All rows on one side of a key."""
    return c.filter({"lt": F.col(key) < value, "leq": F.col(key) <= value, "gt": F.col(key) > value, "geq": F.col(key) >= value}[side])


def peek(c: DataFrame) -> DataFrame:
    """Any one row; none of an empty collection."""
    return c.limit(1)


def peek_with_vid(c: DataFrame, vid: int | None = None) -> DataFrame:
    """The entry of least key of the newest version before ``vid`` (of all versions if none), with its version."""
    seen = c if vid is None else c.filter(F.col("vid") < vid)
    rest = [x for x in c.columns if x != "vid"]
    return seen.groupBy("vid").agg(F.min(F.struct(*rest)).alias("__e")).orderBy(F.desc("vid")).limit(1).select("vid", "__e.*").select(*c.columns)


def at(c: DataFrame, index: int, position: str = "pos", default: dict[str, object] | None = None) -> DataFrame:
    """The row at a position; a hole gives the default row if there is one."""
    found = c.filter(F.col(position) == index)
    if default is None:
        return found
    hole = c.sparkSession.range(1).select(F.lit(index).cast(c.schema[position].dataType).alias(position), *[F.lit(v).cast(c.schema[k].dataType).alias(k) for k, v in default.items()])
    return found.unionByName(hole.join(found.select(position), position, "left_anti"))


def min_entry(c: DataFrame, key: str, group: Keys = ()) -> DataFrame:
    rest = [x for x in c.columns if x not in group]
    return c.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("__m")).where("__m IS NOT NULL").select(*group, "__m.*")


def members(c: DataFrame, probe: DataFrame, keys: Keys) -> DataFrame:
    """The rows of ``probe`` that are in the collection."""
    return probe.alias("p").join(c.select(*keys).alias("c"), _on("p", "c", keys), "left_semi")


# Changes


def insert(c: DataFrame, rows: DataFrame, kind: str = "bag", keys: Keys = ()) -> DataFrame:
    return combine(c, rows, kind, keys)


def delete(c: DataFrame, rows: DataFrame) -> DataFrame:
    """One occurrence less for each row given; rows that are not there change nothing. Counts, so no row is sorted."""
    columns = c.columns
    counted = c.withColumn("__n", F.lit(1)).unionByName(rows.select(*columns).withColumn("__n", F.lit(-1)))
    left = counted.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n > 0")
    return left.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k")).drop("__k")


def update(c: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return delete(c, old).unionByName(new)


def set_all(c: DataFrame, **values: object) -> DataFrame:
    return c.withColumns({k: F.lit(v).cast(c.schema[k].dataType) for k, v in values.items()})


def upsert(c: DataFrame, changes: DataFrame, keys: Keys, value: str, missing: Column, present: Column) -> DataFrame:
    """Insert or update by key. ``missing`` and ``present`` are over ``old.<value>`` and ``new.<value>``."""
    in_old, in_new = F.col("old.__in").isNotNull(), F.col("new.__in").isNotNull()
    joined = c.withColumn("__in", F.lit(1)).alias("old").join(changes.withColumn("__in", F.lit(1)).alias("new"), _on("old", "new", keys), "full_outer")
    result = F.when(in_old & in_new, present).when(in_new, missing).otherwise(F.col(f"old.{value}"))
    return joined.select(*[F.when(in_old, F.col(f"old.{k}")).otherwise(F.col(f"new.{k}")).alias(k) for k in keys], result.alias(value))


def insert_at(c: DataFrame, changes: DataFrame, position: str = "pos", value: str = "value") -> DataFrame:
    """Vector write."""
    return upsert(c, changes, [position], value, F.col(f"new.{value}"), F.col(f"new.{value}"))


def update_at(c: DataFrame, index: int, change: Column, position: str = "pos", value: str = "value") -> DataFrame:
    """Read, change and write one slot."""
    return c.withColumn(value, F.when(F.col(position) == index, change).otherwise(F.col(value)))


def delete_at(c: DataFrame, index: int, default: object, position: str = "pos", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The value taken, and the vector with the default left behind."""
    return c.filter(F.col(position) == index), update_at(c, index, F.lit(default), position, value)


def delete_with(c: DataFrame, condition: Column, order: Column) -> tuple[DataFrame, DataFrame]:
    """The first match by ``order``, and the rest."""
    columns = c.columns
    first = c.filter(condition).orderBy(order).limit(1)
    return first, delete(c, first.select(*columns))


def pop(c: DataFrame, position: str = "pos") -> DataFrame:
    """Without its head."""
    head = c.agg(F.min(position).alias("__head"))
    return c.join(F.broadcast(head), F.col(position) > F.col("__head")).drop("__head")


def clear(c: DataFrame) -> DataFrame:
    return c.limit(0)


# Versioned maps


def as_of(c: DataFrame, keys: Keys, vid: int, strict: bool = True) -> DataFrame:
    """Each key's latest version before ``vid`` (or at it)."""
    test = F.col("vid") < vid if strict else F.col("vid") <= vid
    rest = [x for x in c.columns if x not in keys]
    return c.filter(test).groupBy(*keys).agg(F.max_by(F.struct(*rest), "vid").alias("__v")).select(*keys, "__v.*")


def fold_versions(c: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """Over all versions, not only the latest."""
    return c.groupBy(*keys).agg(*[e.alias(k) for k, e in aggregates.items()])


def upsert_before(c: DataFrame, changes: DataFrame, keys: Keys, vid: int, value: str, missing: Column, present: Column) -> DataFrame:
    """Write at ``vid`` what follows from each key's latest version before it; a version at ``vid`` is replaced."""
    changed = changes.select(*keys)
    before = as_of(c, keys, vid).drop("vid")
    before = before.alias("b").join(changed.alias("k"), _on("b", "k", keys), "left_semi")
    written = upsert(before, changes, keys, value, missing, present).withColumn("vid", F.lit(vid).cast(c.schema["vid"].dataType))
    kept = c.alias("c").join(changed.withColumn("vid", F.lit(vid).cast(c.schema["vid"].dataType)).alias("k"), _on("c", "k", [*keys, "vid"]), "left_anti")
    return kept.unionByName(written.select(*c.columns))


def update_suffix(c: DataFrame, condition: Column, vid: int, value: str, change: Column) -> DataFrame:
    """Change all versions after ``vid`` of the keys that a condition names."""
    return c.withColumn(value, F.when((F.col("vid") > vid) & condition, change).otherwise(F.col(value)))


def delete_prefix(c: DataFrame, keys: Keys, vid: int, condition: Column | None = None) -> DataFrame:
    """Drop versions at or before ``vid`` but each key's newest of them; of all keys, or those of a condition."""
    w = Window.partitionBy(*keys, F.col("vid") <= vid)
    old = (F.col("vid") <= vid) & (F.col("vid") < F.max("vid").over(w))
    if condition is not None:
        old = old & condition
    return c.withColumn("__old", old).filter(~F.col("__old")).drop("__old")


# Tagged logs


def log_append(c: DataFrame, rows: DataFrame, tag: str, unique: bool = False) -> DataFrame:
    """Append rows under a tag, numbered on from the log's end in order of their own ``seq``; the unique flavour skips what the tag already has."""
    fields = [x for x in c.columns if x not in ("seq", "tag")]
    new = rows.withColumn("tag", F.lit(tag))
    if unique:
        new = new.groupBy("tag", *fields).agg(F.min("seq").alias("seq")).alias("n").join(c.select("tag", *fields).alias("c"), _on("n", "c", ["tag", *fields]), "left_anti")
    end = c.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__end"))
    return c.unionByName(new.join(F.broadcast(end)).select((F.col("seq") + F.col("__end") + 1).alias("seq"), "tag", *fields))


def log_runs(c: DataFrame, group: Keys = ()) -> DataFrame:
    """``run``: consecutive rows of one tag share a number, within each group."""
    w = Window.partitionBy(*group).orderBy("seq")
    changed = F.coalesce((F.col("tag") != F.lag("tag").over(w)).cast("int"), F.lit(1))
    return c.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w)).drop("__c")


def log_fold(c: DataFrame, **aggregates: Column) -> DataFrame:
    return c.groupBy("tag").agg(*[e.alias(k) for k, e in aggregates.items()])
