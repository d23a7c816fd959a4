"""Running sums over an ordered key, in two steps and without one task for all keys.

Cut points taken from the key's quantiles deal the keys into ranges. Each range is summed, the few sums are added up in
order, and within a range a window runs over its own keys alone, from what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; the table of their sums is broadcast.
MOST_RANGES = 1000


def _range_of(df: DataFrame, key: str, ranges: int) -> Column:
    """The number of a key's range: how many cut points lie below it."""
    if ranges < 2:
        return F.lit(0)
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = sorted(set(df.agg(F.percentile_approx(key, shares, F.lit(100 * ranges)).alias("cuts")).first()["cuts"] or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(key)))


def running_sums(df: DataFrame, key: str, values: Sequence[str], descending: bool = False, group: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """All columns, and ``before_<v>`` for each value: its sum over the rows of strictly smaller keys (greater ones if descending), 0 if none.

    Keys are numbers and not null; rows of one key all get the same sums. With ``group`` sums run within each group.
    """
    ranges = ranges or min(MOST_RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = df.withColumn("__range", _range_of(df, key, ranges))
    by_key = placed.groupBy(*group, "__range", key).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    order = lambda c: F.desc(c) if descending else F.asc(c)
    earlier = Window.partitionBy(*group).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = by_key.groupBy(*group, "__range").agg(*[F.sum(f"__{v}").alias(f"__t_{v}") for v in values])
    totals = totals.select(*group, "__range", *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy(*group, "__range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, -1)
    sums = by_key.select(*group, "__range", key, *[F.coalesce(F.sum(f"__{v}").over(inside), F.lit(0)).alias(f"__i_{v}") for v in values])
    both = sums.join(totals if group else F.broadcast(totals), [*group, "__range"])
    before = both.select(*group, key, *[(F.col(f"__i_{v}") + F.col(f"__o_{v}")).alias(f"before_{v}") for v in values])
    return df.join(before, [*group, key]).select(*df.columns, *[f"before_{v}" for v in values])


def sums_before(points: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Each distinct key of ``points`` with the sum of ``value`` over the rows of ``values`` at smaller keys; no pair is made."""
    marked = values.select(key, value, F.lit(0).alias("__asked")).unionByName(points.select(key).distinct().select(key, F.lit(0).alias(value), F.lit(1).alias("__asked")))
    by_key = marked.groupBy(key).agg(F.sum(value).alias(value), F.max("__asked").alias("__asked"))
    return running_sums(by_key, key, [value]).where("__asked = 1").select(key, F.col(f"before_{value}").alias(value))
