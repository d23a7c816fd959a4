"""Relations whose rows carry a ring value: multiplicities that filters, joins, sums and negation act on.

A ``Gmr`` wraps a DataFrame of variables and a value column. Joins multiply values, unions add them when a sum
merges keys, deletions are negative. A comparison is a real filter, so rows it rejects are gone. What is absent counts
as zero, never as null. All operations are lazy DataFrame plans; nothing runs Python on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = "__v"
#: From so many bytes on, a log's rows are picked before they are shuffled, by a bitmap of so many bits of the keys asked for.
LARGE_LOG, KEY_BITS = 32 << 20, 1 << 26


@dataclass(frozen=True)
class Gmr:
    """``df`` has the columns ``vars`` and the value ``__v``."""

    df: DataFrame
    vars: tuple[str, ...]

    @classmethod
    def scan(cls, df: DataFrame, mapping: dict[str, str] | Sequence[tuple[str, str]], value: Column | None = None) -> Gmr:
        """``mapping``: column to variable, as pairs if a column repeats; a variable that repeats makes its columns equal."""
        pairs = list(mapping.items() if isinstance(mapping, dict) else mapping)
        first: dict[str, str] = {}
        condition = None
        for column, var in pairs:
            if var in first:
                same = F.col(column) == F.col(first[var])
                condition = same if condition is None else condition & same
            else:
                first[var] = column
        rows = df if condition is None else df.where(condition)
        return cls(rows.select(*[F.col(c).alias(v) for v, c in first.items()], (F.lit(1) if value is None else value).alias(V)), tuple(first))

    def join(self, other: Gmr) -> Gmr:
        """The product: a natural join on shared variables, a cross product where there are none (scalars, or as asked)."""
        shared = [v for v in self.vars if v in other.vars]
        left, right = self.df, other.df.withColumnRenamed(V, "__w")
        both = left.join(right, shared) if shared else left.crossJoin(right)
        out = self.vars + tuple(v for v in other.vars if v not in shared)
        return Gmr(both.select(*out, (F.col(V) * F.col("__w")).alias(V)), out)

    __mul__ = join

    def where(self, condition: Column | str) -> Gmr:
        """A comparison: rows for which it holds."""
        return Gmr(self.df.where(condition), self.vars)

    def times(self, value: Column) -> Gmr:
        """Multiply values by an expression over the variables."""
        return Gmr(self.df.withColumn(V, F.col(V) * value), self.vars)

    def __add__(self, other: Gmr) -> Gmr:
        """Union; keys that occur on both sides stay apart until a sum merges them."""
        if set(self.vars) != set(other.vars):
            raise ValueError(f"a sum needs the same variables: {self.vars} and {other.vars}")
        return Gmr(self.df.select(*self.vars, V).union(other.df.select(*self.vars, V)), self.vars)

    def __neg__(self) -> Gmr:
        return Gmr(self.df.withColumn(V, -F.col(V)), self.vars)

    def __sub__(self, other: Gmr) -> Gmr:
        return self + -other

    def sum(self, by: Sequence[str] = ()) -> Gmr:
        """Group-by sum. Without keys it is one row, 0 over nothing."""
        if by:
            return Gmr(self.df.groupBy(*by).agg(F.sum(V).alias(V)), tuple(by))
        return Gmr(self.df.agg(F.coalesce(F.sum(V), F.lit(0)).alias(V)), ())

    def settled(self, by: Sequence[str]) -> Gmr:
        """A group-by sum without the groups that add up to 0; for floats, to less than rounding leaves of their terms."""
        summed = self.df.groupBy(*by).agg(F.sum(V).alias(V), F.sum(F.abs(F.col(V))).alias("__size"))
        return Gmr(summed.where(F.abs(F.col(V)) > F.col("__size") * 2.0**-40).select(*by, V), tuple(by))

    def lift(self, var: str, value: Column | None = None) -> Gmr:
        """``var ^= value``: a new variable takes the value (the ring value if none is given); a bound one must equal it."""
        value = F.col(V) if value is None else value
        if var in self.vars:
            return Gmr(self.df.where(F.col(var) == value).withColumn(V, F.lit(1)), self.vars)
        return Gmr(self.df.select(*self.vars, value.alias(var), F.lit(1).alias(V)), (*self.vars, var))

    def extend(self, var: str, value: Column) -> Gmr:
        """A new variable beside the ring value, which stays."""
        return Gmr(self.df.select(*self.vars, value.alias(var), V), (*self.vars, var))

    def exists(self) -> Gmr:
        """1 for each key whose summed value is not 0."""
        summed = self.settled(self.vars) if self.vars else self.sum().pruned()
        return Gmr(summed.df.withColumn(V, F.lit(1)), self.vars)

    def absent(self, of: Gmr) -> Gmr:
        """The rows of ``of`` whose keys this relation does not have (``not exists``)."""
        keys = [v for v in of.vars if v in self.vars]
        return Gmr(of.df.join(self.exists().df.select(*keys), keys, "left_anti"), of.vars)

    def look_up(self, view: Gmr, initial: Column | None = None) -> Gmr:
        """Multiply by a view's value at this row's keys; what is absent is 0, or ``initial``."""
        keys = list(view.vars)
        both = self.df.join(view.df.withColumnRenamed(V, "__w"), keys, "left") if keys else self.df.crossJoin(F.broadcast(view.df.withColumnRenamed(V, "__w")))
        value = F.coalesce(F.col("__w"), F.lit(0) if initial is None else initial)
        return Gmr(both.select(*self.vars, (F.col(V) * value).alias(V)), self.vars)

    def slice(self, bound: Gmr) -> Gmr:
        """Rows at the bound keys, by an equi-join."""
        keys = [v for v in bound.vars if v in self.vars]
        return Gmr(self.df.join(bound.df.select(*keys).distinct(), keys, "left_semi"), self.vars)

    def pruned(self) -> Gmr:
        return Gmr(self.df.where(F.col(V) != 0), self.vars)

    def frame(self, value: str = "value") -> DataFrame:
        """The rows with their value under a name."""
        return self.df.select(*self.vars, F.col(V).alias(value))


@dataclass(frozen=True)
class Stored(Gmr):
    """A relation kept as a log of increments ``(vars..., __v)``, of about ``size`` bytes: rows at a few keys are picked before anything is summed."""

    log: DataFrame | None = None
    size: int = 0

    def increments(self, columns: Sequence[str], keys: DataFrame) -> Gmr:
        """The rows as they came in, since what is linear needs no sums; most of those whose keys nobody asks for are left out where the log is large."""
        log = self.log
        if self.size < LARGE_LOG or [t for _, t in keys.select(*columns).dtypes] != [t for _, t in log.select(*columns).dtypes]:
            return Gmr(log, self.vars)
        place = F.pmod(F.xxhash64(*columns), F.lit(KEY_BITS))
        bit = lambda df: df.withColumn("__place", place).withColumn("__bit", F.expr("shiftleft(1L, int(__place & 63))"))
        asked = bit(keys).groupBy(F.expr("__place >> 6").alias("__word")).agg(F.bit_or("__bit").alias("__bits"))
        picked = bit(log).join(F.broadcast(asked), F.expr("__place >> 6 = __word AND (__bits & __bit) <> 0"), "left_semi")
        return Gmr(picked.select(*self.vars, V), self.vars)

    def at(self, columns: Sequence[str], keys: DataFrame) -> Gmr:
        picked = self.log.join(keys, list(columns), "left_semi")
        return Gmr(picked.groupBy(*self.vars).agg(F.sum(V).alias(V)).where(F.col(V) != 0), self.vars)


def product(*parts: Gmr) -> Gmr:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def constant(like: DataFrame, value: object) -> Gmr:
    return Gmr(like.sparkSession.range(1).select(F.lit(value).alias(V)), ())


def on_demand(view: Callable[[Gmr], Gmr], inputs: Gmr) -> Gmr:
    """A view with input variables: computed for the distinct inputs asked for."""
    return view(Gmr(inputs.df.select(*inputs.vars).distinct().withColumn(V, F.lit(1)), inputs.vars))
