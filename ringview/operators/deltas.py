"""Views as expressions over relations, their change under batches, and maintained copies.

An expression gives its rows for an environment of relations (``rows``) and the change of its rows when the relations
change (``change``), where the changes are relations too, with negative values for deletions. Products follow
``d(a*b) = da*b + (a+da)*db``. Lift and exists are not linear: old and new rows are compared at the keys that changed.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gmr import Gmr, Stored, V

Relations = dict[str, Gmr]


class Expr(ABC):
    """A view definition."""

    @abstractmethod
    def rows(self, env: Relations) -> Gmr: ...

    @abstractmethod
    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        """None where nothing can change."""

    @abstractmethod
    def relations(self) -> set[str]: ...

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        """At least the rows that agree with some row of ``at`` on the variables they share."""
        return self.rows(env)

    def beside(self, env: Relations, at: Gmr) -> Gmr:
        """Rows to be joined with ``at``: what ``rows_at`` gives, but equal rows may stay apart, and others may come along."""
        return self.rows_at(env, at)

    def after(self, env: Relations, changes: Relations, at: Gmr | None = None) -> Gmr:
        d, old = self.change(env, changes), self.rows(env) if at is None else self.rows_at(env, at)
        return old if d is None else old + d

    def __mul__(self, other: Expr) -> Expr:
        return Product(self, other)

    def __add__(self, other: Expr) -> Expr:
        return Union(self, other)

    def __neg__(self) -> Expr:
        return Negated(self)

    def __sub__(self, other: Expr) -> Expr:
        return Union(self, Negated(other))


@dataclass(frozen=True)
class Rel(Expr):
    """A relation with its columns named as variables."""

    name: str
    columns: tuple[tuple[str, str], ...]

    def _of(self, g: Gmr) -> Gmr:
        return Gmr.scan(g.df, self.columns, F.col(V))

    def rows(self, env: Relations) -> Gmr:
        return self._of(env[self.name])

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        stored, shared = env[self.name], {v: c for c, v in self.columns if v in at.vars}
        if not shared or not isinstance(stored, Stored):
            return self.rows(env)
        keys = at.df.select(*[F.col(v).alias(c) for v, c in shared.items()]).distinct()
        return self._of(stored.at(list(shared.values()), keys))

    def beside(self, env: Relations, at: Gmr) -> Gmr:
        stored, shared = env[self.name], {v: c for c, v in self.columns if v in at.vars}
        if not shared or not isinstance(stored, Stored):
            return self.rows(env)
        return self._of(stored.increments(list(shared.values()), at.df.select(*[F.col(v).alias(c) for v, c in shared.items()])))

    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        return self._of(changes[self.name]) if self.name in changes else None

    def relations(self) -> set[str]:
        return {self.name}


def rel(name: str, *variables: str, **columns: str) -> Rel:
    """``rel("R", "A", "B")``: columns under their own names; ``rel("R", a="x")``: column ``a`` as variable ``x``."""
    return Rel(name, (*((v, v) for v in variables), *columns.items()))


@dataclass(frozen=True)
class _Linear(Expr):
    """Acts on old rows and on changes alike."""

    inner: Expr

    def _apply(self, g: Gmr) -> Gmr:
        raise NotImplementedError

    def rows(self, env: Relations) -> Gmr:
        return self._apply(self.inner.rows(env))

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        return self._apply(self.inner.rows_at(env, at))

    def beside(self, env: Relations, at: Gmr) -> Gmr:
        return self._apply(self.inner.beside(env, at))

    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        d = self.inner.change(env, changes)
        return None if d is None else self._apply(d)

    def relations(self) -> set[str]:
        return self.inner.relations()


@dataclass(frozen=True)
class Where(_Linear):
    condition: Column | str

    def _apply(self, g: Gmr) -> Gmr:
        return g.where(self.condition)


@dataclass(frozen=True)
class Times(_Linear):
    value: Column

    def _apply(self, g: Gmr) -> Gmr:
        return g.times(self.value)


@dataclass(frozen=True)
class Extend(_Linear):
    var: str
    value: Column

    def _apply(self, g: Gmr) -> Gmr:
        return g.extend(self.var, self.value)


@dataclass(frozen=True)
class Negated(_Linear):
    def _apply(self, g: Gmr) -> Gmr:
        return -g


@dataclass(frozen=True)
class Sum(_Linear):
    by: tuple[str, ...] = ()

    def _apply(self, g: Gmr) -> Gmr:
        return g.sum(self.by)

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        """Groups are whole: only the variables that are summed by pick rows."""
        kept = [v for v in at.vars if v in self.by]
        return self._apply(self.inner.rows_at(env, Gmr(at.df.select(*kept, V), tuple(kept)))) if kept else self.rows(env)

    def beside(self, env: Relations, at: Gmr) -> Gmr:
        return self.rows_at(env, at)


@dataclass(frozen=True)
class Union(Expr):
    left: Expr
    right: Expr

    def rows(self, env: Relations) -> Gmr:
        return self.left.rows(env) + self.right.rows(env)

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        return self.left.rows_at(env, at) + self.right.rows_at(env, at)

    def beside(self, env: Relations, at: Gmr) -> Gmr:
        return self.left.beside(env, at) + self.right.beside(env, at)

    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        a, b = self.left.change(env, changes), self.right.change(env, changes)
        return b if a is None else a if b is None else a + b

    def relations(self) -> set[str]:
        return self.left.relations() | self.right.relations()


@dataclass(frozen=True)
class Product(Expr):
    left: Expr
    right: Expr

    def rows(self, env: Relations) -> Gmr:
        return self.left.rows(env) * self.right.rows(env)

    def rows_at(self, env: Relations, at: Gmr) -> Gmr:
        return self.left.rows_at(env, at) * self.right.rows_at(env, at)

    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        """Of the other side only the rows at the change's keys are looked at; one join finds them, as increments: sums of products need no sums before."""
        a, b = self.left.change(env, changes), self.right.change(env, changes)
        first = None if a is None else a * self.right.beside(env, a)
        left = None if b is None else self.left.beside(env, b)
        second = None if b is None else (left if a is None else left + a) * b
        return second if first is None else first if second is None else first + second

    def relations(self) -> set[str]:
        return self.left.relations() | self.right.relations()


@dataclass(frozen=True)
class _Keyed(Expr):
    """Not linear: the keys that a change touches are taken out as they were and put back as they are."""

    inner: Expr

    def _apply(self, g: Gmr) -> Gmr:
        raise NotImplementedError

    def _summed(self, g: Gmr) -> Gmr:
        """Keys whose values add up to 0 have no row left; without keys the sum is 0."""
        return g.settled(g.vars) if g.vars else g.sum()

    def rows(self, env: Relations) -> Gmr:
        return self._apply(self._summed(self.inner.rows(env)))

    def change(self, env: Relations, changes: Relations) -> Gmr | None:
        d = self.inner.change(env, changes)
        if d is None:
            return None
        old = self.inner.rows_at(env, d)
        old = old.slice(d) if old.vars else old
        return self._apply(self._summed(old + d)) - self._apply(self._summed(old))

    def relations(self) -> set[str]:
        return self.inner.relations()


@dataclass(frozen=True)
class Exists(_Keyed):
    def _apply(self, g: Gmr) -> Gmr:
        return g.exists()


@dataclass(frozen=True)
class Lift(_Keyed):
    """The summed value of each key as a variable. A key without rows has none, unless there are no keys: then it is 0."""

    var: str

    def _apply(self, g: Gmr) -> Gmr:
        return g.lift(self.var)


def count_and_sum(inner: Expr, by: Sequence[str], value: Column) -> tuple[Expr, Expr]:
    """A group's row count and its sum, apart: a sum of 0 is not a group without rows."""
    return Sum(inner, tuple(by)), Sum(Times(inner, value), tuple(by))
