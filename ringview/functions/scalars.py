"""Scalar functions as Column builders; nothing here runs Python on rows.

Absent values are zero in this engine: divisions by zero give 0, and sums and averages over nothing give 0.
Dates are dates; ``date_code`` gives the yyyymmdd integer that views compare by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
Vector = tuple[Column, Column, Column]

MAX_INT = 0x40000000


def _c(x: ColumnOrName | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def zero_if_absent(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def hash_value(*xs: ColumnOrName) -> Column:
    """For placement only."""
    return F.xxhash64(*map(_c, xs))


def divide(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Float division; 0 where the divisor is 0."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.when(y == 0, F.lit(0.0)).otherwise(x / y)


def divide_int(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Division that cuts toward zero; 0 where the divisor is 0."""
    x, y = _c(x).cast("long"), _c(y).cast("long")
    return F.when(y == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", x, F.when(y == 0, 1).otherwise(y)))


def modulo(x: ColumnOrName, y: ColumnOrName) -> Column:
    """The remainder has the dividend's sign; 0 where the divisor is 0."""
    x, y = _c(x), _c(y)
    return F.when(y == 0, F.lit(0)).otherwise(x % F.when(y == 0, 1).otherwise(y))


def absolute(x: ColumnOrName) -> Column:
    return F.abs(_c(x))


def reciprocal(x: ColumnOrName) -> Column:
    return divide(F.lit(1.0), x)


def listmax(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.greatest(_c(x), _c(y))


def to_float(x: ColumnOrName) -> Column:
    return _c(x).cast("double")


def to_int(x: ColumnOrName) -> Column:
    """Cuts toward zero."""
    return _c(x).cast("long")


def to_text(x: ColumnOrName) -> Column:
    return _c(x).cast("string")


def substring(s: ColumnOrName, start: int, length: int, strict: bool = False) -> Column:
    """``start`` counts from 0. A strict one raises where the text ends before the part does."""
    part = F.substring(_c(s), start + 1, length)
    return F.when(F.length(_c(s)) < start + length, F.raise_error(F.lit("substring out of range"))).otherwise(part) if strict else part


def concat(*xs: ColumnOrName) -> Column:
    return F.concat(*map(_c, xs))


def from_escaped_operators(pattern: str) -> str:
    """A pattern in which groups and alternatives are written ``\\(``, ``\\)`` and ``\\|``, and the bare characters (and braces) stand for themselves."""
    out, k = [], 0
    while k < len(pattern):
        x, after = pattern[k], pattern[k + 1 : k + 2]
        if x == "\\" and after in ("(", ")", "|"):
            out.append(after)
            k += 1
        elif x == "\\" and after:
            out.append(x + after)
            k += 1
        else:
            out.append(f"\\{x}" if x in "(){}|" else x)
        k += 1
    return "".join(out)


def regex_match(pattern: str, s: ColumnOrName, escaped_operators: bool = False) -> Column:
    """1 if the pattern matches at the start, else 0."""
    pattern = from_escaped_operators(pattern) if escaped_operators else pattern
    return F.coalesce(_c(s).rlike(f"^(?:{pattern})").cast("int"), F.lit(0))


def parse_date(s: ColumnOrName) -> Column:
    return F.to_date(_c(s), "yyyy-M-d")


def date_code(d: ColumnOrName) -> Column:
    """yyyymmdd as an integer."""
    d = _c(d)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def date_part(part: str, d: ColumnOrName) -> Column:
    by: dict[str, Callable[[Column], Column]] = {"day": F.dayofmonth, "month": F.month, "year": F.year}
    if part.lower() not in by:
        raise ValueError(f"no date part {part!r}")
    return by[part.lower()](_c(d))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def average(total: ColumnOrName, count: ColumnOrName) -> Column:
    """Sum over count; 0 over nothing."""
    return _c(total) / F.greatest(F.lit(1), _c(count))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def vec_length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def vector_angle(a: Vector, b: Vector) -> Column:
    """In radians."""
    return F.acos(divide(dot(a, b), vec_length(a) * vec_length(b)))


def dihedral_angle(p: Vector, q: Vector, r: Vector, s: Vector) -> Column:
    """The torsion about q-r, in radians."""
    b1, b2, b3 = minus(q, p), minus(r, q), minus(s, r)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(vec_length(b2) * dot(b1, n2), dot(n1, n2))


#: The names that view definitions use.
REGISTRY: dict[str, Callable[..., Column]] = {
    "hash": hash_value, "divf": divide, "divi": divide_int, "mod": modulo, "abs": absolute, "reciprocal": reciprocal,
    "listmax": listmax, "float": to_float, "int": to_int, "string": to_text, "substring": substring, "concat": concat,
    "regexp_match": regex_match, "date": parse_date, "date_code": date_code, "date_part": date_part, "now": now_ms,
    "error": fail, "vec_length": vec_length, "vec_dot": dot, "vector_angle": vector_angle, "dihedral_angle": dihedral_angle,
    "radians": lambda x: F.radians(_c(x)), "degrees": lambda x: F.degrees(_c(x)), "pow": lambda x, y: F.pow(_c(x), _c(y)),
}


#: Typed functions by name and number of arguments: their builder, argument types and result type.
_TYPED: dict[str, dict[int, tuple[Callable[..., Column], tuple[str, ...], str]]] = {}


def register(name: str, builder: Callable[..., Column], takes: Sequence[str] | None = None, returns: str | None = None) -> None:
    """Add a function of columns under a name of its own; typed ones may share a name if they differ in their number of arguments."""
    if name in REGISTRY or (name in _TYPED and (takes is None or len(takes) in _TYPED[name])):
        raise ValueError(f"{name!r} is taken")
    if takes is None:
        REGISTRY[name] = builder
    else:
        _TYPED.setdefault(name, {})[len(takes)] = (builder, tuple(takes), returns or "double")


def call(name: str, *args: ColumnOrName | int | float) -> Column:
    """A function by name; arguments and result of a typed one are cast to its types."""
    if name in REGISTRY:
        return REGISTRY[name](*args)
    if len(args) not in _TYPED.get(name, {}):
        raise ValueError(f"no function {name!r} of {len(args)} arguments")
    builder, takes, returns = _TYPED[name][len(args)]
    return builder(*[_c(x).cast(t) for x, t in zip(args, takes, strict=True)]).cast(returns)


@contextmanager
def scope() -> Iterator[None]:
    """Functions that are registered inside are gone after it."""
    untyped, typed = dict(REGISTRY), {k: dict(v) for k, v in _TYPED.items()}
    try:
        yield
    finally:
        for held, before in ((REGISTRY, untyped), (_TYPED, typed)):
            held.clear()
            held.update(before)
