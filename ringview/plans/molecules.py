"""Molecular queries: geometry of points, and trajectories of atoms.

The embeddings stand for a trajectory: vector ``i`` is atom ``i // 12`` at one of twelve frames (three trajectories of four
times); its first three values are the place. Atoms are named N, CA, C and O in turn and belong to residues of eight atoms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .common import load, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_query = register(QUERIES, ORACLE_SQL)
c = F.col


def _sub(a: str, b: str) -> list[str]:
    return [f"({a}[{k}] - {b}[{k}])" for k in (1, 2, 3)]


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _torsion_sql(p: str, q: str, r: str, s: str) -> str:
    b1, b2, b3 = _sub(q, p), _sub(r, q), _sub(s, r)
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    return f"atan2(sqrt({_dot(b2, b2)}) * {_dot(b1, n2)}, {_dot(n1, n2)})"


def _vector(x: Column, start: int) -> tuple[Column, Column, Column]:
    return tuple(F.element_at(x, start + k).cast("double") for k in range(3))


def _each(x: str) -> list[str]:
    return [f"{x}[{k}]" for k in (1, 2, 3)]


@_query(
    f"""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    p AS (SELECT vec_id, x[1:3] AS p, x[4:6] AS q, x[7:9] AS r, x[10:12] AS s FROM e)
    SELECT vec_id, round(sqrt({_dot(_each("p"), _each("p"))}), 6) AS length, round({_dot(_each("p"), _each("q"))}, 6) AS dot,
      round(acos(CASE WHEN sqrt({_dot(_each("p"), _each("p"))}) * sqrt({_dot(_each("q"), _each("q"))}) = 0 THEN 0
        ELSE {_dot(_each("p"), _each("q"))} / (sqrt({_dot(_each("p"), _each("p"))}) * sqrt({_dot(_each("q"), _each("q"))})) END), 6) AS angle,
      round({_torsion_sql("p", "q", "r", "s")}, 6) AS torsion
    FROM p
    """
)
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, product, angle and torsion of points whose coordinates are an embedding's first twelve values."""
    (points,) = load(spark, sf_dir, "embeddings")
    p = [_vector(c("embedding"), 3 * k + 1) for k in range(4)]
    return points.select(
        "vec_id",
        F.round(S.vec_length(p[0]), 6).alias("length"),
        F.round(S.dot(p[0], p[1]), 6).alias("dot"),
        F.round(S.vector_angle(p[0], p[1]), 6).alias("angle"),
        F.round(S.dihedral_angle(*p), 6).alias("torsion"),
    )


_ATOMS = """WITH pos AS (SELECT CAST(vec_id % 3 AS BIGINT) AS trj, CAST(vec_id // 3 % 4 AS BIGINT) AS t, vec_id // 12 AS atom, CAST(embedding AS DOUBLE[])[1:3] AS p FROM embeddings),
meta AS (SELECT atom, ['N', 'CA', 'C', 'O'][atom % 4 + 1] AS name, CASE WHEN atom // 8 % 2 = 0 THEN 'LYS' ELSE 'TIP3' END AS residue, atom // 4 % 7 AS dim FROM (SELECT DISTINCT atom FROM pos))
"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (points,) = load(spark, sf_dir, "embeddings")
    i = c("vec_id")
    x = [F.element_at("embedding", k + 1).cast("double").alias(n) for k, n in enumerate("xyz")]
    return points.select((i % 3).cast("long").alias("trj"), (S.divide_int(i, 3) % 4).alias("t"), S.divide_int(i, 12).alias("atom"), *x)


def _meta(positions: DataFrame) -> DataFrame:
    a = c("atom")
    name = F.element_at(F.array(*map(F.lit, ("N", "CA", "C", "O"))), (a % 4 + 1).cast("int")).alias("name")
    residue = F.when(S.divide_int(a, 8) % 2 == 0, "LYS").otherwise("TIP3").alias("residue")
    return positions.select("atom").distinct().select("atom", name, residue, (S.divide_int(a, 4) % 7).alias("dim"))


@_query(
    _ATOMS
    + f"""
    SELECT a.trj, a.t, round(avg(sqrt({_dot(_sub("a.p", "b.p"), _sub("a.p", "b.p"))})), 6) AS rdf
    FROM pos a JOIN meta m ON a.atom = m.atom JOIN pos b ON a.trj = b.trj AND a.t = b.t JOIN meta n ON b.atom = n.atom
    WHERE m.residue = 'LYS' AND m.name = 'N' AND n.residue = 'TIP3' AND n.name = 'O' GROUP BY 1, 2
    """
)
def molecules_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean distance between atoms of two kinds at each frame; the kinds are chosen before atoms of a frame meet."""
    positions = _positions(spark, sf_dir)
    meta = _meta(positions)
    of = lambda residue, name: positions.join(meta.where((c("residue") == residue) & (c("name") == name)).select("atom"), "atom", "left_semi")
    a, b = of("LYS", "N").alias("a"), of("TIP3", "O").alias("b")
    apart = S.vec_length(S.minus(tuple(c(f"a.{k}") for k in "xyz"), tuple(c(f"b.{k}") for k in "xyz")))
    pairs = a.join(b, (c("a.trj") == c("b.trj")) & (c("a.t") == c("b.t")))
    return pairs.groupBy("a.trj", "a.t").agg(F.round(F.avg(apart), 6).alias("rdf")).select("trj", "t", "rdf")


@_query(
    _ATOMS
    + f""", d AS (SELECT m1.atom AS a1, m2.atom AS a2, m3.atom AS a3, m4.atom AS a4, m1.dim FROM meta m1 JOIN meta m2 ON m2.atom = m1.atom + 1
      JOIN meta m3 ON m3.atom = m1.atom + 2 JOIN meta m4 ON m4.atom = m1.atom + 3
      WHERE (m1.name = 'N' AND m2.name = 'CA' AND m3.name = 'C') OR (m2.name = 'N' AND m3.name = 'CA' AND m4.name = 'C'))
    SELECT p.trj, p.t, d.a1 AS atom, round({_torsion_sql("p.p", "q.p", "r.p", "s.p")}, 6) AS phi_psi, dim
    FROM d JOIN pos p ON p.atom = a1 JOIN pos q ON q.atom = a2 AND q.trj = p.trj AND q.t = p.t
      JOIN pos r ON r.atom = a3 AND r.trj = p.trj AND r.t = p.t JOIN pos s ON s.atom = a4 AND s.trj = p.trj AND s.t = p.t
    """
)
def molecules_dihedral_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbone angles at each frame: four atoms that a table of dihedrals names, met by trajectory, time and atom in one shuffle.

    The positions are not joined four times: each goes to the dihedrals that it is part of, and the four of one dihedral and frame meet in a group.
    """
    positions = _positions(spark, sf_dir)
    meta = _meta(positions)
    names = [meta.select((c("atom") - k).alias("a1"), c("name").alias(f"n{k}"), *([c("dim")] if not k else [])) for k in range(4)]
    d = names[0].join(names[1], "a1").join(names[2], "a1").join(names[3], "a1")
    kinds = lambda k: (c(f"n{k}") == "N") & (c(f"n{k + 1}") == "CA") & (c(f"n{k + 2}") == "C")
    d = d.where(kinds(0) | kinds(1)).select("a1", "dim", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("a1", "dim", "k", (c("a1") + c("k")).alias("atom"))
    met = positions.join(d, "atom").groupBy("trj", "t", "a1", "dim").agg(*[F.max(F.when(c("k") == k, F.struct("x", "y", "z"))).alias(f"p{k}") for k in range(4)])
    p = [tuple(c(f"p{k}.{x}") for x in "xyz") for k in range(4)]
    complete = met.where(" AND ".join(f"p{k} IS NOT NULL" for k in range(4)))
    return complete.select("trj", "t", c("a1").alias("atom"), F.round(S.dihedral_angle(*p), 6).alias("phi_psi"), "dim")
