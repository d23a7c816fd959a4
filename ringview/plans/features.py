"""One query for each SQL construct, over three small relations R(A, B), S(B, C) and T(C, D).

R is nations by region, S suppliers by nation and balance in thousands, T customers by balance and nation. All are
whole tables and bags. A scalar over nothing is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordered import running_sums
from .common import load

_WITH = """WITH r AS (SELECT n_regionkey AS a, n_nationkey AS b FROM nation),
s AS (SELECT s_nationkey AS b, CAST(floor(s_acctbal / 1000) AS BIGINT) AS c FROM supplier),
t AS (SELECT CAST(floor(c_acctbal / 1000) AS BIGINT) AS c, c_nationkey AS d FROM customer)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Relations = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nations, suppliers, customers = load(spark, sf_dir, "nation", "supplier", "customer")
    return (
        nations.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b")),
        suppliers.select(F.col("s_nationkey").alias("b"), F.floor(F.col("s_acctbal") / 1000).alias("c")),
        customers.select(F.floor(F.col("c_acctbal") / 1000).alias("c"), F.col("c_nationkey").alias("d")),
    )


def _add(name: str, plan: Relations, sql: str) -> None:
    QUERIES[f"sql_{name}"] = lambda spark, sf_dir: plan(*relations(spark, sf_dir))
    ORACLE_SQL[f"sql_{name}"] = _WITH + sql


def _sum(x: Column | str, name: str = "v") -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)


def _scalar(df: DataFrame, value: Column) -> DataFrame:
    """One row, broadcast to what it is compared with."""
    return F.broadcast(df.agg(value))


c = F.col


def n() -> Column:
    return F.count("*").alias("n")


_add("star", lambda r, s, t: r, "SELECT * FROM r")
_add("projection", lambda r, s, t: s.select((c("b") + c("c")).alias("x"), c("b").alias("y")), "SELECT b + c AS x, b AS y FROM s")
_add(
    "part_star",
    lambda r, s, t: r.join(s.select(c("b").alias("sb"), "c"), c("b") == c("sb")).select("a", "b", "c"),
    "SELECT r.*, s.c FROM r, s WHERE r.b = s.b",
)
_add(
    "where_and_or_not",
    lambda r, s, t: s.where(((c("c") > 3) & (c("b") <= 12)) | ~(c("b") != 7)),
    "SELECT * FROM s WHERE (c > 3 AND b <= 12) OR NOT b <> 7",
)
_add("where_never", lambda r, s, t: r.where((c("a") < 1) & (c("a") > 1)), "SELECT * FROM r WHERE a < 1 AND a > 1")
_add("where_or_itself", lambda r, s, t: r.where((c("a") == 1) | (c("a") == 1)), "SELECT * FROM r WHERE a = 1 OR a = 1")
_add(
    "arithmetic",
    lambda r, s, t: r.select("b", F.round(S.divide(c("a") * 3 - 1, c("b")), 6).alias("q")),
    "SELECT b, round(CASE WHEN b = 0 THEN 0 ELSE CAST(a * 3 - 1 AS DOUBLE) / b END, 6) AS q FROM r",
)
_add(
    "divide_sum",
    lambda r, s, t: r.groupBy("b").agg(F.round(F.sum(S.divide(c("a"), c("b"))), 6).alias("v")),
    "SELECT b, round(sum(CASE WHEN b = 0 THEN 0 ELSE CAST(a AS DOUBLE) / b END), 6) AS v FROM r GROUP BY b",
)
_add(
    "join_two",
    lambda r, s, t: r.join(s, "b").agg(_sum(c("a") * c("c"))),
    "SELECT CAST(coalesce(sum(a * c), 0) AS BIGINT) AS v FROM r, s WHERE r.b = s.b",
)
_add(
    "join_three",
    lambda r, s, t: (
        r.join(s, "b").groupBy("c").agg(F.sum("a").alias("a"))
        .join(t.groupBy("c").agg(F.sum("d").alias("d")), "c").agg(_sum(c("a") * c("d")))
    ),
    "SELECT CAST(coalesce(sum(a * d), 0) AS BIGINT) AS v FROM r, s, t WHERE r.b = s.b AND s.c = t.c",
)
_add(
    "join_on",
    lambda r, s, t: r.alias("r").join(s.alias("s"), (c("r.b") == c("s.b")) & (c("s.c") > c("r.a"))).select("r.a", "r.b", "s.c"),
    "SELECT r.a, r.b, s.c FROM r JOIN s ON r.b = s.b AND s.c > r.a",
)
_add("natural_join", lambda r, s, t: r.join(s, "b").select("a", "b", "c"), "SELECT a, b, c FROM r NATURAL JOIN s")
_add("natural_self_join", lambda r, s, t: r.alias("x").join(r.alias("y"), ["a", "b"]).select("a", "b"), "SELECT a, b FROM r x NATURAL JOIN r y")
_add(
    "self_join_sums",
    lambda r, s, t: (
        r.alias("x").join(r.groupBy("a").agg(F.sum("b").alias("sb"), F.count("*").alias("nb")), "a")
        .groupBy("a").agg(_sum(c("b") * c("sb")))
    ),
    "SELECT x.a, CAST(sum(x.b * y.b) AS BIGINT) AS v FROM r x, r y WHERE x.a = y.a GROUP BY x.a",
)
_add(
    "theta_join",
    lambda r, s, t: _less_pairs(r, s),
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(r.a * s.c), 0) AS BIGINT) AS v FROM r, s WHERE r.b < s.b",
)
_add(
    "cross_join_sums",
    lambda r, s, t: (
        r.agg(F.count("*").alias("nr"), F.sum("a").alias("sr"))
        .join(F.broadcast(s.agg(F.count("*").alias("ns"), F.sum("c").alias("ss"))))
        .select((c("sr") * c("ns")).cast("long").alias("sum_a"), (c("ss") * c("nr")).cast("long").alias("sum_c"))
    ),
    "SELECT CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(c) AS BIGINT) AS sum_c FROM r, s",
)
_add(
    "cross_join_rows",
    lambda r, s, t: r.alias("x").crossJoin(F.broadcast(r).alias("y")).select(c("x.a"), c("x.b"), c("y.a").alias("a2"), c("y.b").alias("b2")),
    "SELECT x.a, x.b, y.a AS a2, y.b AS b2 FROM r x, r y",
)
_add(
    "or_join",
    lambda r, s, t: r.alias("r").join(s.alias("s"), (c("r.b") == c("s.b")) & ((c("r.a") == 1) | (c("s.c") == 5))).select("r.a", "r.b", "s.c"),
    "SELECT r.a, r.b, s.c FROM r, s WHERE (r.b = s.b AND r.a = 1) OR (r.b = s.b AND s.c = 5)",
)
_add(
    "aggregates",
    lambda r, s, t: (
        s.groupBy("b").agg(_sum("c", "total"), F.count("*").alias("n"), F.count("c").alias("nc"), F.round(F.sum("c") / F.greatest(F.lit(1), F.count("c")), 6).alias("mean"))
    ),
    """
    SELECT b, CAST(sum(c) AS BIGINT) AS total, count(*) AS n, count(c) AS nc, round(CAST(sum(c) AS DOUBLE) / greatest(1, count(c)), 6) AS mean
    FROM s GROUP BY b
    """,
)
_add(
    "aggregates_of_nothing",
    lambda r, s, t: (
        s.where("c > 1000000").agg(_sum("c", "total"), F.count("*").alias("n"), (F.coalesce(F.sum("c"), F.lit(0)) / F.greatest(F.lit(1), F.count("c"))).alias("mean"))
    ),
    """
    SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS n, CAST(coalesce(sum(c), 0) / greatest(1, count(c)) AS DOUBLE) AS mean
    FROM s WHERE c > 1000000
    """,
)
_add("count_distinct", lambda r, s, t: s.groupBy("b").agg(F.countDistinct("c").alias("n")), "SELECT b, count(DISTINCT c) AS n FROM s GROUP BY b")
_add("count_distinct_rows", lambda r, s, t: s.distinct().agg(n()), "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM s)")
_add("distinct", lambda r, s, t: t.select("c").distinct(), "SELECT DISTINCT c FROM t")
_add(
    "group_by_alias",
    lambda r, s, t: s.select((c("b") + 1).alias("k"), "c").groupBy("k").agg(_sum("c")),
    "SELECT b + 1 AS k, CAST(sum(c) AS BIGINT) AS v FROM s GROUP BY k",
)
_add("group_by_unselected", lambda r, s, t: s.groupBy("b").agg(_sum("c")).select("v"), "SELECT CAST(sum(c) AS BIGINT) AS v FROM s GROUP BY b")
_add(
    "expression_of_sums",
    lambda r, s, t: r.groupBy("a").agg(F.round(S.divide(F.sum("b"), F.sum("a")) + F.count("*"), 6).alias("v")),
    "SELECT a, round(CASE WHEN sum(a) = 0 THEN 0 ELSE CAST(sum(b) AS DOUBLE) / sum(a) END + count(*), 6) AS v FROM r GROUP BY a",
)
_add(
    "sum_times_key",
    lambda r, s, t: r.groupBy("a").agg((c("a") * F.sum("b")).cast("long").alias("v")),
    "SELECT a, CAST(a * sum(b) AS BIGINT) AS v FROM r GROUP BY a",
)
_add(
    "several_outputs",
    lambda r, s, t: r.agg(_sum("a")).withColumn("q", F.lit("sum")).unionByName(r.agg(F.count("*").alias("v")).withColumn("q", F.lit("count"))),
    "SELECT CAST(sum(a) AS BIGINT) AS v, 'sum' AS q FROM r UNION ALL SELECT count(*), 'count' FROM r",
)
_add(
    "from_subquery",
    lambda r, s, t: r.where("b > 3").select((c("a") + 1).alias("x"), "b").where("x < 5").groupBy("x").agg(_sum("b")),
    "SELECT x, CAST(sum(b) AS BIGINT) AS v FROM (SELECT a + 1 AS x, b FROM (SELECT * FROM r WHERE b > 3)) WHERE x < 5 GROUP BY x",
)
_add(
    "aggregate_of_aggregate",
    lambda r, s, t: s.groupBy("b").agg(F.count("*").alias("k")).groupBy("k").agg(n()),
    "SELECT k, count(*) AS n FROM (SELECT b, count(*) AS k FROM s GROUP BY b) GROUP BY k",
)
_add(
    "scalar_subquery",
    lambda r, s, t: s.join(_scalar(s, F.coalesce(F.avg("c"), F.lit(0)).alias("m"))).where("c > m").select("b", "c"),
    "SELECT b, c FROM s WHERE c > (SELECT coalesce(avg(c), 0) FROM s)",
)
_add(
    "sum_below_outer",
    lambda r, s, t: _sum_of_less(r),
    "SELECT a, b FROM r x WHERE (SELECT coalesce(sum(CASE WHEN y.a < x.a THEN 1 ELSE 0 END), 0) FROM r y) < 10",
)
_add(
    "correlated_equal",
    lambda r, s, t: r.join(s.groupBy("b").agg(F.sum("c").alias("m")), "b", "left").where("a < coalesce(m, 0)").select("a", "b"),
    "SELECT a, b FROM r WHERE a < (SELECT coalesce(sum(c), 0) FROM s WHERE s.b = r.b)",
)
_add(
    "correlated_less",
    lambda r, s, t: _running(s),
    "SELECT b, c, CAST((SELECT coalesce(sum(y.c), 0) FROM s y WHERE y.b < x.b) AS BIGINT) AS before FROM s x",
)
_add(
    "scalar_in_select",
    lambda r, s, t: r.join(s.groupBy("b").agg(F.count("*").alias("k")), "b", "left").select("a", "b", F.coalesce("k", F.lit(0)).alias("k")),
    "SELECT a, b, (SELECT count(*) FROM s WHERE s.b = r.b) AS k FROM r",
)
_add(
    "scalar_in_sum",
    lambda r, s, t: r.join(s.groupBy("b").agg(F.sum("c").alias("m")), "b", "left").agg(_sum(c("a") * F.coalesce("m", F.lit(0)))),
    "SELECT CAST(coalesce(sum(a * (SELECT coalesce(sum(c), 0) FROM s WHERE s.b = r.b)), 0) AS BIGINT) AS v FROM r",
)
_add(
    "exists",
    lambda r, s, t: r.join(s.where("c > 7"), "b", "left_semi"),
    "SELECT a, b FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.b = r.b AND c > 7)",
)
_add(
    "not_exists",
    lambda r, s, t: r.join(s.where("c > 7"), "b", "left_anti"),
    "SELECT a, b FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.b = r.b AND c > 7)",
)
_add("exists_unequal", lambda r, s, t: _exists_other(s), "SELECT b, c FROM s x WHERE EXISTS (SELECT 1 FROM s y WHERE y.b = x.b AND y.c <> x.c)")
_add(
    "not_exists_greater",
    lambda r, s, t: s.join(s.groupBy("b").agg(F.max("c").alias("m")), "b").where("c = m").select("b", "c"),
    "SELECT b, c FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.b = x.b AND y.c > x.c)",
)
_add(
    "exists_of_aggregate",
    lambda r, s, t: r.join(s.groupBy("b").agg(F.sum("c").alias("m")), "b").where("m > a").select("a", "b"),
    "SELECT a, b FROM r WHERE EXISTS (SELECT 1 FROM (SELECT b, sum(c) AS m FROM s GROUP BY b) q WHERE q.b = r.b AND q.m > r.a)",
)
_add(
    "in_subquery",
    lambda r, s, t: t.join(s.select("c"), "c", "left_semi").groupBy("d").agg(n()),
    "SELECT d, count(*) AS n FROM t WHERE c IN (SELECT c FROM s) GROUP BY d",
)
_add(
    "not_in_subquery",
    lambda r, s, t: t.join(s.where("c > 4").select("c"), "c", "left_anti").groupBy("c").agg(n()),
    "SELECT c, count(*) AS n FROM t WHERE c NOT IN (SELECT c FROM s WHERE c > 4) GROUP BY c",
)
_add(
    "greater_equal_all",
    lambda r, s, t: s.join(_scalar(r, F.max("a").alias("m"))).where("m IS NULL OR c >= m").select("b", "c"),
    "SELECT b, c FROM s WHERE c >= ALL (SELECT a FROM r)",
)
_add(
    "less_all",
    lambda r, s, t: r.join(_scalar(s, F.min("c").alias("m"))).where("m IS NULL OR a < m").select("a", "b"),
    "SELECT a, b FROM r WHERE a < ALL (SELECT c FROM s)",
)
_add(
    "greater_some",
    lambda r, s, t: s.join(_scalar(r, F.min("a").alias("m"))).where("c > m").select("b", "c"),
    "SELECT b, c FROM s WHERE c > ANY (SELECT a FROM r)",
)
_add(
    "less_all_correlated",
    lambda r, s, t: r.join(s.groupBy("b").agg(F.avg("c").alias("m")), "b", "left").where("m IS NULL OR a < m").select("a", "b"),
    "SELECT a, b FROM r WHERE NOT EXISTS (SELECT 1 FROM (SELECT b, avg(c) AS m FROM s GROUP BY b) q WHERE q.b = r.b AND NOT r.a < q.m)",
)
_add("in_list", lambda r, s, t: r.where(c("a").isin(1, 3) & ~c("b").isin(2, 3, 4)), "SELECT a, b FROM r WHERE a IN (1, 3) AND b NOT IN (2, 3, 4)")
_add(
    "between",
    lambda r, s, t: s.where(c("c").between(2, 5)).groupBy("b").agg(n()),
    "SELECT b, count(*) AS n FROM s WHERE c BETWEEN 2 AND 5 GROUP BY b",
)
_add(
    "case",
    lambda r, s, t: (
        s.groupBy(F.when(c("c") < 0, "low").when(c("c") < 5, "mid").otherwise("high").alias("k"))
        .agg(n(), F.sum(F.when(c("b") == 3, 1).otherwise(0)).alias("threes"))
    ),
    """
    SELECT CASE WHEN c < 0 THEN 'low' WHEN c < 5 THEN 'mid' ELSE 'high' END AS k, count(*) AS n, CAST(sum(CASE b WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS threes
    FROM s GROUP BY 1
    """,
)
_add(
    "listmax",
    lambda r, s, t: s.select("b", S.listmax(F.lit(3), c("c")).cast("long").alias("m")),
    "SELECT b, CAST(greatest(3, c) AS BIGINT) AS m FROM s",
)
_add(
    "union",
    lambda r, s, t: (
        r.groupBy("a").agg(_sum("b")).select(c("a").alias("k"), "v")
        .unionByName(s.groupBy("b").agg(_sum("c")).select(c("b").alias("k"), "v"))
        .groupBy("k").agg(_sum("v"))
    ),
    "SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT a AS k, b AS v FROM r UNION ALL SELECT b, c FROM s) GROUP BY k",
)


def _less_pairs(r: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs with ``r.b < s.b``, counted by running sums over the values of b: no pair is made."""
    by = r.groupBy("b").agg(F.count("*").alias("n"), F.sum("a").alias("x"), F.lit(0).alias("m"), F.lit(0).alias("y")).unionByName(
        s.groupBy("b").agg(F.lit(0).alias("n"), F.lit(0).alias("x"), F.count("*").alias("m"), F.sum("c").alias("y"))
    )
    by = by.groupBy("b").agg(*[F.sum(k).alias(k) for k in "nxmy"])
    sums = running_sums(by, "b", ["n", "x"])
    return sums.agg(_sum(c("m") * c("before_n"), "n"), _sum(c("y") * c("before_x"), "v"))


def _sum_of_less(r: DataFrame) -> DataFrame:
    counts = running_sums(r.groupBy("a").agg(F.count("*").alias("n")), "a", ["n"])
    return r.join(counts.where("before_n < 10"), "a", "left_semi").select("a", "b")


def _running(s: DataFrame) -> DataFrame:
    return running_sums(s, "b", ["c"]).select("b", "c", c("before_c").cast("long").alias("before"))


def _exists_other(s: DataFrame) -> DataFrame:
    spread = s.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    return s.join(spread, "b", "left_semi").select("b", "c")


def _table(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f"sql_{name}"], ORACLE_SQL[f"sql_{name}"] = f, sql
        return f

    return add


@_table("like", "SELECT p_type, count(*) AS n FROM part WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'S%' GROUP BY 1")
def _like(spark: SparkSession, sf_dir: str) -> DataFrame:
    (parts,) = load(spark, sf_dir, "part")
    return parts.where(c("p_name").like("%1%") & ~c("p_type").like("S%")).groupBy("p_type").agg(n())


@_table("dates", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(max(day(o_orderdate)) AS INT) AS d, CAST(max(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) AS INT) AS code, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-02-01' GROUP BY 1, 2")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    day = c("o_orderdate")
    late = orders.where(day >= F.to_timestamp_ntz(F.lit("1996-02-01")))
    return late.groupBy(S.date_part("year", day).alias("y"), S.date_part("MONTH", day).alias("m")).agg(F.max(S.date_part("day", day)).alias("d"), F.max(S.date_code(day)).alias("code"), n())


@_table("substring", "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1")
def _substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return orders.groupBy(S.substring("o_orderpriority", 0, 1).alias("p")).agg(n())
