"""Queries of the operators that change collections, read single entries or fold joins, and of scalar functions.

The vector is the suppliers: position ``s_suppkey``, value ``s_nationkey``. The log is the events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collections as K
from ..streaming import views as W
from .common import load, register
from .features import _WITH, relations
from .views import _gmrs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_query = register(QUERIES, ORACLE_SQL)
c = F.col

_V = "WITH v AS (SELECT s_suppkey AS pos, CAST(s_nationkey AS BIGINT) AS value FROM supplier)\n"


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    (suppliers,) = load(spark, sf_dir, "supplier")
    return suppliers.select(c("s_suppkey").alias("pos"), c("s_nationkey").cast("long").alias("value"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return events.select(c("event_id").alias("seq"), c("event_type").alias("tag"), "user_id")


@_query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
def coll_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = load(spark, sf_dir, "region", "nation")
    a, b = regions.select(c("r_name").alias("name")), nations.select(c("n_name").alias("name"))
    return K.insert(K.insert(a, b), a)


@_query(
    _V
    + """
    SELECT coalesce(w.pos, v.pos) AS pos, CASE WHEN w.pos IS NULL THEN v.value ELSE w.value END AS value
    FROM v FULL JOIN (SELECT 2 * pos AS pos, -pos AS value FROM v) w ON w.pos = v.pos
    """
)
def coll_insert_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir)
    return K.insert_at(v, v.select((2 * c("pos")).alias("pos"), (-c("pos")).alias("value")))


@_query(_V + "SELECT pos, CAST(7 AS BIGINT) AS value FROM v")
def coll_set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.set_all(_vector(spark, sf_dir), value=7)


@_query(_V + "SELECT pos, CASE WHEN value = 3 THEN 99 ELSE value END AS value FROM v")
def coll_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir)
    old = v.where("value = 3")
    return K.update(v, old, old.select("pos", F.lit(99).cast("long").alias("value")))


@_query(_V + "SELECT pos, CASE WHEN pos = 5 THEN value + 100 ELSE value END AS value FROM v")
def coll_update_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.update_at(_vector(spark, sf_dir), 5, c("value") + 100)


@_query(
    _V
    + """, m AS (SELECT min(pos) AS pos FROM v WHERE value = 4)
    SELECT CASE WHEN v.pos = m.pos THEN 'taken' ELSE 'left' END AS part, v.pos, value FROM v, m
    """
)
def coll_delete_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, left = K.delete_with(_vector(spark, sf_dir), c("value") == 4, c("pos"))
    return taken.select(F.lit("taken").alias("part"), "pos", "value").unionByName(left.select(F.lit("left").alias("part"), "pos", "value"))


@_query(_V + """
    SELECT 'taken' AS part, pos, value FROM v WHERE pos = 3
    UNION ALL SELECT 'left', pos, CASE WHEN pos = 3 THEN -1 ELSE value END FROM v
    """)
def coll_delete_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, left = K.delete_at(_vector(spark, sf_dir), 3, -1)
    return taken.select(F.lit("taken").alias("part"), "pos", "value").unionByName(left.select(F.lit("left").alias("part"), "pos", "value"))


@_query(_V + "SELECT pos, value FROM v WHERE pos > (SELECT min(pos) FROM v)")
def coll_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pop(_vector(spark, sf_dir))


@_query(_V + "SELECT pos, value FROM v WHERE false")
def coll_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clear(_vector(spark, sf_dir))


@_query(_V + "SELECT pos, value FROM v ORDER BY value DESC, pos LIMIT 7")
def coll_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a sorted collection."""
    return K.sort(_vector(spark, sf_dir), F.desc("value"), "pos").limit(7)


@_query("SELECT count(*) AS size FROM customer")
def coll_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.size(load(spark, sf_dir, "customer")[0])


@_query("SELECT count(*) AS n, round(sum(o_totalprice * c_acctbal), -3) AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def coll_equijoin_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = load(spark, sf_dir, "orders", "customer")
    product = F.sum(c("o_totalprice") * c("c_acctbal"))
    return K.equijoin_fold(orders.withColumnRenamed("o_custkey", "k"), customers.withColumnRenamed("c_custkey", "k"), ["k"], n=F.count("*"), v=F.round(product, -3))


@_query("SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
def coll_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a collection of one; any entry may come of others."""
    (nations,) = load(spark, sf_dir, "nation")
    return K.peek(K.slice_of(nations, n_nationkey=7).select(c("n_name").alias("name")))


@_query("SELECT event_id AS vid, user_id, event_type FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 1")
def coll_peek_with_vid(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return K.peek_with_vid(events.select(c("event_id").alias("vid"), "user_id", "event_type"), 700)


@_query(_V + "SELECT pos, value FROM v WHERE pos = 4 UNION ALL SELECT -9, 0 UNION ALL SELECT pos, value FROM v WHERE pos = 6")
def coll_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots, and a hole with its default."""
    v = _vector(spark, sf_dir)
    return K.at(v, 4).unionByName(K.at(v, -9, default={"value": 0})).unionByName(K.at(v, 6, default={"value": 0}))


@_query(
    """
    WITH m AS (SELECT user_id, event_id AS vid, round(value, 2) AS v FROM events WHERE event_id < 5000),
    new AS (SELECT DISTINCT user_id, 1.5 AS n FROM events WHERE user_id < 20),
    old AS (SELECT user_id, max_by(v, vid) AS o FROM m WHERE vid < 300 GROUP BY 1)
    SELECT user_id, vid, round(v, 2) AS v FROM m WHERE NOT (vid = 300 AND user_id < 20)
    UNION ALL SELECT user_id, 300, round(CASE WHEN o IS NULL THEN n ELSE o + n END, 2) FROM new LEFT JOIN old USING (user_id)
    """
)
def version_upsert_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    m = events.where("event_id < 5000").select("user_id", c("event_id").alias("vid"), F.round("value", 2).alias("v"))
    new = events.where("user_id < 20").select("user_id", F.lit(1.5).alias("v")).distinct()
    out = K.upsert_before(m, new, ["user_id"], 300, "v", c("new.v"), c("old.v") + c("new.v"))
    return out.select("user_id", "vid", F.round("v", 2).alias("v"))


@_query(
    """
    SELECT event_id AS seq, event_type AS tag, user_id FROM events
    UNION ALL SELECT e.last + 1 + c_custkey, 'new', c_custkey FROM customer, (SELECT max(event_id) AS last FROM events) e
    """
)
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customers,) = load(spark, sf_dir, "customer")
    return K.log_append(_log(spark, sf_dir), customers.select(c("c_custkey").alias("seq"), c("c_custkey").alias("user_id")), "new")


@_query("SELECT event_id AS seq, event_type AS tag, user_id FROM events WHERE event_id IN (0, 11) UNION ALL SELECT -5, 'none', 0")
def log_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    missing = K.at(log, -5, "seq", {"tag": "none", "user_id": 0})
    return K.at(log, 0, "seq").unionByName(K.at(log, 11, "seq")).unionByName(missing)


@_query("SELECT event_id AS seq, user_id FROM events WHERE event_type = 'error' AND event_id BETWEEN 100 AND 400")
def log_of_a_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.filter_rows(K.slice_of(_log(spark, sf_dir), tag="error"), c("seq").between(100, 400)).select("seq", "user_id")


@_query(_WITH + 'SELECT b AS "B", CAST(sum(coalesce(m, 100)) AS BIGINT) AS value FROM r LEFT JOIN (SELECT b, sum(c) AS m FROM s WHERE c > 8 GROUP BY b) USING (b) GROUP BY b')
def calc_look_up_with_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return r.look_up(s.where("C > 8").times(c("C")).sum(["B"]), F.lit(100)).sum(["B"]).frame()


@_query(
    _WITH
    + """
    SELECT b, c, count(*) AS v FROM s WHERE b NOT IN (SELECT b FROM r WHERE a = 1) GROUP BY 1, 2
    UNION ALL SELECT b, CAST(-1 AS BIGINT), CAST(a AS BIGINT) FROM r WHERE a = 1
    """
)
def view_replaced_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``:=`` on the slices of some keys: what stood there gives way."""
    r, s, _ = relations(spark, sf_dir)
    new = r.where("a = 1").select("b", F.lit(-1).cast("long").alias("c"), c("a").cast("long").alias("v"))
    return W.replace_slice(s.groupBy("b", "c").agg(F.count("*").alias("v")), new, ["b"])


# Scalars


@_query("SELECT count(DISTINCT event_id) AS n, count(DISTINCT (event_type, user_id)) AS pairs, true AS same FROM events")
def scalar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes tell values apart as the values do, and do not change."""
    (events,) = load(spark, sf_dir, "events")
    return events.agg(
        F.countDistinct(S.hash_value("event_id")).alias("n"),
        F.countDistinct(S.hash_value("event_type", "user_id")).alias("pairs"),
        F.bool_and(S.hash_value("event_id") == S.hash_value("event_id")).alias("same"),
    )


@_query(
    """
    SELECT event_id, CAST(1073741824 AS BIGINT) AS most, CAST(event_id AS DOUBLE) AS x, CAST(trunc(value - 50) AS BIGINT) AS whole,
      CAST(event_id AS VARCHAR) AS text, event_id + 1 AS parsed, round(pow(value / 10, 3), 6) AS cube, round(degrees(value / 100), 6) AS angle,
      strftime(ts, '%Y-%m-%d') AS day, true AS later
    FROM events
    """
)
def scalar_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    text = S.to_text("event_id")
    day = F.concat(F.year("ts"), F.lit("-"), F.month("ts"), F.lit("-"), F.dayofmonth("ts"))
    return events.select(
        "event_id",
        F.lit(S.MAX_INT).cast("long").alias("most"),
        S.to_float("event_id").alias("x"),
        S.to_int(c("value") - 50).alias("whole"),
        text.alias("text"),
        (S.to_int(text) + 1).alias("parsed"),
        F.round(S.call("pow", c("value") / 10, F.lit(3)), 6).alias("cube"),
        F.round(S.call("degrees", c("value") / 100), 6).alias("angle"),
        F.date_format(S.parse_date(day), "yyyy-MM-dd").alias("day"),
        (S.now_ms() > 1_700_000_000_000).alias("later"),
    )


@_query("""
    SELECT CAST(9007199254740993 + event_id AS BIGINT) AS big, CAST((9007199254740993 + event_id) // 3 AS BIGINT) AS third, CAST(-event_id // 1 AS BIGINT) AS below
    FROM events
    """)
def scalar_divide_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    big = F.lit(9007199254740993) + c("event_id")
    return events.select(big.alias("big"), S.divide_int(big, 3).alias("third"), S.divide_int(-c("event_id"), 1).alias("below"))


@_query("""
    SELECT event_id, CAST(event_id * 2 + 1 AS BIGINT) AS a, CAST(event_id + user_id AS BIGINT) AS b, round(CAST(event_id AS DOUBLE) / 4, 6) AS q
    FROM events
    """)
def scalar_user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a user's own, with types and one name for one and for two arguments."""
    (events,) = load(spark, sf_dir, "events")
    with S.scope():
        S.register("mine", lambda x: x * 2 + 1, takes=["long"], returns="long")
        S.register("mine", lambda x, y: x + y, takes=["long", "long"], returns="long")
        S.register("quarter", lambda x: x / 4, takes=["double"], returns="double")
        return events.select(
            "event_id", S.call("mine", c("event_id")).alias("a"), S.call("mine", "event_id", "user_id").alias("b"), F.round(S.call("quarter", "event_id"), 6).alias("q")
        )


@_query(
    """
    SELECT p_partkey AS k, CASE WHEN p_type LIKE 'S%' OR p_type LIKE 'E%' THEN 1 ELSE 0 END AS se,
      CASE WHEN concat('(', p_brand, ')|x') LIKE '(Brand#1%' THEN 1 ELSE 0 END AS bare
    FROM part
    """
)
def scalar_regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns whose operators are escaped; bare parentheses and bars stand for themselves."""
    (parts,) = load(spark, sf_dir, "part")
    return parts.select(
        c("p_partkey").alias("k"),
        S.regex_match(r"\(S\|E\)", "p_type", escaped_operators=True).alias("se"),
        S.regex_match(r"(Brand#1[0-9]*)|x$", F.concat(F.lit("("), c("p_brand"), F.lit(")|x")), escaped_operators=True).alias("bare"),
    )
