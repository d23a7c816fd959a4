"""Queries of the view engine: the relation algebra, maintained views, collections, scalars, sources and geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collections as K
from ..operators import deltas as D
from ..operators.gmr import Gmr, V, constant, on_demand, product
from ..operators.ordered import running_sums, sums_before
from ..sources import adaptors as A
from ..streaming import views as W
from .common import load, shared_path
from .features import _WITH, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _gmrs(spark: SparkSession, sf_dir: str) -> tuple[Gmr, Gmr, Gmr]:
    r, s, t = relations(spark, sf_dir)
    return Gmr.scan(r, {"a": "A", "b": "B"}), Gmr.scan(s, {"b": "B", "c": "C"}), Gmr.scan(t, {"c": "C", "d": "D"})


# The relation algebra


@_query(_WITH + "SELECT b AS \"B\", CAST(sum(a * c) AS BIGINT) AS value FROM r JOIN s USING (b) WHERE a < c GROUP BY b")
def calc_product_where_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return (r * s).where("A < C").times(c("A") * c("C")).sum(["B"]).frame()


@_query(_WITH + "SELECT CAST(count(*) AS BIGINT) AS value FROM r WHERE a = b")
def calc_repeated_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, _ = relations(spark, sf_dir)
    return Gmr.scan(r, [("a", "X"), ("b", "X")]).sum().frame()


@_query(_WITH + """
    SELECT b AS "B", CAST(sum(v) AS BIGINT) AS value FROM (SELECT b, 1 AS v FROM r UNION ALL SELECT b, 1 FROM s
    UNION ALL SELECT b, -1 FROM s WHERE c > 5) GROUP BY b
    """)
def calc_sum_and_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return (r.sum(["B"]) + s.sum(["B"]) - s.where("C > 5").sum(["B"])).sum(["B"]).frame()


@_query(_WITH + "SELECT m AS \"M\", count(*) AS value FROM (SELECT b, count(*) AS m FROM s GROUP BY b) GROUP BY m")
def calc_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _gmrs(spark, sf_dir)
    return s.sum(["B"]).lift("M").sum(["M"]).frame()


@_query(_WITH + "SELECT b AS \"B\", CAST(count(*) AS BIGINT) AS value FROM s WHERE c = b GROUP BY b")
def calc_lift_of_a_bound_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _gmrs(spark, sf_dir)
    return s.lift("C", c("B")).sum(["B"]).frame()


@_query(_WITH + "SELECT count(*) AS value FROM (SELECT DISTINCT b, c FROM s)")
def calc_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _gmrs(spark, sf_dir)
    return s.exists().sum().frame()


@_query(_WITH + "SELECT b AS \"B\", count(*) AS value FROM r WHERE b NOT IN (SELECT b FROM s WHERE c > 7) GROUP BY b")
def calc_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return s.where("C > 7").sum(["B"]).absent(r).sum(["B"]).frame()


@_query(_WITH + """
    SELECT b AS "B", CAST(sum(coalesce(m, 0)) AS BIGINT) AS value FROM r LEFT JOIN (SELECT b, sum(c) AS m FROM s WHERE c > 8
    GROUP BY b) USING (b) GROUP BY b
    """)
def calc_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return r.look_up(s.where("C > 8").times(c("C")).sum(["B"])).sum(["B"]).frame()


@_query(_WITH + "SELECT b AS \"B\", CAST(sum(c) AS BIGINT) AS value FROM s WHERE b IN (SELECT b FROM r WHERE a = 2) GROUP BY b")
def calc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _gmrs(spark, sf_dir)
    return s.times(c("C")).sum(["B"]).slice(r.where("A = 2")).frame()


@_query(_WITH + """
    SELECT x AS "X", CAST((SELECT coalesce(sum(c), 0) FROM s WHERE c < x) AS BIGINT) AS value FROM (SELECT DISTINCT a AS x
    FROM r)
    """)
def calc_view_with_an_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view asked for with input values: sums by C first, then one running sum over the values of C and X."""
    r, s, _ = _gmrs(spark, sf_dir)
    below = s.times(c("C")).sum(["C"]).df.select(c("C").alias("X"), c(V).alias("v"))
    asked = r.lift("X", c("A")).exists().sum(["X"]).exists()
    found = on_demand(lambda x: Gmr(sums_before(x.df, below, "X", "v").select("X", c("v").alias(V)), ("X",)), asked)
    return asked.look_up(found).frame().withColumn("value", c("value").cast("long"))


@_query(_WITH + "SELECT CAST(3 * count(*) AS BIGINT) AS value FROM r, s, t WHERE r.b = s.b AND s.c = t.c")
def calc_three_way_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, t = _gmrs(spark, sf_dir)
    return product(r.sum(["B"]), s.sum(["B", "C"]), t.sum(["C"]), constant(r.df, 3)).sum().frame()


# Maintained views


def _sold() -> D.Expr:
    orders, lines = D.rel("orders", ok="k", pr="P"), D.rel("lines", ok="k", q="Q")
    return orders * lines


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    return orders.select(c("o_orderkey").alias("ok"), c("o_orderpriority").alias("pr")), lines.select(c("l_orderkey").alias("ok"), c("l_quantity").alias("q"), "l_returnflag")


@_query("""
    SELECT o_orderpriority AS "P", round(sum(l_quantity), 2) AS value, count(*) AS n FROM orders
    JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' GROUP BY 1
    """)
def view_after_inserts_and_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each table first, then all the rest as inserts with the returned lines as deletes: old view and change add up to the definition."""
    orders, lines = _tables(spark, sf_dir)
    early = orders.where("pr < '3'")
    as_gmr = lambda df, cols, v=1: Gmr.scan(df, {x: x for x in cols}, F.lit(v))
    env = {"orders": as_gmr(early, ["ok", "pr"]), "lines": as_gmr(lines, ["ok", "q"])}
    changes = {"orders": as_gmr(orders.where("NOT pr < '3'"), ["ok", "pr"]), "lines": as_gmr(lines.where("l_returnflag = 'R'"), ["ok", "q"], -1)}
    n, total = D.count_and_sum(_sold(), ["P"], c("Q"))
    counts, sums = n.after(env, changes).sum(["P"]), total.after(env, changes).sum(["P"])
    return counts.frame("n").join(sums.frame("v"), "P").where("n <> 0").select("P", F.round("v", 2).alias("value"), "n")


@_query("SELECT CAST(count(*) AS BIGINT) AS value FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)")
def view_exists_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = _tables(spark, sf_dir)
    rows = Gmr.scan(lines, {"ok": "ok"})
    gone = Gmr.scan(lines.where("l_returnflag = 'R'"), {"ok": "ok"}, F.lit(-1))
    return D.Sum(D.Exists(D.Sum(D.rel("lines", "ok"), ("ok",)))).after({"lines": rows}, {"lines": gone}).sum().frame()


@_query("SELECT m AS \"M\", CAST(count(*) AS BIGINT) AS value FROM (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) GROUP BY 1")
def view_lift_after_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    old = Gmr.scan(orders.where("o_orderstatus = 'F'"), {"o_custkey": "k"})
    new = Gmr.scan(orders.where("o_orderstatus <> 'F'"), {"o_custkey": "k"})
    counted = D.Sum(D.Lift(D.Sum(D.rel("orders", "k"), ("k",)), "M"), ("M",))
    return counted.after({"orders": old}, {"orders": new}).sum(["M"]).pruned().frame()


@_query("""
    SELECT o_orderpriority AS "P", round(sum(l_quantity), 2) AS value, count(*) AS n FROM orders
    JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'R' GROUP BY 1
    """)
def view_log_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maintained view over change batches: all lines, then the finished orders, then the returned lines as deletes, then the other orders; read as of the third."""
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    schemas = {"orders": ["ok", "pr"], "lines": ["ok", "q"]}
    row = lambda df, rel, op, ok, pr, q: df.select(F.lit(rel).alias("rel"), F.lit(op).alias("op"), c(ok).alias("ok"), pr.alias("pr"), q.alias("q"))
    line = lambda df, op: row(df, "lines", op, "l_orderkey", F.lit(None).cast("string"), c("l_quantity"))
    order = lambda df: row(df, "orders", 1, "o_orderkey", c("o_orderpriority"), F.lit(None).cast("double"))
    batches = [line(lines, 1), order(orders.where("o_orderstatus = 'F'")), line(lines.where("l_returnflag = 'R'"), -1), order(orders.where("o_orderstatus <> 'F'"))]
    path = shared_path(spark, "view-log")
    empty = {k: Gmr(batches[0].limit(0).select(*cols, F.lit(1).cast("long").alias("__v")), tuple(cols)) for k, cols in schemas.items()}
    base = W.start(f"{path}/base", spark, schemas, empty)
    view = W.View(W.ViewLog(spark, f"{path}/view", ("P",)), _sold(), lambda: c("Q"))
    for vid, batch in enumerate(batches, 1):
        W.maintain(base, {"sold": view}, schemas, batch, vid)
    return view.log.as_of(3).select("P", F.round("__v", 2).alias("value"), c("__n").alias("n"))


@_query("""
    SELECT user_id, event_type, round(max_by(value, event_id), 4) AS value, max(event_id) AS vid FROM events
    WHERE event_id < 5000 GROUP BY 1, 2
    """)
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    log = events.select("user_id", "event_type", c("event_id").alias("vid"), "value")
    return K.as_of(log, ["user_id", "event_type"], 5000).select("user_id", "event_type", F.round("value", 4).alias("value"), "vid")


@_query("""
    SELECT user_id, event_id AS vid FROM events e WHERE event_id > 5000 OR event_id = (SELECT max(event_id) FROM events x
    WHERE x.user_id = e.user_id AND x.event_id <= 5000)
    """)
def version_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return K.delete_prefix(events.select("user_id", c("event_id").alias("vid")), ["user_id"], 5000)


@_query("""
    SELECT user_id, count(*) AS versions, round(sum(CASE WHEN event_id > 5000 AND user_id < 50 THEN 2 * value ELSE value END), 4) AS total
    FROM events GROUP BY 1
    """)
def version_update_suffix_and_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    log = events.select("user_id", c("event_id").alias("vid"), "value")
    changed = K.update_suffix(log, c("user_id") < 50, 5000, "value", 2 * c("value"))
    return K.fold_versions(changed, ["user_id"], versions=F.count("*"), total=F.round(F.sum("value"), 4))


@_query("""
    SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n
    FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS batch
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) GROUP BY 1, 2
    """)
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return W.runs(events, "event_id", ["event_type"], group=["user_id"]).groupBy("user_id", "batch").agg(F.count("*").alias("n"))


# Collections


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first FROM events GROUP BY 1")
def coll_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return K.group_by(events, ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 4), first=F.min("event_id"))


@_query("SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY 1")
def coll_fold_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    step = lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit(">"), x))
    return K.fold_in_order(events, ["user_id"], "event_id", "event_type", F.lit(""), step, "path")


@_query("SELECT k, count(*) AS n FROM (SELECT unnest(string_split(c_name, '#')) AS k FROM customer) WHERE k NOT LIKE '0%' GROUP BY 1")
def coll_map_flatten_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customers,) = load(spark, sf_dir, "customer")
    parts = K.flatten(K.map_rows(customers, F.split("c_name", "#").alias("k")), "k")
    return K.group_by(K.filter_rows(parts, ~c("k").like("0%")), ["k"], n=F.count("*"))


@_query("""
    SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, -1
    FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    """)
def coll_combine_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, suppliers = load(spark, sf_dir, "nation", "supplier")
    left = nations.select(c("n_nationkey").alias("k"), F.lit(-1).cast("long").alias("n"))
    return K.combine(left, suppliers.groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("n")), "map", ["k"])


@_query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def coll_combine_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = load(spark, sf_dir, "supplier", "customer")
    return K.combine(suppliers.select(c("s_nationkey").alias("k")), customers.select(c("c_nationkey").alias("k")), "set")


@_query("""
    SELECT user_id, event_id, round(value, 4) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 4000)
    WHERE k = 1
    """)
def coll_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return K.nearest(events.select("user_id", "event_id", "value"), "event_id", 4000, "leq", ["user_id"]).select("user_id", "event_id", F.round("value", 4).alias("value"))


@_query("SELECT min(event_id) AS event_id, event_type FROM events WHERE event_id >= 9000 GROUP BY event_type")
def coll_beyond_and_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return K.min_entry(K.beyond(events.select("event_type", "event_id"), "event_id", 9000, "geq"), "event_id", ["event_type"])


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def coll_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    (nations,) = load(spark, sf_dir, "nation")
    return K.slice_of(nations, n_regionkey=2).select("n_nationkey", "n_name")


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def coll_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer", "orders")
    return K.members(orders.select(c("o_custkey").alias("c_custkey")), customers.select("c_custkey"), ["c_custkey"])


@_query("""
    SELECT b, c FROM (SELECT *, row_number() OVER (PARTITION BY b, c) AS k
    FROM (SELECT s_nationkey AS b, CAST(floor(s_acctbal / 1000) AS BIGINT) AS c FROM supplier)) WHERE NOT (b = 3 AND k = 1)
    """)
def coll_delete_one_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = relations(spark, sf_dir)
    return K.delete(s, s.where("b = 3").distinct())


@_query("""
    SELECT k, CAST(CASE WHEN o IS NULL THEN n WHEN n IS NULL THEN o ELSE o + n END AS BIGINT) AS v
    FROM (SELECT s_nationkey AS k, count(*) AS o FROM supplier WHERE s_acctbal > 0 GROUP BY 1) FULL
    JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) USING (k)
    """)
def coll_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = load(spark, sf_dir, "supplier", "customer")
    old = suppliers.where("s_acctbal > 0").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    new = customers.where("c_acctbal < 0").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return K.upsert(old, new, ["k"], "v", c("new.v"), c("old.v") + c("new.v"))


@_query("SELECT CAST(5 + 3 * range AS BIGINT) AS value FROM range(100)")
def coll_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.progression(spark, 5, 3, 100)


@_query("SELECT event_type AS tag, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def log_fold_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    log = events.select(c("event_id").alias("seq"), c("event_type").alias("tag"), "user_id")
    return K.log_fold(log, n=F.count("*"), last=F.max("seq"))


# Scalars


@_query("""SELECT event_id, CAST(event_id // 7 AS BIGINT) AS whole, CAST(event_id % 7 AS BIGINT) AS rest, CAST(abs(event_id - 5000) AS BIGINT) AS away, round(CASE WHEN event_id = 0 THEN 0 ELSE 1.0 / event_id END, 9) AS inverse,
CAST(greatest(event_id, 5000) AS BIGINT) AS most, substring(event_type, 1, 3) AS part, concat(event_type, '-', CAST(user_id AS VARCHAR)) AS joined, CASE WHEN regexp_matches(event_type, '^(?:c|p)') THEN 1 ELSE 0 END AS hit,
CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INT) AS code, round(radians(value), 9) AS angle FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    i = c("event_id")
    return events.select(
        "event_id",
        S.divide_int(i, 7).alias("whole"),
        S.modulo(i, F.lit(7)).cast("long").alias("rest"),
        S.absolute(i - 5000).alias("away"),
        F.round(S.reciprocal(i), 9).alias("inverse"),
        S.listmax(i, F.lit(5000)).cast("long").alias("most"),
        S.substring("event_type", 0, 3).alias("part"),
        S.concat("event_type", F.lit("-"), S.to_text("user_id")).alias("joined"),
        S.regex_match("c|p", "event_type").alias("hit"),
        S.date_code("ts").alias("code"),
        F.round(F.radians("value"), 9).alias("angle"),
    )


# Order books: bids and asks are the events of two types, brokers are users modulo ten

_BOOK = """WITH e AS (SELECT event_id AS id, event_type, CAST(user_id % 10 AS BIGINT) AS broker, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, round(value, 2) AS price FROM events),
bids AS (SELECT id, broker, volume, price FROM e WHERE event_type = (SELECT min(event_type) FROM e)), asks AS (SELECT id, broker, volume, price FROM e WHERE event_type = (SELECT max(event_type) FROM e))
"""


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (events,) = load(spark, sf_dir, "events")
    kinds = F.broadcast(events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high")))
    e = events.join(kinds).select(c("event_id").alias("id"), "event_type", "low", "high", (c("user_id") % 10).cast("long").alias("broker"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.round("value", 2).alias("price"))
    columns = ["id", "broker", "volume", "price"]
    return e.where("event_type = low").select(*columns), e.where("event_type = high").select(*columns)


def _volume_above(side: DataFrame) -> DataFrame:
    """``price`` and the volume at higher prices: sums by price, then a running sum over prices; 0 at the top."""
    by_price = side.groupBy("price").agg(F.sum("volume").alias("v"))
    return running_sums(by_price, "price", ["v"], descending=True).select("price", c("before_v").alias("above"))


@_query(_BOOK + """
    SELECT round(coalesce(sum(price * volume), 0), 2) AS value FROM bids b WHERE 0.25 * (SELECT coalesce(sum(volume), 0)
    FROM bids) > (SELECT coalesce(sum(x.volume), 0) FROM bids x WHERE x.price > b.price)
    """)
def finance_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids, _ = _book(spark, sf_dir)
    total = F.broadcast(bids.agg((0.25 * F.coalesce(F.sum("volume"), F.lit(0.0))).alias("quarter")))
    return bids.join(_volume_above(bids), "price").join(total).where("quarter > above").agg(F.round(F.coalesce(F.sum(c("price") * c("volume")), F.lit(0.0)), 2).alias("value"))


@_query(_BOOK + """
    SELECT b.broker, round(sum(a.volume - b.volume), 2) AS value FROM bids b, asks a
    WHERE b.broker = a.broker AND abs(CAST(round(a.price * 100) AS BIGINT) - CAST(round(b.price * 100) AS BIGINT)) > 1000
    GROUP BY 1
    """)
def finance_ax_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one broker more than 10 apart: all pairs less those within 10, by sums over price levels in cents."""
    bids, asks = _book(spark, sf_dir)
    cents = F.round(c("price") * 100).cast("long").alias("cents")
    zero = F.lit(0.0)
    sides = bids.select("broker", cents, F.lit(1).alias("nb"), c("volume").alias("vb"), F.lit(0).alias("na"), zero.alias("va")).unionByName(
        asks.select("broker", cents, F.lit(0).alias("nb"), zero.alias("vb"), F.lit(1).alias("na"), c("volume").alias("va"))
    )
    levels = sides.groupBy("broker", "cents").agg(*[F.sum(k).alias(k) for k in ("nb", "vb", "na", "va")])
    every, within = Window.partitionBy("broker"), Window.partitionBy("broker").orderBy("cents").rangeBetween(-1000, 1000)
    far = levels.select("broker", "nb", "vb", *[(F.sum(k).over(every) - F.sum(k).over(within)).alias(k) for k in ("na", "va")])
    return far.groupBy("broker").agg(F.sum(c("va") * c("nb") - c("vb") * c("na")).alias("v"), F.sum(c("na") * c("nb")).alias("k")).where("k > 0").select("broker", F.round("v", 2).alias("value"))


@_query(_BOOK + """
    SELECT x.broker, round(sum(x.volume * x.price - y.volume * y.price), 2) AS value FROM bids x, bids y
    WHERE x.broker = y.broker AND x.price < y.price GROUP BY 1
    """)
def finance_broker_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one broker's bids by price: ranks and counts stand for the pairs."""
    bids, _ = _book(spark, sf_dir)
    by = bids.groupBy("broker", "price").agg(F.count("*").alias("n"), F.sum(c("volume") * c("price")).alias("w"))
    w = Window.partitionBy("broker").orderBy("price")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ranked = by.select("broker", "w", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("lower"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("higher"))
    return ranked.groupBy("broker").agg(F.sum(c("w") * c("higher") - c("w") * c("lower")).alias("v"), F.sum("higher").alias("k")).where("k > 0").select("broker", F.round("v", 2).alias("value"))


@_query(_BOOK + """
    SELECT x.broker, round(sum(x.volume * x.price * y.volume * y.price * 0.5), 0) AS value FROM bids x, bids y
    WHERE x.broker = y.broker GROUP BY 1
    """)
def finance_broker_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids, _ = _book(spark, sf_dir)
    return bids.groupBy("broker").agg(F.sum(c("volume") * c("price")).alias("s")).select("broker", F.round(c("s") * c("s") * 0.5, 0).alias("value"))


_TOP = "(SELECT 0.0001 * coalesce(sum(volume), 0) FROM {0}) > (SELECT coalesce(sum(x.volume), 0) FROM {0} x WHERE x.price > {1}.price)"


def _top(side: DataFrame) -> DataFrame:
    total = F.broadcast(side.agg((0.0001 * F.coalesce(F.sum("volume"), F.lit(0.0))).alias("part")))
    return side.join(_volume_above(side), "price").join(total).where("part > above")


@_query(_BOOK + f"""
    SELECT round(coalesce(sum(a.price - b.price), 0), 2) AS value FROM bids b, asks a
    WHERE {_TOP.format('bids', 'b')} AND {_TOP.format('asks', 'a')}
    """)
def finance_price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids, asks = (_top(x).agg(F.count("*").alias("n"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("p")) for x in _book(spark, sf_dir))
    both = bids.select(c("n").alias("nb"), c("p").alias("pb")).join(F.broadcast(asks.select(c("n").alias("na"), c("p").alias("pa"))))
    return both.select(F.round(c("pa") * c("nb") - c("pb") * c("na"), 2).alias("value"))


@_query(_BOOK + f"""
    SELECT b.broker, round(sum(a.price * a.volume - b.price * b.volume), 2) AS value FROM bids b, asks a
    WHERE {_TOP.format('bids', 'b')} AND {_TOP.format('asks', 'a')} AND b.broker = a.broker GROUP BY 1
    """)
def finance_missed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda df, x: _top(df).groupBy("broker").agg(F.count("*").alias(f"n{x}"), F.sum(c("price") * c("volume")).alias(f"w{x}"))
    bids, asks = _book(spark, sf_dir)
    return by(bids, "b").join(by(asks, "a"), "broker").select("broker", F.round(c("wa") * c("nb") - c("wb") * c("na"), 2).alias("value"))


# Sources


@_query("""
    SELECT event, mux, count(*) AS n FROM (SELECT 1 AS event, 'orders' AS mux FROM orders UNION ALL SELECT 1, 'nation'
    FROM nation) GROUP BY 1, 2
    """)
def source_multiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, nations = load(spark, sf_dir, "orders", "nation")
    wide = A.multiplex({"orders": orders, "nation": nations}, {"orders": "o_orderkey", "nation": "n_nationkey"}, seed=3)
    back = A.demultiplex(wide, "ORDERS", {"k": "o_orderkey"}).select(c("op").alias("event"), F.lit("orders").alias("mux"))
    return back.unionByName(A.demultiplex(wide, "nation", {"k": "n_nationkey"}).select(c("op").alias("event"), F.lit("nation").alias("mux"))).groupBy("event", "mux").agg(F.count("*").alias("n"))
