"""Queries that go through the sources and sinks: tables are written as files of each kind, whole, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deltas as D
from ..operators.gmr import Gmr
from ..sources import adaptors as A
from ..streaming import views as W
from .common import load, register, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_query = register(QUERIES, ORACLE_SQL)
c = F.col


@_query(
    """
    SELECT CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS op, o_orderkey AS k, round(o_totalprice, 4) AS price,
      strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders
    """
)
def source_delimited_with_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    path = shared_path(spark, "delimited")
    flag = (c("o_orderstatus") == "F").cast("int").alias("flag")
    A.write(orders.select(flag, "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), path)
    read = A.read_delimited(spark, path, "k long, price double, day date", deletions=True)
    return read.select("op", "k", F.round("price", 4).alias("price"), c("day").cast("string").alias("day"))


@_query("SELECT event_id AS k, event_type AS kind, round(value, 6) AS value FROM events")
def source_stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as a stream, until all of them are read."""
    (events,) = load(spark, sf_dir, "events")
    path = shared_path(spark, "stream")
    A.write(events.select("event_id", "event_type", "value"), f"{path}/in")
    source = A.read_delimited(spark, f"{path}/in", "k long, kind string, value double", stream=True)
    sink = source.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k long, kind string, value double").parquet(f"{path}/out").select("k", "kind", F.round("value", 6).alias("value"))


@_query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def source_static_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customers,) = load(spark, sf_dir, "customer")
    path = shared_path(spark, "static")
    A.write(customers.select("c_mktsegment", "c_nationkey"), path)
    return A.static_table(spark, path, "segment string, nation int")


@_query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def source_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    (nations,) = load(spark, sf_dir, "nation")
    path = shared_path(spark, "fixed-width")
    line = F.concat(F.lpad(c("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 16, " "), F.lpad(c("n_regionkey").cast("string"), 3, " "))
    nations.select(line.alias("value")).write.text(path)
    return A.read_fixed_width(spark, path, [("k", 4, "int"), ("name", 16, "string"), ("region", 3, "int")])


@_query("SELECT event_id, event_type, round(value, 6) AS value, CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS even FROM events")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is missing takes its type's zero."""
    (events,) = load(spark, sf_dir, "events")
    path = shared_path(spark, "json")
    A.write(events.select("event_id", "event_type", "value", F.when(c("user_id") % 2 == 0, c("user_id")).alias("even")), path, "json")
    read = A.read_json(spark, path, "event_id long, event_type string, value double, even long")
    return read.select("event_id", "event_type", F.round("value", 6).alias("value"), "even")


@_query("SELECT 'csv' AS kind, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 'parquet', s_suppkey, s_name FROM supplier")
def sink_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    (suppliers,) = load(spark, sf_dir, "supplier")
    path, rows = shared_path(spark, "sinks"), suppliers.select(c("s_suppkey").alias("k"), c("s_name").alias("name"))
    A.write(rows, f"{path}/csv")
    A.write(rows, f"{path}/parquet", "parquet")
    back = A.read_delimited(spark, f"{path}/csv", "k long, name string").withColumn("kind", F.lit("csv"))
    return back.unionByName(spark.read.parquet(f"{path}/parquet").withColumn("kind", F.lit("parquet"))).select("kind", "k", "name")


_MESSAGES = """WITH m AS (SELECT event_id AS id, event_id % 4 AS k, CAST(event_id AS DOUBLE) AS t, round(abs(value) + 1, 2) AS volume, round(abs(value), 2) AS price FROM events),
placed AS (SELECT * FROM m WHERE k < 2)
"""


@_query(
    _MESSAGES
    + """
    SELECT CASE k WHEN 0 THEN 'bids' ELSE 'asks' END AS book, 1 AS op, t, id, id % 10 AS broker_id, volume, price FROM placed
    UNION ALL SELECT 'bids', -1, m.t, p.id, p.id % 10, p.volume, p.price FROM m JOIN placed p ON p.id = m.id - 2 WHERE m.k = 2
    UNION ALL SELECT 'asks', -1, m.t, p.id, p.id % 10, m.volume, p.price FROM m JOIN placed p ON p.id = m.id - 2 WHERE m.k = 3
    """
)
def source_order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of an exchange made from events: bids and asks in turn, a deletion of the bid and an execution on the ask two before."""
    (events,) = load(spark, sf_dir, "events")
    kind = c("event_id") % 4
    messages = events.select(
        c("event_id").cast("double").alias("t"),
        (c("event_id") - F.when(kind < 2, 0).otherwise(2)).alias("id"),
        F.element_at(F.array(*map(F.lit, "BSDE")), (kind + 1).cast("int")).alias("action"),
        F.round(F.abs("value") + 1, 2).alias("volume"),
        F.round(F.abs("value"), 2).alias("price"),
    )
    books = A.order_book(messages)
    return books[0].withColumn("book", F.lit("bids")).unionByName(books[1].withColumn("book", F.lit("asks"))).select("book", "op", "t", "id", "broker_id", "volume", "price")


@_query("SELECT * FROM (VALUES (1, 'one', 1.5), (2, 'two', 2.5), (2, 'two', 2.5)) AS t(k, name, x)")
def source_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.constant(spark, [(1, "one", 1.5), (2, "two", 2.5), (2, "two", 2.5)], "k int, name string, x double")


@_query("SELECT 1000 AS n, 1000 AS in_range, 1000 AS again, 2000 AS other")
def source_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows, how many of them within bounds, and how many are distinct with the rows of the same and of another seed."""
    schema = "a long, b double, s string, d date, f boolean"
    rows, same, other = (A.random_rows(spark, 1000, schema, seed) for seed in (7, 7, 8))
    ok = (c("b") >= 0) & (c("b") < 1) & (c("a") >= 0) & c("d").between("2000-01-01", "2010-01-01") & (F.length("s") > 0) & c("f").isNotNull()
    counts = [rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("in_range")), rows.union(same).distinct().agg(F.count("*").alias("again")), rows.union(other).distinct().agg(F.count("*").alias("other"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2])).select(*[c(x).cast("int").alias(x) for x in ("n", "in_range", "again", "other")])


@_query(
    """
    SELECT 'sequence' AS pattern, 0 AS source, n_name AS name FROM nation UNION ALL SELECT 'sequence', 1, r_name FROM region
    UNION ALL SELECT 'choice', 0, r_name FROM region UNION ALL SELECT 'repeat', CAST(range AS INT), r_name FROM region, range(3)
    """
)
def source_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = load(spark, sf_dir, "nation", "region")
    a, b = nations.select(c("n_name").alias("name")), regions.select(c("r_name").alias("name"))
    parts = [
        A.in_sequence(a, b).select(F.lit("sequence").alias("pattern"), "source", "name"),
        A.first_available(spark, a.where("name IS NULL"), b).select(F.lit("choice").alias("pattern"), F.lit(0).alias("source"), "name"),
        A.repeated(b, 3).select(F.lit("repeat").alias("pattern"), c("round").alias("source"), "name"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(
    """
    SELECT 'orders' AS mux, count(*) AS n, CAST(0 AS BIGINT) AS late FROM orders UNION ALL SELECT 'customer', count(*), 0 FROM customer
    UNION ALL SELECT 'sentry', 1, 0
    """
)
def source_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each relation in the agenda, and how many come before an earlier row of theirs, or after the last row."""
    orders, customers = load(spark, sf_dir, "orders", "customer")
    wide = A.multiplex({"orders": orders, "customer": customers}, {"orders": "o_orderkey", "customer": "c_custkey"}, seed=5, sentry=True)
    key = F.coalesce("o_orderkey", "c_custkey", F.lit(0))
    bounds = wide.groupBy("mux", F.floor(key / 256).alias("part")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.corr(key, "seq").alias("r"))
    following = bounds.select("mux", (c("part") - 1).alias("part"), c("first").alias("next"))
    end = F.broadcast(wide.where("mux = 'sentry'").select(c("seq").alias("end")))
    late = (c("last") > c("next")) | (c("r") < 0.5) | ((c("mux") != "sentry") & (c("last") >= c("end")))
    return bounds.join(following, ["mux", "part"], "left").join(end).groupBy("mux").agg(F.sum("n").alias("n"), F.count_if(F.coalesce(late, F.lit(False))).alias("late"))


@_query(
    """
    SELECT o_orderpriority AS p, round(sum(l_quantity), 2) AS value, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
    """
)
def source_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view loaded from its definition over whole relations, at version 0."""
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    env = {"orders": Gmr.scan(orders, {"o_orderkey": "k", "o_orderpriority": "P"}), "lines": Gmr.scan(lines, {"l_orderkey": "k", "l_quantity": "Q"})}
    definition = D.rel("orders", "k", "P") * D.rel("lines", "k", "Q")
    view = W.View(W.ViewLog(spark, shared_path(spark, "warm-up"), ("P",)), definition, lambda: c("Q"))
    view.bootstrap(env)
    return view.log.as_of(0).select(c("P").alias("p"), F.round("__v", 2).alias("value"), c("__n").alias("n"))
