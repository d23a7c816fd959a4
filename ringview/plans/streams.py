"""Queries that drive maintained views from streams: batches in any order, replays, compaction, late versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deltas as D
from ..operators.gmr import Gmr
from ..sources import adaptors as A
from ..streaming import views as W
from .common import load, register, shared_path
from .views import _book, _BOOK, _volume_above

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_query = register(QUERIES, ORACLE_SQL)
c = F.col


@_query(
    """
    SELECT o_orderpriority AS p, round(sum(l_quantity), 2) AS value, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' GROUP BY 1
    """
)
def stream_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join view over a stream of files: bootstrapped, maintained batch by batch, base relations compacted, the last batch replayed."""
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    path, schemas = shared_path(spark, "stream-of-changes"), {"orders": ["ok", "pr"], "lines": ["ok", "q"]}
    order = lambda df: df.select(F.lit("orders").alias("rel"), F.lit(1).alias("op"), c("o_orderkey").alias("ok"), c("o_orderpriority").alias("pr"), F.lit(0.0).alias("q"))
    line = lambda df, op: df.select(F.lit("lines").alias("rel"), F.lit(op).alias("op"), c("l_orderkey").alias("ok"), F.lit("").alias("pr"), c("l_quantity").alias("q"))
    first = orders.where("o_orderkey % 2 = 0")
    batches = [line(lines, 1), order(orders.where("o_orderkey % 2 = 1")), line(lines.where("l_returnflag = 'R'"), -1)]
    for k, batch in enumerate(batches):
        A.write(batch, f"{path}/in/{k}")
    none = Gmr.scan(lines.limit(0), {"l_orderkey": "ok", "l_quantity": "q"})
    base = W.start(f"{path}/base", spark, schemas, {"orders": Gmr.scan(first, {"o_orderkey": "ok", "o_orderpriority": "pr"}), "lines": none})
    definition = D.rel("orders", ok="k", pr="P") * D.rel("lines", ok="k", q="Q")
    view = W.View(W.ViewLog(spark, f"{path}/view", ("P",)), definition, lambda: c("Q"))
    view.bootstrap(base.relations(1))
    kinds = "rel string, op int, ok long, pr string, q double"
    source = A.read_delimited(spark, f"{path}/in/*", kinds, stream=True, files_per_batch=4)
    query = W.stream(source, base, {"sold": view}, schemas, f"{path}/state", compact_every=1)
    query.awaitTermination()
    last = max(v for kind, v, _ in view.log._folders()[1] if kind == "vid")
    view.log.compact(max(last - 1, 0))
    return view.log.as_of().select(c("P").alias("p"), F.round("__v", 2).alias("value"), c("__n").alias("n"))


@_query("SELECT event_type AS kind, round(sum(value), 2) AS value, count(*) AS n FROM events WHERE event_id % 6 <= 4 GROUP BY 1")
def stream_late_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that come out of order and twice, older ones compacted between; read as of the one before the last."""
    (events,) = load(spark, sf_dir, "events")
    log = W.ViewLog(spark, shared_path(spark, "late-versions"), ("kind",))
    part = lambda v: events.where(c("event_id") % 6 == v).select(c("event_type").alias("kind"), c("value").alias("__v"), F.lit(1).cast("long").alias("__n"))
    for v in (3, 1, 5, 0, 3):
        log.write(v, part(v))
    log.compact(1)
    for v in (4, 2, 4):
        log.write(v, part(v))
    log.compact(2)
    return log.as_of(4).select("kind", F.round("__v", 2).alias("value"), c("__n").alias("n"))


_QUARTER = "0.25 * (SELECT coalesce(sum(volume), 0) FROM {0}) > (SELECT coalesce(sum(x.volume), 0) FROM {0} x WHERE x.price > {1}.price)"


@_query(
    _BOOK
    + f"""
    SELECT b.broker, round(CAST(n AS DOUBLE) * (SELECT coalesce(sum(a.price * a.volume), 0) FROM asks a WHERE {_QUARTER.format("asks", "a")})
      - w * (SELECT count(*) FROM asks), 0) AS value
    FROM (SELECT broker, count(*) AS n FROM bids GROUP BY 1) b
    JOIN (SELECT broker, sum(price * volume) AS w FROM bids b WHERE {_QUARTER.format("bids", "b")} GROUP BY 1) t ON b.broker = t.broker
    """
)
def finance_missed_trades_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed trades with sums of the top quarter of each side: one row for a side's total, sums by broker, no pairs."""
    bids, asks = _book(spark, sf_dir)

    def top(side: DataFrame) -> DataFrame:
        total = F.broadcast(side.agg((0.25 * F.coalesce(F.sum("volume"), F.lit(0.0))).alias("quarter")))
        return side.join(_volume_above(side), "price").join(total).where("quarter > above")

    worth = F.sum(c("price") * c("volume"))
    all_asks = asks.agg(F.count("*").alias("cnt")).join(F.broadcast(top(asks).agg(F.coalesce(worth, F.lit(0.0)).alias("a"))))
    brokers = bids.groupBy("broker").agg(F.count("*").alias("n")).join(top(bids).groupBy("broker").agg(worth.alias("w")), "broker")
    return brokers.join(F.broadcast(all_asks)).select("broker", F.round(c("n") * c("a") - c("w") * c("cnt"), 0).alias("value"))
