"""Decision-support queries over orders, lines, parts, suppliers and customers.

Sums over nothing are 0, and results are bags without an order. Supplied parts are derived from the lines:
the least unit price as the cost and the quantity sold as what is available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import day, load, revenue, steady_sum, total

_PS = """ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS cost, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"""
QUERIES, ORACLE_SQL = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f"tpch_{f.__name__}"], ORACLE_SQL[f"tpch_{f.__name__}"] = f, sql
        return f

    return add


def supplied(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), F.sum("l_quantity").alias("qty")
    )


@_query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-01' GROUP BY 1, 2""")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = load(spark, sf_dir, "lineitem")
    return (
        lines.where(F.col("l_shipdate") <= day("1998-09-01"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(F.col("l_quantity"), "sum_qty"),
            total(F.col("l_extendedprice"), "sum_base"),
            total(revenue(), "sum_disc"),
            total(revenue() * (1 + F.col("l_tax")), "sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


@_query(f"""WITH {_PS}, o AS (SELECT ps.*, s_acctbal, s_name, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey FROM o JOIN part ON p_partkey = ps_partkey WHERE p_type LIKE '%O%' AND p_size >= 15
AND NOT EXISTS (SELECT 1 FROM o AS x WHERE x.ps_partkey = o.ps_partkey AND x.cost < o.cost)""")
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, nations, regions, parts = load(spark, sf_dir, "lineitem", "supplier", "nation", "region", "part")
    near = suppliers.join(nations.join(regions.where("r_name = 'EUROPE'"), F.col("r_regionkey") == F.col("n_regionkey")), F.col("n_nationkey") == F.col("s_nationkey"))
    offers = supplied(lines).join(near, F.col("s_suppkey") == F.col("ps_suppkey"))
    best = offers.groupBy("ps_partkey").agg(F.min("cost").alias("least"))
    return offers.join(best, "ps_partkey").where("cost = least").join(parts.where("p_type LIKE '%O%' AND p_size >= 15"), F.col("p_partkey") == F.col("ps_partkey")).select("s_acctbal", "s_name", "n_name", "p_partkey")


@_query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 2, 3""")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, lines = load(spark, sf_dir, "customer", "orders", "lineitem")
    mine = orders.where(F.col("o_orderdate") < day("1998-03-15")).join(customers.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"))
    return (
        lines.where(F.col("l_shipdate") > day("1998-03-15"))
        .join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
        .agg(total(revenue(), "revenue"))
    )


@_query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    quarter = orders.where((F.col("o_orderdate") >= day("1997-07-01")) & (F.col("o_orderdate") < day("1997-10-01")))
    return quarter.join(lines.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@_query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1""")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, lines, suppliers, nations, regions = load(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "region")
    asia = nations.join(regions.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sold = orders.where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1997-01-01"))).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    local = suppliers.join(asia, F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.join(local, F.col("l_suppkey") == F.col("s_suppkey")).join(sold, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name").agg(total(revenue(), "revenue"))


@_query("""SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24""")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = load(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01"))
    return lines.where(year & F.col("l_discount").between(0.049, 0.071) & (F.col("l_quantity") < 24)).agg(total(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@_query("""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
WHERE (a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1') GROUP BY 1, 2, 3""")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, lines, orders, customers, nations = load(spark, sf_dir, "supplier", "lineitem", "orders", "customer", "nation")
    two = nations.where(F.col("n_name").isin("NATION_1", "NATION_2")).select("n_nationkey", "n_name")
    sellers = suppliers.join(two.withColumnRenamed("n_name", "supp_nation"), F.col("s_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    buyers = customers.join(two.withColumnRenamed("n_name", "cust_nation"), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    bought = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    both = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where("supp_nation <> cust_nation").groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(total(revenue(), "revenue"))


@_query("""SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN b.n_name = 'NATION_1' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / greatest(1, sum(l_extendedprice * (1 - l_discount))), 6) AS share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation a ON a.n_nationkey = c_nationkey JOIN region ON r_regionkey = a.n_regionkey JOIN nation b ON b.n_nationkey = s_nationkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines, suppliers, orders, customers, nations, regions = load(spark, sf_dir, "part", "lineitem", "supplier", "orders", "customer", "nation", "region")
    here = nations.join(regions.where("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    buyers = customers.join(here, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    years = orders.where(F.col("o_orderdate").between(day("1995-01-01"), day("1997-12-31"))).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    sellers = suppliers.join(nations.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    sold = lines.join(parts.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(years, F.col("l_orderkey") == F.col("o_orderkey"))
    own = F.sum(F.when(F.col("n_name") == "NATION_1", revenue()).otherwise(0.0))
    return sold.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.round(own / F.greatest(F.lit(1.0), F.sum(revenue())), 6).alias("share"))


@_query(f"""WITH {_PS} SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - cost * l_quantity), 4) AS profit
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_type LIKE '%A%' GROUP BY 1, 2""")
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines, suppliers, orders, nations = load(spark, sf_dir, "part", "lineitem", "supplier", "orders", "nation")
    own = lines.join(parts.where("p_type LIKE '%A%'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    sellers = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = own.join(supplied(own), (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy("n_name", F.year("o_orderdate").alias("o_year")).agg(total(revenue() - F.col("cost") * F.col("l_quantity"), "profit"))


@_query("""SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 3, 4""")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, lines, nations = load(spark, sf_dir, "customer", "orders", "lineitem", "nation")
    quarter = orders.where((F.col("o_orderdate") >= day("1996-10-01")) & (F.col("o_orderdate") < day("1997-01-01")))
    lost = lines.where("l_returnflag = 'R'").join(quarter, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(revenue()).alias("r"))
    return lost.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "n_name", F.round("r", 4).alias("revenue"))


_Q11 = f"""WITH {_PS}, o AS (SELECT ps_partkey, cost * qty AS worth FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_1')"""


def _worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, nations = load(spark, sf_dir, "lineitem", "supplier", "nation")
    here = suppliers.join(nations.where("n_name = 'NATION_1'"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = lines.join(here, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return supplied(own).groupBy("ps_partkey").agg(F.sum(F.col("cost") * F.col("qty")).alias("w"))


@_query(f"""
    {_Q11} SELECT ps_partkey, round(sum(worth), 4) AS worth FROM o
    GROUP BY 1 HAVING sum(worth) > (SELECT coalesce(sum(worth), 0) * 0.001 FROM o)
    """)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_part = _worth(spark, sf_dir)
    limit = by_part.agg((F.coalesce(F.sum("w"), F.lit(0.0)) * 0.001).alias("least"))
    return by_part.join(F.broadcast(limit)).where("w > least").select("ps_partkey", F.round("w", 4).alias("worth"))


@_query(f"{_Q11} SELECT ps_partkey, round(sum(worth), 4) AS worth FROM o GROUP BY 1")
def q11a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worth(spark, sf_dir).select("ps_partkey", F.round("w", 4).alias("worth"))


@_query("""SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    year = lines.where(F.col("l_returnflag").isin("R", "A") & (F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return year.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_linestatus").agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("high"), F.sum(F.when(~urgent, 1).otherwise(0)).alias("low"))


@_query("""
    SELECT c_count, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
    JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY 1) GROUP BY 1
    """)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer", "orders")
    counts = orders.where("o_orderpriority NOT LIKE '%LOW%'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return counts.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_count").agg(F.count("*").alias("n"))


@_query("""SELECT round(100.0 * coalesce(sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 0) / greatest(1, coalesce(sum(l_extendedprice * (1 - l_discount)), 0)), 4) AS promo
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = load(spark, sf_dir, "lineitem", "part")
    month = lines.where((F.col("l_shipdate") >= day("1996-09-01")) & (F.col("l_shipdate") < day("1996-10-01"))).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    promo = F.coalesce(F.sum(F.when(F.col("p_type").like("PROMO%"), revenue()).otherwise(0.0)), F.lit(0.0))
    return month.agg(F.round(100.0 * promo / F.greatest(F.lit(1.0), F.coalesce(F.sum(revenue()), F.lit(0.0))), 4).alias("promo"))


@_query("""WITH r AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY 1)
SELECT s_suppkey, s_name, round(total, 4) AS total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE NOT EXISTS (SELECT 1 FROM r AS x WHERE x.total > r.total)""")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, lines = load(spark, sf_dir, "supplier", "lineitem")
    quarter = lines.where((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1997-04-01")))
    sums = quarter.groupBy("l_suppkey").agg(steady_sum(revenue()).alias("t"))
    most = sums.agg(F.max("t").alias("most"))
    return sums.join(F.broadcast(most)).where("t IS NULL OR t >= most").join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", F.round("t", 4).alias("total"))


@_query(f"""WITH {_PS} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS suppliers FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%'
AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, suppliers = load(spark, sf_dir, "lineitem", "part", "supplier")
    wanted = parts.where("p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%'").where(F.col("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    pairs = lines.select("l_partkey", "l_suppkey").join(suppliers.where("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return pairs.join(wanted, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("l_suppkey").alias("suppliers"))


def _below_average(lines: DataFrame, share: float) -> DataFrame:
    means = lines.groupBy(F.col("l_partkey").alias("k")).agg((share * F.avg("l_quantity")).alias("limit"))
    return lines.join(means, F.col("l_partkey") == F.col("k")).where("l_quantity < limit")


@_query("""SELECT round(coalesce(sum(l_extendedprice), 0) / 7.0, 4) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 25
AND l_quantity < (SELECT 0.4 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = load(spark, sf_dir, "lineitem", "part")
    own = lines.join(parts.where("p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return _below_average(own, 0.4).agg(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)) / 7.0, 4).alias("yearly"))


@_query("""SELECT round(coalesce(sum(l_extendedprice), 0), 4) AS total FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_quantity < 0.005 * (SELECT coalesce(sum(x.l_quantity), 0) FROM lineitem x WHERE x.l_partkey = p_partkey)""")
def q17a(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = load(spark, sf_dir, "lineitem", "part")
    sums = lines.groupBy(F.col("l_partkey").alias("k")).agg((0.005 * F.sum("l_quantity")).alias("limit"))
    own = lines.join(sums, F.col("l_partkey") == F.col("k")).where("l_quantity < limit")
    return own.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(total(F.col("l_extendedprice"), "total"))


@_query("""SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 4) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) GROUP BY 1, 2, 3, 4""")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, lines = load(spark, sf_dir, "customer", "orders", "lineitem")
    large = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 200")
    return large.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "c_custkey", "o_orderkey", "o_totalprice", F.round("q", 4).alias("qty"))


@_query("""SELECT c_custkey, round(sum(l_quantity), 4) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE (SELECT coalesce(sum(x.l_quantity), 0) FROM lineitem x WHERE x.l_orderkey = o_orderkey) > 150 GROUP BY 1""")
def q18a(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, lines = load(spark, sf_dir, "customer", "orders", "lineitem")
    large = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 150")
    return large.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(total(F.col("q"), "qty"))


@_query("""SELECT round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 4) AS revenue FROM lineitem, part WHERE
(p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR
(p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR
(p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = load(spark, sf_dir, "lineitem", "part")
    q, size, brand = F.col("l_quantity"), F.col("p_size"), F.col("p_brand")
    some = lambda b, low, high, most: (brand == b) & q.between(low, high) & size.between(1, most)
    match = some("Brand#12", 1, 11, 15) | some("Brand#23", 10, 20, 30) | some("Brand#34", 20, 30, 45)
    return lines.join(parts, (F.col("p_partkey") == F.col("l_partkey")) & match).agg(total(revenue(), "revenue"))


@_query(f"""WITH {_PS} SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%1%')
AND qty > (SELECT 0.5 * coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))""")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, suppliers, nations = load(spark, sf_dir, "lineitem", "part", "supplier", "nation")
    year = (F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01"))
    own = lines.join(parts.where("p_name LIKE '%1%'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    stock = own.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"), (0.5 * F.coalesce(F.sum(F.when(year, F.col("l_quantity"))), F.lit(0.0))).alias("half")).where("qty > half")
    here = suppliers.join(nations.where("n_name = 'NATION_3'"), F.col("s_nationkey") == F.col("n_nationkey"))
    return here.join(stock, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_name", "s_acctbal")


@_query("""SELECT s_name, count(*) AS waits FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND a.l_returnflag = 'R' AND n_name = 'NATION_4'
AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY 1""")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, lines, orders, nations = load(spark, sf_dir, "supplier", "lineitem", "orders", "nation")
    late = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    by_order = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(late).alias("c"), F.max(late).alias("d")).where("a <> b AND c = d")
    here = suppliers.join(nations.where("n_name = 'NATION_4'"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = lines.where("l_returnflag = 'R'").join(here, F.col("l_suppkey") == F.col("s_suppkey")).join(by_order, F.col("l_orderkey") == F.col("k"))
    return own.join(orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("s_name").agg(F.count("*").alias("waits"))


@_query("""WITH c AS (SELECT substring(c_name, 18, 1) AS code, c_custkey, c_acctbal FROM customer WHERE substring(c_name, 18, 1) IN ('1', '3', '5', '7', '9'))
SELECT code, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM c WHERE c_acctbal > (SELECT coalesce(avg(c_acctbal), 0) FROM c WHERE c_acctbal > 0)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1""")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer", "orders")
    coded = customers.withColumn("code", F.substring("c_name", 18, 1)).where(F.col("code").isin("1", "3", "5", "7", "9"))
    mean = coded.where("c_acctbal > 0").agg(F.coalesce(F.avg("c_acctbal"), F.lit(0.0)).alias("mean"))
    rich = coded.join(F.broadcast(mean)).where("c_acctbal > mean")
    return rich.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("code").agg(F.count("*").alias("customers"), total(F.col("c_acctbal"), "balance"))


@_query("""SELECT c_nationkey, round(sum(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal < (SELECT coalesce(sum(x.c_acctbal), 0) FROM customer x WHERE x.c_acctbal > 0)
AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) = 0 GROUP BY 1""")
def q22a(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer", "orders")
    limit = customers.where("c_acctbal > 0").agg(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)).alias("limit"))
    idle = customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").join(F.broadcast(limit)).where("c_acctbal < limit")
    return idle.groupBy("c_nationkey").agg(total(F.col("c_acctbal"), "balance"))
