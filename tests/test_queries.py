from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringview import plans
from ringview.plans.common import steady_sum

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return round(float(v), 3) if isinstance(v, float) else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_a_query_matches_its_sql(spark, db, name) -> None:
    got = plans.all_queries()[name](spark, str(DATA)).toPandas()
    if sql := plans.all_oracles().get(name):
        want = db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_the_entry_runs(spark) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_sum_over_three_relations_makes_no_pairs(spark, tmp_path) -> None:
    duckdb.sql(f"COPY (SELECT CAST(range AS INTEGER) AS n_nationkey, CAST(range % 3 AS INTEGER) AS n_regionkey FROM range(5)) TO '{tmp_path}/nation.parquet'")
    duckdb.sql(f"COPY (SELECT CAST(range % 7 AS INTEGER) AS s_nationkey, CASE WHEN range % 11 = 0 THEN NULL ELSE 100.0 * (range % 30) END::DOUBLE AS s_acctbal FROM range(900)) TO '{tmp_path}/supplier.parquet'")
    duckdb.sql(f"COPY (SELECT CASE WHEN range % 13 > 0 THEN CAST(range % 4 AS INTEGER) END AS c_nationkey, CAST(1000.0 * (range % 3) AS DOUBLE) AS c_acctbal FROM range(800)) TO '{tmp_path}/customer.parquet'")
    tables = duckdb.connect()
    for t in ("nation", "supplier", "customer"):
        tables.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = plans.all_queries()["sql_join_three"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == tables.sql(plans.all_oracles()["sql_join_three"]).fetchall()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [c#") == 2  # both sides are summed before they meet


def test_equal_sums_are_all_the_largest_however_their_lines_are_dealt(spark, tmp_path) -> None:
    """Suppliers 1 and 2 have the same lines in the same order, but their files part them elsewhere; all prices of 4 are null."""
    names = ("l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    parts = [[(1, 0.1), (2, 0.1), (2, 0.2), (3, 0.5), (4, None)], [(1, 0.2), (1, 0.3), (2, 0.3), (None, 0.4)]]
    for k, lines in enumerate(parts):
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pd.DataFrame([(s, p, 0.0, pd.Timestamp("1997-02-01")) for s, p in lines], columns=names).astype({"l_suppkey": "Int64", "l_extendedprice": "Float64", "l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet" / f"{k}.parquet")
    pd.DataFrame({"s_suppkey": range(1, 6), "s_name": [f"S{k}" for k in range(1, 6)]}).to_parquet(tmp_path / "supplier.parquet")
    tables = duckdb.connect(config={"threads": 1})  # with more, its own sums hang on who reads what
    tables.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    tables.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = sorted(map(tuple, plans.all_queries()["tpch_q15"](spark, str(tmp_path)).collect()))
    assert got == sorted(tables.sql(plans.all_oracles()["tpch_q15"]).fetchall()) == [(1, "S1", 0.6), (2, "S2", 0.6), (4, "S4", None)]


def test_a_steady_sum_hangs_on_no_order_and_keeps_what_no_decimal_holds(spark) -> None:
    inf, nan = math.inf, math.nan
    groups = {"up": [0.1, 0.2, 0.3], "down": [0.3, 0.2, 0.1], "mixed": [1e11, -1e11, 0.7], "large": [1e300, 1.5], "inf": [inf, 1.0], "nan": [nan, 1.0], "none": [None], "some": [None, -2.5]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").coalesce(1)
    got = {g: v for g, v in df.groupBy("g").agg(steady_sum(F.col("v"))).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"up": 0.6, "down": 0.6, "mixed": 0.7, "large": 1e300, "inf": inf, "none": None, "some": -2.5}
