"""Helpers of the query modules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def day(text: str) -> Column:
    """A constant date as the tables hold it; the scan can take it as a filter."""
    return F.to_timestamp_ntz(F.lit(text))


def total(x: Column, name: str, digits: int = 4) -> Column:
    """A rounded sum, 0 over nothing."""
    return F.round(F.coalesce(F.sum(x), F.lit(0.0)), digits).alias(name)


def steady_sum(x: Column) -> Column:
    """A sum of doubles that is the same in whatever order they are added, null over nothing: for sums that are compared with each other.

    Values below 10^12 are added as decimals with 16 places; larger ones, infinities and NaN as doubles.
    """
    small = F.abs(x) < 1e12
    exact, rest = F.sum(F.when(small, x).cast("decimal(38, 16)")).cast("double"), F.sum(F.when(~small, x))
    return F.coalesce(exact + rest, exact, rest)


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), f"ringview-{spark.sparkContext.applicationId}").as_uri()
    return f"{base.rstrip('/')}/ringview/{name}-{uuid.uuid4().hex}"


def register(queries: dict[str, Callable[[SparkSession, str], DataFrame]], oracles: dict[str, str]) -> Callable[[str | None], Callable]:
    """A decorator that enters a query under its name, with its SQL."""

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return query
