"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL unless SQL can't say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("carrier_rollup", """
SELECT s_name AS carrier, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total_mrc
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name""")
def carrier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: rows and recurring cost by carrier."""
    by_key = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("mrc"))
    return (
        by_key.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_name").alias("carrier"))
        .agg(F.sum("n").alias("n_rows"), F.round(F.sum("mrc"), 2).alias("total_mrc"))
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_rollup(spark, sf_dir)


def _load() -> None:
    """Import the modules that register queries."""
    from . import inventory, more, records, texts  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
