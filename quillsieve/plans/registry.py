"""Where the plan modules put their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all task slots when the files give fewer splits than there are slots.

    A table of many splits is left as it is, so nothing is shuffled at scale.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df
