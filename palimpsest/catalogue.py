"""Registry of the query catalogue and what its modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a file of one row group is one task, however
    many partitions it counts as. Inputs of at least as many files as cores are left as they are."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, parts)) if parts < cores or len(df.inputFiles()) < cores else df


def strict(spark: SparkSession) -> None:
    """JSON with duplicate keys is valid; the parser has to be told so."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
