"""Whole text files as rows, rewritten by kind, and written beside the originals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.classify import file_strategy


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, strategy): a row for each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("strategy", file_strategy(F.element_at(F.split("path", "/"), -1)))


def rewrite_files(files: DataFrame, config: Config = Config()) -> DataFrame:
    """files with compressed and method, null where nothing is gained."""
    from ..plans.compact import rewrite_rows

    return rewrite_rows(files, config)


def write_files(files: DataFrame, path: str) -> None:
    """The rewritten files as a new Parquet data set; originals are never touched."""
    files.select("path", F.coalesce("compressed", "text").alias("text"), "method").write.parquet(path)
