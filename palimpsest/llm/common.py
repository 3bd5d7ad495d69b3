"""Shared plumbing: the shared work folder, written tables, Arrow mapping and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import materialize, remove, shared_dir, written

__all__ = ["connected_components", "materialize", "partitions", "remove", "scan", "shared_dir", "slices", "union_all", "written"]


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list of longs; root is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregation and one join on node, so a
    node of very high degree is pre-aggregated and its rows can be split by the skew join. Each round
    is a written table, which takes the place of the one before. Rounds grow with the logarithm of the
    longest path.
    """
    pairs, path = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    stamp = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), "m", "u")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before = path
        pairs, path = written(small.where("u <> v").distinct(), "cc")
        remove(edges.sparkSession, before)
        now = pairs.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).cast("string")
        ).first()
        if tuple(now) == stamp:
            break
        stamp = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(tops)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def slices(batch: pa.RecordBatch, column: str, cells: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column, binary or lists without nulls, holds about so many bytes or items, and at least one row each."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    width = length.to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(width) - width) // cells
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
