"""Sharding by jump consistent hashing.

A stable key and the number of shards alone decide a row's shard, with no ring table: appending a
shard moves the necessary 1/(n+1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

# Fixed values of the published algorithm (Lamping and Veach, 2014).
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SCALE = float(1 << 31)

NAMES = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key; the rounds are about the logarithm of the number of shards."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64)
    b = np.zeros(key.size, np.int64)
    todo = np.arange(key.size)
    j = np.zeros(key.size, np.int64)
    with np.errstate(over="ignore"):
        while todo.size:
            b[todo] = j[todo]
            key[todo] = key[todo] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            draw = ((key[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            j[todo] = ((b[todo] + 1) * (JUMP_SCALE / draw)).astype(np.int64)
            todo = todo[j[todo] < shards]
    return b


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of docs that carry names, or all, and size, text_crc32, law, shard, slot and
    grown_shard (replacing any of those names).

    size is the UTF-8 bytes of the text plus 1, a null text counting as no bytes. A null key is one
    more key value. Repeated rows share a shard and get neighbouring slots. slot numbers the rows of a
    shard from 0 by key without gaps: ranges of (shard, key) are counted first, so no task holds a
    whole shard. grown_shard is the shard with one shard more. Only keys go through Python, and what is
    not carried, such as long texts, is neither shuffled nor written.
    """
    own = [c for c in (docs.columns if carry is None else carry) if c not in NAMES]

    @F.pandas_udf("int")
    def jumped(keys: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), int(n.iloc[0])).astype(np.int32)) if len(keys) else pd.Series([], dtype="int32")

    measured = docs.select(
        *own,
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col(key).alias("__key"),
        F.xxhash64(F.col(key)).alias("__hash"),
    )
    dealt = measured.withColumn("shard", jumped("__hash", F.lit(shards))).withColumn("grown_shard", jumped("__hash", F.lit(shards + 1))).drop("__hash")
    order = ("__key", "text_crc32", "size")
    ranged = dealt.repartitionByRange(partitions(docs.sparkSession), "shard", *order)
    placed = materialize(ranged.withColumn("__part", F.spark_partition_id()), "shards")
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    # At most one row for each shard and range partition: a few thousand rows, however many documents.
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "__part", F.coalesce(before, F.lit(0)).alias("__from"))
    rank = F.row_number().over(W.partitionBy("shard", "__part").orderBy(*order))
    numbered = placed.withColumn("__rank", rank).join(F.broadcast(starts), ["shard", "__part"])
    return numbered.select(
        *own, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__from") + F.col("__rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
