"""A content store that a stream keeps: texts by hash, the least recently seen ones evicted beyond a budget.

Every batch writes the buckets of hashes it touches, and one small state: which batch wrote each bucket
last, the bytes held for each stretch of last access (a histogram), and the horizon, the first entry in
order of recency that no longer fits. What is behind the horizon is gone for readers at once, and from the
files when its bucket is next written, so eviction rewrites nothing. A batch starts from the state of the
one before it and writes in the place of its own earlier attempt: repeated, it changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crossrow
from ..workdir import materialize
from .sessions import _run

BUCKETS, SLOT = 256, 1 << 20
COLUMNS = "hash string, text string, bytes long, last_access long"
EMPTY = {"batch": -1, "buckets": {}, "slots": {}, "horizon": None}


def state(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """The last state, or the last before a batch. States are a row each."""
    try:
        rows = spark.read.schema("value string, batch long").text(f"{path}/state")
        found = (rows if before is None else rows.where(F.col("batch") < before)).orderBy(F.desc("batch")).first()
    except Exception as error:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = None
    return json.loads(found.value) if found else EMPTY


def alive(horizon: list | None) -> Column:
    if horizon is None:
        return F.lit(True)
    at, first = horizon
    return (F.col("last_access") > at) | ((F.col("last_access") == at) & (F.col("hash") < first))


def entries_of(spark: SparkSession, path: str, now: dict, buckets: list[int] | None = None) -> DataFrame:
    """(hash, text, bytes, last_access) that a state holds, of all buckets or some."""
    wanted = {int(b): v for b, v in now["buckets"].items() if buckets is None or int(b) in buckets}
    if not wanted:
        return spark.createDataFrame([], COLUMNS)
    files = [f"{path}/data/batch={v}/bucket={b}" for b, v in wanted.items()]
    return spark.read.schema(COLUMNS).parquet(*files).where(alive(now["horizon"]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What the store at path holds now."""
    return entries_of(spark, path, state(spark, path))


def upsert(batch: DataFrame, number: int, path: str, budget: int, text: str = "text", access: str = "access", least: int = crossrow.STORE_LEAST, buckets: int = BUCKETS, slot: int = SLOT) -> None:
    """Take in a batch of rows(text, access), access a whole number that grows with time. Texts that are null
    or of less than `least` bytes are passed over, and an entry's last access never goes back."""
    spark = batch.sparkSession
    was = state(spark, path, number)
    bucket = F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    seen = crossrow.store_entries(batch.select(F.col(text).alias("text"), F.col(access).cast("long").alias("access")).where("access is not null"), "text", "access", least)
    new = materialize(seen.drop("shard").withColumn("bucket", bucket), "seen")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    old = entries_of(spark, path, was, touched)
    merged = old.unionByName(new.drop("bucket")).groupBy("hash").agg(F.min("text").alias("text"), F.max("bytes").alias("bytes"), F.max("last_access").alias("last_access"))
    merged.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "hash").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
    moved = new.join(old.select("hash", F.col("last_access").alias("before")), "hash", "left")
    of = lambda c: F.floor(c / slot).cast("long")
    ends = F.array(F.struct(of(F.greatest("last_access", F.coalesce("before", "last_access"))).alias("slot"), F.col("bytes").alias("n")), F.struct(of(F.col("before")).alias("slot"), (-F.col("bytes")).alias("n")))
    change = moved.select(F.inline(ends)).where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    slots = {int(k): n for k, n in was["slots"].items()}
    for r in change:
        slots[r.slot] = slots.get(r.slot, 0) + r.n
    slots = {k: n for k, n in slots.items() if n}
    now = {"batch": number, "buckets": was["buckets"] | {str(b): number for b in touched}, "horizon": was["horizon"]}
    used, edge = 0, None
    for k in sorted(slots, reverse=True):
        if used + slots[k] > budget:
            edge = k
            break
        used += slots[k]
    if edge is not None:  # only the stretch that the budget ends in is looked at entry by entry
        within = entries_of(spark, path, now).where((F.col("last_access") >= edge * slot) & (F.col("last_access") < (edge + 1) * slot)).drop("text")
        judged = crossrow.store_evict(within, budget - used)
        first = judged.where("not kept").agg(F.min(F.struct((-F.col("last_access")).alias("t"), "hash")).alias("x")).first()
        kept = judged.where("kept").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        now["horizon"] = [-first.x.t, first.x.hash]
        slots = {k: n for k, n in slots.items() if k > edge} | ({edge: kept} if kept else {})
    now["slots"] = {str(k): n for k, n in slots.items()}
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state/batch={number}")


def keep_store(stream: DataFrame, path: str, budget: int, **options) -> None:
    """upsert for every batch of a stream of rows(text, access), to the end of what its source holds now."""
    _run(stream, f"{path}/checkpoint", lambda w: w.foreachBatch(lambda batch, number: upsert(batch, number, path, budget, **options)))
