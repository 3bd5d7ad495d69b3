"""Stages that look across rows: duplicates, prior versions, session references, the content store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import js_len
from ..workdir import materialize

IDLE_SECONDS = 7200
GRAPH_LEAST = 512
STORE_LEAST, STORE_BUDGET = 8192, 512 << 20


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def marked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __hash and __len of its texts, unless it has them. A table that keeps them is compared by
    them, and its texts are neither read nor exchanged for it."""
    return df if "__hash" in df.columns else df.withColumns({"__hash": F.sha2(F.col(text), 256), "__len": js_len(F.col(text))})


def dedup_within(df: DataFrame, group: str, order: str, text: str = "text", message: str | None = None, block: str | None = None) -> DataFrame:
    """df with first_ord, marker and is_dup: a later copy of a text within its group refers to the
    first, unless the reference would be no shorter. Null texts are no copies.

    The first of a text is an aggregate by (group, hash) with partial aggregation, joined back, so a
    text that a third of the rows share is never sorted in one task. df may be marked.
    """
    keyed = marked(df, text)
    place = F.struct(F.col(order).alias("ord"), F.col(message or order).alias("msg"), F.col(block or order).alias("blk"))
    first = keyed.where("__hash is not null").groupBy(F.col(group).alias("__g"), F.col("__hash").alias("__h")).agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
    first = first.where("__n > 1").drop("__n")
    joined = keyed.join(first, keyed[group].eqNullSafe(first["__g"]) & (keyed["__hash"] == first["__h"]), "left")
    marker = F.format_string("[same content as message %d, block %d]", F.col("__first.msg").cast("long"), F.col("__first.blk").cast("long"))
    later = F.col(order) > F.col("__first.ord")
    dup = F.coalesce(later & (js_len(marker) < F.col("__len")), F.lit(False))
    return joined.withColumn("is_dup", dup).withColumn("marker", F.when(F.col("is_dup"), marker)).withColumn("first_ord", F.coalesce("__first.ord", F.col(order))).drop(
        "__hash", "__len", "__g", "__h", "__first"
    )


def prior_version(df: DataFrame, session: list[str], time: str, text: str, tie: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """df with prior: the text of the row before in its session, null when that is more than `idle`
    seconds ago."""
    w = W.partitionBy(*session).orderBy(time, tie)
    gap = micros(F.col(time)) - micros(F.lag(time).over(w))
    return df.withColumn("prior", F.when(gap <= idle * 1_000_000, F.lag(text).over(w)))


def graph_refs(df: DataFrame, session: str, order: str, text: str = "text", least: int = GRAPH_LEAST) -> DataFrame:
    """df with sha, ref_id and is_ref: texts of `least` or more units are numbered in their session in
    order of first sight, and repeats refer to that number.

    First sights are an aggregate by (session, hash); only they are numbered. df may be marked.
    """
    keyed = marked(df, text).withColumn("sha", F.when(F.col("__len") >= least, F.substring("__hash", 1, 12))).drop(*{"__hash", "__len"}.difference(df.columns))
    first = keyed.where("sha is not null").groupBy(F.col(session).alias("__s"), F.col("sha").alias("__sha")).agg(F.min(order).alias("__first"))
    first = first.withColumn("ref_id", F.row_number().over(W.partitionBy("__s").orderBy("__first")).cast("long"))
    joined = keyed.join(first, keyed[session].eqNullSafe(first["__s"]) & (keyed["sha"] == first["__sha"]), "left")
    return joined.withColumn("is_ref", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__s", "__sha", "__first")


def session_key(auth: Column, system: Column, first_turn: Column) -> Column:
    """16 hex digits that a conversation keeps: from its authorization, system prompt and first turn;
    null without authorization."""
    none = F.lit("null")
    seed = F.concat(F.sha2(F.coalesce(system, none), 256), F.lit(":"), F.sha2(F.coalesce(first_turn, none), 256))
    return F.when(F.length(auth) > 0, F.substring(F.sha2(F.concat(auth, F.lit(" "), seed), 256), 1, 16))


def store_entries(df: DataFrame, text: str, access: str, least: int = STORE_LEAST) -> DataFrame:
    """(hash, shard, text, bytes, last_access): one row a distinct text of `least` or more bytes."""
    held = df.where(F.octet_length(text) >= least).withColumn("hash", F.sha2(F.col(text), 256))
    last = held.groupBy("hash").agg(F.max(access).alias("last_access"), F.min(text).alias("text"))
    return last.select("hash", F.substring("hash", 1, 2).alias("shard"), "text", F.octet_length("text").cast("long").alias("bytes"), "last_access")


def store_lookup(entries: DataFrame, asked: DataFrame, access: str) -> tuple[DataFrame, DataFrame]:
    """(found, touched): asked(hash, access, ...) with text, null where the store has no such hash, and
    entries with last_access moved on to the latest hit."""
    found = asked.join(entries.select("hash", "text"), "hash", "left")
    hits = found.where("text is not null").groupBy("hash").agg(F.max(access).alias("__at"))
    touched = entries.join(hits, "hash", "left").withColumn("last_access", F.greatest("last_access", "__at")).drop("__at")
    return found, touched


def store_evict(entries: DataFrame, budget: int = STORE_BUDGET, buckets: int = 1024) -> DataFrame:
    """Entries with kept: by last access, newest first, as many as fit the budget; ties by hash.

    The cut is closed in on by sums of ranges, each at most `buckets` rows that come back: ranges of
    last_access, and finer ranges within the one that holds the cut. There, for each time left, ranges of
    the hash follow, so a store loaded at one time is no single range either. Only the last range is
    ordered row by row. All of this reads hashes, sizes and times, written once; hash is unique.
    """
    marks = materialize(entries.select("hash", "bytes", "last_access"), "marks")
    return entries.join(_kept(marks, budget, buckets), "hash").select(*entries.columns, "kept")


def _kept(marks: DataFrame, budget: int, buckets: int) -> DataFrame:
    """(hash, kept) of marks(hash, bytes, last_access), as store_evict has them."""
    rows = marks.select("hash", "bytes", F.col("last_access").cast("double").alias("t"))
    before, at, used = F.lit(False), F.lit(True), 0  # whether a row is before, or in, the range that holds the cut
    for _ in range(2):
        low, high = rows.where(at).agg(F.min("t"), F.max("t")).first()
        if low is None:
            break
        place = F.least(F.floor((high - F.col("t")) / max(high - low, 1e-9) * buckets), F.lit(buckets - 1)).cast("long")
        edge = None
        for k, size in sorted(tuple(r) for r in rows.where(at).groupBy(place).agg(F.sum("bytes")).collect()):
            if used + size > budget:
                edge = k
                break
            used += size
        if edge is None:
            return rows.select("hash", F.lit(True).alias("kept"))
        before, at = before | (at & (place < edge)), at & (place == edge)
    inside = rows.where(at).withColumn("place", F.struct((-F.col("t")).alias("t"), F.substring("hash", 1, 3).alias("h")))
    inside = inside.crossJoin(F.broadcast(_edge(inside, used, budget)))  # one row
    run = F.sum("bytes").over(W.partitionBy("place").orderBy("hash").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = inside.where("place = edge").select("hash", (F.col("from") + run <= budget).alias("kept"))
    rest = inside.where("edge is null or place <> edge").select("hash", F.coalesce(F.col("place") < F.col("edge"), F.lit(True)).alias("kept"))
    return rows.where(~at).select("hash", before.alias("kept")).unionByName(rest).unionByName(last)


def _edge(rows: DataFrame, used: int, budget: int) -> DataFrame:
    """One row (edge, from): the first range of rows(place, bytes) that does not fit the budget whole, and
    what comes before it; nulls if all fit. The sums of ranges are few rows."""
    sums = rows.groupBy("place").agg(F.sum("bytes").alias("n"))
    before = used + F.coalesce(F.sum("n").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = sums.withColumn("from", before).where(F.col("from") + F.col("n") > budget).agg(F.min(F.struct("place", "from")).alias("x"))
    return first.select(F.col("x.place").alias("edge"), F.col("x.from").alias("from"))


def sessions(df: DataFrame, key: str, time: str, tie: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """df with session_no: from 1, a new one after more than `idle` seconds without a row of the key."""
    w = W.partitionBy(key).orderBy(time, tie)
    new = F.coalesce((micros(F.col(time)) - micros(F.lag(time).over(w)) > idle * 1_000_000).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("session_no", (F.sum("__new").over(w) + 1).cast("long")).drop("__new")
