"""Session-scoped stages over streams: references to texts seen before, diffs to prior reads, calls met
with their results, totals.

State lives with its session key and goes after two idle hours. Bounds on how many sessions a single
process holds have no counterpart here: state is partitioned, and time alone ends it. What a session
has seen is a map in the state store, of which a row touches its own entry only. Reads are put in the
order of their own times before they are compared: they wait in the state until the watermark has
passed them, so the order of files, batches and Arrow chunks does not show.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import js_len
from ..operators.similarity import unified_hunks
from ..workdir import new_path

IDLE_MS = 7_200_000
GRAPH_LEAST = 512
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READS = "session_key string, path string, at timestamp, ord long, compressed string, late boolean"


class _References(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "sha string", "ref_id long")
        self.count = handle.getValueState("count", "n long, touched long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values("ord", kind="stable")  # numbers and hashes, no texts
        now = timerValues.getCurrentProcessingTimeInMs()
        n, touched = self.count.get() if self.count.exists() else (0, now)
        if now - touched > self.idle_ms:  # its timer may not have come round yet
            self.forget()
            n = 0
        out = []
        for ord_, sha in zip(every["ord"], every["sha"]):
            known = sha is not None and self.seen.containsKey((sha,))
            ref = self.seen.getValue((sha,))[0] if known else None
            if sha is not None and not known:
                n += 1
                ref = n
                self.seen.updateValue((sha,), (n,))
            out.append((key[0], ord_, sha, ref, known))
        self.count.update((n, now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=["session_key", "ord", "sha", "ref_id", "is_ref"]).astype({"ref_id": "Int64"})

    def forget(self) -> None:
        self.seen.clear()
        self.count.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class _Reads(StatefulProcessor):
    """Holds a key's reads until the watermark has passed them, and then compares each with the one before."""

    def __init__(self, idle_ms: int, share: float) -> None:
        self.idle_ms, self.share = idle_ms, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ord long, text string")
        self.last = handle.getValueState("last", "at long, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark, least = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            # A batch holds rows of other keys too: one null number would make floats of all.
            batch = batch.assign(ord=batch["ord"].astype(object).where(batch["numbered"], None))
            late = batch["millis"] < watermark  # what has this time has not come out yet
            if late.any():
                yield self.given(key, [(at, ord_, None, True) for at, ord_ in zip(batch["micros"][late], batch["ord"][late])])
            on_time = batch[~late]
            if len(on_time):
                self.waiting.appendList(list(on_time[["micros", "ord", "text"]].itertuples(index=False, name=None)))
                first = int(on_time["millis"].min())
                least = first if least is None else min(least, first)
        # A key has one timer for its earliest read, not one a read: each timer that comes goes through all that wait.
        if least is not None and not any(t <= least + 1 for t in self.handle.listTimers()):
            self.handle.registerTimer(least + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All reads up to the watermark, by time and then number, and a timer for the first of the others. A
        read that is null stands for no text, which is not compared and stays nobody's last."""
        watermark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) if self.waiting.exists() else []
        ready = [r for r in held if r[0] // 1000 < watermark]
        rest = held[len(ready) :]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        last_at, last = self.last.get() if self.last.exists() else (None, None)
        out = []
        for at, ord_, text in ready:
            usable = last is not None and text is not None and last != text and at - last_at <= self.idle_ms * 1000
            patch = unified_hunks(last, text) if usable else None
            out.append((at, ord_, f"[diff from prior read of {key[1]}]:\n{patch}" if patch is not None and len(patch) < self.share * len(text) else None, False))
            if text is not None:
                last_at, last = at, text
        ends = last_at // 1000 + self.idle_ms if last is not None else None
        if last is not None and not rest and watermark > ends:
            self.last.clear()
        elif ready and last is not None:
            self.last.update((last_at, last))
            self.handle.registerTimer(ends + 1)
        if out:
            yield self.given(key, out)

    def given(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["session_key", "path", "at", "ord", "compressed", "late"])
        return out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="us"), ord=pd.array([r[1] for r in rows], dtype="Int64"), late=out["late"].astype(bool))

    def close(self) -> None:
        pass


def stream_graph_refs(rows: DataFrame, least: int = GRAPH_LEAST, idle_ms: int = IDLE_MS) -> DataFrame:
    """(session_key, ord, sha, ref_id, is_ref) of a stream of rows(session_key, ord, text): texts of
    `least` or more units are numbered in their session as first seen, and repeats refer to that number.
    Texts are hashed before the exchange, so neither it nor the state holds them."""
    sha = F.when(js_len(F.col("text")) >= least, F.substring(F.sha2("text", 256), 1, 12))
    keyed = rows.select(F.col("session_key").cast("string").alias("session_key"), F.col("ord").cast("long").alias("ord"), sha.alias("sha")).groupBy("session_key")
    schema = "session_key string, ord long, sha string, ref_id long, is_ref boolean"
    return keyed.transformWithStateInPandas(_References(idle_ms), schema, "append", "ProcessingTime")


def stream_read_diff(rows: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS, share: float = 0.5) -> DataFrame:
    """(session_key, path, at, ord, compressed, late) of a stream of rows(session_key, path, at, ord, text):
    hunks to the session's last text of the same path by time `at` and then ord (null first), where that is not more than
    idle_ms before and the hunks are under `share` of the new text, else null.

    Reads come out once the watermark, `delay` behind the latest time seen, has passed them, in an order
    that depends on their times alone. Reads behind the watermark when they come are late: they come out
    at once, marked, without a diff and without being compared with; see split for a table of their own.
    A read without a time is dropped."""
    marked = rows.where("at is not null").withWatermark("at", delay)
    # Plain numbers bear no watermark, so late rows reach the state as well.
    plain = marked.select("session_key", "path", F.unix_micros("at").alias("micros"), F.unix_millis("at").alias("millis"), F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord"), F.col("ord").isNotNull().alias("numbered"), "text")
    return plain.groupBy("session_key", "path").transformWithStateInPandas(_Reads(idle_ms, share), READS, "append", "EventTime")


def stream_tool_paths(results: DataFrame, calls: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """results(request_id, tool_use_id, at, ...) with path: that of the call (request_id, tool_use_id, at,
    path) of its id no more than `within` before, null once the watermark leaves no hope of one. Both are
    streams; each side's state holds no more than `within` and `delay`. A result without an id or time has
    no call; more calls of one id give a row each."""
    left = results.withWatermark("at", delay)
    right = calls.select(F.col("request_id").alias("__r"), F.col("tool_use_id").alias("__u"), F.col("at").alias("__at"), "path").withWatermark("__at", delay)
    met = (F.col("request_id") == F.col("__r")) & (F.col("tool_use_id") == F.col("__u")) & (F.col("__at") <= F.col("at")) & (F.col("__at") >= F.col("at") - F.expr(f"INTERVAL {within}"))
    return left.join(right, met, "leftOuter").drop("__r", "__u", "__at")


def _run(stream: DataFrame, checkpoint: str, sink, timed: bool = False) -> None:
    """Run a stream over what its source holds now, to the end, with the state in RocksDB. Time-outs by the
    clock keep a query at work for ever, with triggers that ask the source again and find nothing; a `timed`
    one is stopped after two of these (a single one may be what an earlier run left unfinished)."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, STORE)
    try:
        writer = sink(stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append"))
        run = (writer if timed else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(key, before) if before else conf.unset(key)
    if timed:
        try:
            while run.isActive and not (len(seen := run.recentProgress) > 1 and not seen[-1]["numInputRows"] and not seen[-2]["numInputRows"]):
                time.sleep(0.2)
            if failed := run.exception():
                raise failed
        finally:
            run.stop()
    else:
        run.awaitTermination()


def drained(stream: DataFrame, name: str, path: str | None = None, timed: bool = False) -> DataFrame:
    """All that a stream gives for what its source holds now, added to the table at path, or to a new one;
    a table's state is kept beside it, so a later run goes on where this one ends. timed: as of stages
    whose state ends by the clock, such as stream_graph_refs."""
    path = path or new_path(stream.sparkSession, name)
    _run(stream, f"{path}-checkpoint", lambda w: w.format("parquet").option("path", path), timed)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def split(stream: DataFrame, name: str, side: str = "late", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """drained into two tables, of the rows where `side` is false and where it is true. A batch is written
    in the place of what an earlier attempt at it left, so a repeated batch adds nothing."""
    spark: SparkSession = stream.sparkSession
    path = path or new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        for flag in (False, True):
            batch.where(F.col(side) == flag).write.mode("overwrite").parquet(f"{path}/{'side' if flag else 'main'}/batch={number}")

    _run(stream, f"{path}-checkpoint", lambda w: w.foreachBatch(write))
    main, aside = (spark.read.schema(stream.schema).parquet(f"{path}/{part}/*") for part in ("main", "side"))
    return main, aside


def session_totals(events: DataFrame, key: str, at: str, value: str, idle: str = "2 hours") -> DataFrame:
    """Count and sum of each session window of a key, batch or stream, with a watermark of `idle`."""
    marked = events.withWatermark(at, idle)
    window = F.session_window(at, idle)
    return marked.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling_totals(events: DataFrame, at: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each window of fixed width, batch or stream."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
