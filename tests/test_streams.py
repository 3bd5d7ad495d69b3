"""Streams against plain versions over all rows at once."""

import datetime as dt
import random

import pandas as pd
import pytest

from palimpsest import queries
from palimpsest.operators import crossrow, similarity
from palimpsest.streaming import sessions, store


def feed(spark, rows, schema, tmp_path, k, side="all"):
    """Put one more file into the folder that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{side}-in{k}"))
    (tmp_path / side).mkdir(exist_ok=True)
    for f in (tmp_path / f"{side}-in{k}").glob("*.parquet"):
        f.rename(tmp_path / side / f"{k}-{f.name}")


def source(spark, schema, tmp_path, side="all"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side))


def run_stream(spark, build, rows, schema, tmp_path, name):
    for k, part in enumerate(rows):
        feed(spark, part, schema, tmp_path, k)
        out = sessions.drained(build(source(spark, schema, tmp_path)), name, str(tmp_path / name), timed=True)
    return out.collect()


def test_stream_refs_survive_restart(spark, tmp_path):
    rows = [[("s", 1, "a" * 600), ("s", 2, "b" * 600), ("t", 3, "a" * 600)], [("s", 4, "a" * 600), ("s", 5, None), ("s", 6, "c" * 600)]]
    got = {r.ord: (r.ref_id, r.is_ref) for r in run_stream(spark, sessions.stream_graph_refs, rows, "session_key string, ord long, text string", tmp_path, "refs")}
    assert got == {1: (1, False), 2: (2, False), 3: (1, False), 4: (1, True), 5: (None, False), 6: (3, False)}


def test_idle_sessions_end(spark, tmp_path):
    """State goes once a session has been idle: a text seen before is new again."""
    rows = [[("s", 1, "a" * 600)], [("s", 2, "a" * 600)]]
    build = lambda source: sessions.stream_graph_refs(source, idle_ms=1)
    got = {r.ord: (r.ref_id, r.is_ref) for r in run_stream(spark, build, rows, "session_key string, ord long, text string", tmp_path, "idle")}
    assert got == {1: (1, False), 2: (1, False)}


READS = "session_key string, path string, at timestamp, ord long, text string"


def clock(seconds):
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=seconds)


def reads_of(rng, n):
    """Reads of two files in two sessions at mixed times, edited a little, ties and nulls among them."""
    lines = [f"line {i} of the file" for i in range(30)]
    out = []
    for i in range(n):
        edited = list(lines)
        for _ in range(rng.randrange(3)):
            edited[rng.randrange(30)] = f"edit {rng.randrange(5)}"
        out.append((rng.choice("st"), rng.choice(["/f", "/g"]), clock(rng.randrange(0, 3600 * (9 if i % 5 else 1))), i, None if rng.random() < 0.1 else "\n".join(edited)))
    return out


def slow_reads(rows, idle=7200):
    out, last = {}, {}
    for key, path, at, ord_, text in sorted(rows, key=lambda r: (r[2], r[3])):
        seen = last.get((key, path))
        old = seen[1] if seen and (at - seen[0]).total_seconds() <= idle else None
        patch = similarity.unified_hunks(old, text) if old is not None and text is not None and old != text else None
        out[ord_] = f"[diff from prior read of {path}]:\n{patch}" if patch is not None and len(patch) < 0.5 * len(text) else None
        if text is not None:
            last[key, path] = at, text
    return out


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_stream_read_diff(spark, tmp_path, size):
    """Reads in any order of files and Arrow batches of any size give what their times say."""
    rows = reads_of(random.Random(3), 60)
    end = [("end", "/", clock(10**6), -1, "x")]
    for k, part in enumerate([rows[:25], rows[25:40], rows[40:], end]):
        feed(spark, part, READS, tmp_path, k)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = sessions.drained(sessions.stream_read_diff(source(spark, READS, tmp_path), delay="1 day"), "diffs").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = slow_reads(rows)
    assert {r.ord: r.compressed for r in got} == want and len(got) == len(want) and not any(r.late for r in got)
    assert sum(v is not None for v in want.values()) > 20
    assert {r.ord: r["at"] for r in got} == {r[3]: r[2] for r in rows}


def test_late_reads_go_aside(spark, tmp_path):
    """Rows behind the watermark come out in a table of their own, and the rest is as if they had never come."""
    rng = random.Random(4)
    first = [(k, p, clock(20_000 + 60 * i), i, t) for i, (k, p, _, _, t) in enumerate(reads_of(rng, 20))]
    late = [(k, p, clock(60 * i), 100 + i, t) for i, (k, p, _, _, t) in enumerate(reads_of(rng, 6))]
    more = [(k, p, clock(30_000 + 60 * i), 200 + i, t) for i, (k, p, _, _, t) in enumerate(reads_of(rng, 20))]
    for k, part in enumerate([first, [("s", "/f", clock(22_000), 50, "y")], late + more, [("end", "/", clock(10**6), -1, "x")]]):
        feed(spark, part, READS, tmp_path, k)
    build = lambda: sessions.stream_read_diff(source(spark, READS, tmp_path), delay="30 minutes")
    main, side = sessions.split(build(), "reads", path=str(tmp_path / "out"))
    assert sorted(r.ord for r in side.collect()) == [r[3] for r in late]
    assert {r.ord: r.compressed for r in main.collect()} == slow_reads(first + [("s", "/f", clock(22_000), 50, "y")] + more)
    again, _ = sessions.split(build(), "reads", path=str(tmp_path / "out"))  # nothing new to do
    assert again.count() == 41


def test_stream_tool_paths(spark, tmp_path):
    """Calls and results of two streams meet as in a batch; the last file moves both watermarks on."""
    rng = random.Random(6)
    calls = [(f"r{i % 5}", f"u{i}", clock(60 * i), f"/f{i % 3}") for i in range(40)]
    results = [(r, u, at + dt.timedelta(seconds=rng.choice([0, 30, 3599, 3600, 3601, -1])), f"text {i}") for i, (r, u, at, _) in enumerate(calls)]
    results += [("r1", "unknown", clock(99), "lone"), ("r1", None, clock(100), "no id")]
    end = clock(10**6)
    call, result = "request_id string, tool_use_id string, at timestamp, path string", "request_id string, tool_use_id string, at timestamp, text string"
    for k, part in enumerate([calls[::2], calls[1::2], [("end", "c", end, "/")]]):
        feed(spark, part, call, tmp_path, k, "calls")
    for k, part in enumerate([results[:20], results[20:], [("end", "r", end, "z")]]):
        feed(spark, part, result, tmp_path, k, "results")
    met = sessions.stream_tool_paths(source(spark, result, tmp_path, "results"), source(spark, call, tmp_path, "calls"), delay="1 day")
    got = sorted(((r.text, r.path) for r in sessions.drained(met, "paths").collect()), key=str)
    of = {(r, u): (at, path) for r, u, at, path in calls}
    want = []
    for r, u, at, text in results:
        began, path = of.get((r, u), (None, None))
        want.append((text, path if began is not None and 0 <= (at - began).total_seconds() <= 3600 else None))
    assert [g for g in got if g[0] != "z"] == sorted(want, key=str) and {p is None for _, p in want} == {True, False}


def test_store_is_kept_between_batches(spark, tmp_path):
    """After every batch the store holds what eviction over all rows so far keeps; a repeated batch changes nothing."""
    rng = random.Random(8)
    texts = [f"text {i} " + "x" * rng.randrange(20, 400) for i in range(60)] + ["short", None]
    schema, path, every = "text string, access long", str(tmp_path / "store"), []
    for k in range(5):
        rows = [(rng.choice(texts), rng.randrange(100 * k, 100 * k + 160)) for _ in range(25)]
        every += rows
        feed(spark, rows, schema, tmp_path, k)
        store.keep_store(source(spark, schema, tmp_path), path, 4000, least=20, buckets=4, slot=16)
        entries = crossrow.store_entries(spark.createDataFrame(every, schema), "text", "access", 20).drop("shard")
        want = {(r.hash, r.text, r.last_access) for r in crossrow.store_evict(entries, 4000).where("kept").collect()}
        got = {(r.hash, r.text, r.last_access) for r in store.read_store(spark, path).collect()}
        assert got == want and sum(len(t) for _, t, _ in got) <= 4000
        assert sum(store.state(spark, path)["slots"].values()) == sum(len(t) for _, t, _ in got)
    assert len(want) < len({t for t, _ in every})
    again = spark.createDataFrame(rows, schema)
    before = store.state(spark, path)
    store.upsert(again, before["batch"], path, 4000, least=20, buckets=4, slot=16)
    assert store.state(spark, path) == before and {(r.hash, r.text, r.last_access) for r in store.read_store(spark, path).collect()} == want
    store.upsert(again.limit(0), before["batch"] + 1, path, 4000, least=20, buckets=4, slot=16)
    assert {(r.hash, r.text, r.last_access) for r in store.read_store(spark, path).collect()} == want


class _Held:
    """One key's timers and states, as the processor of reads asks for them."""

    def __init__(self):
        self.timers, self.states, self.read = set(), {}, 0

    def getListState(self, name, schema):  # noqa: N802
        return _State(self, name)

    getValueState = getListState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class _State:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.states

    def get(self):
        kept = self.held.states[self.name]
        self.held.read += len(kept) if self.name == "waiting" else 0
        return kept

    def appendList(self, rows):  # noqa: N802
        self.held.states.setdefault(self.name, []).extend(rows)

    def put(self, rows):
        self.held.states[self.name] = rows

    update = put

    def clear(self):
        self.held.states.pop(self.name, None)


class _Now:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_reads_wait_on_one_timer():
    """A key's reads are gone through once a watermark, not once for each read that waits."""
    held, reads = _Held(), sessions._Reads(10_000_000, 0.5)
    reads.init(held)
    n = 500
    rows = pd.DataFrame({"micros": [1000 * i for i in range(n)], "millis": range(n), "ord": range(n), "numbered": True, "text": [f"text {i}" for i in range(n)]})
    list(reads.handleInputRows(("s", "/f"), iter([rows[250:], rows[:250]]), _Now(0)))
    out = []
    for watermark in (200, 400, 10**6):
        for at in sorted(t for t in held.timers if t <= watermark):
            held.timers.discard(at)
            out += [f for f in reads.handleExpiredTimer(("s", "/f"), _Now(watermark), None)]
    assert [o for f in out for o in f["ord"]] == list(range(n))
    assert held.read <= n + (n - 200) + (n - 400)


def test_a_stream_is_closed_by_one_row(spark, tmp_path):
    """One row that closes, however many there are: a row each would meet all others of its key."""
    feed(spark, [(f"s{i}", clock(i), i) for i in range(50)], "session_key string, at timestamp, ord long", tmp_path, 0)
    rows = queries.closed(spark.readStream.schema("session_key string, at timestamp, ord long").parquet(str(tmp_path / "all")))
    got = sessions.drained(rows, "closed").collect()
    assert len(got) == 51 and [(r.session_key, r.ord) for r in got if r["at"] > clock(10**8)] == [("(end)", None)]


def test_reads_without_a_number(spark, tmp_path):
    """A read without a number leaves the numbers of others as they are, however large, and comes first of its time."""
    rows = [("s", "/f", clock(5), 2**60 + 1, "x" * 50), ("s", "/f", clock(5), None, "y" * 50), ("t", "/f", clock(6), 7, "z"), ("end", "/", clock(10**6), -1, "x")]
    for k, part in enumerate((rows[:3], rows[3:])):
        feed(spark, part, READS, tmp_path, k)
    got = sessions.drained(sessions.stream_read_diff(source(spark, READS, tmp_path), delay="1 day"), "diffs").collect()
    assert {(r.session_key, r.ord) for r in got} == {("s", 2**60 + 1), ("s", None), ("t", 7)}
