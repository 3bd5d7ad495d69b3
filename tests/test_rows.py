"""Operators across rows, sources, trimming, the whole pass and streams."""

import datetime as dt
import gzip
import itertools
import json
import math
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest import fixtures, queries
from palimpsest.config import Config
from palimpsest.operators import crossrow, disclosure, ranking, similarity, stats
from palimpsest.plans import compact
from palimpsest.sources import files, requests


@pytest.mark.parametrize("seed", range(40))
def test_hunks_apply(seed):
    rng = random.Random(seed)
    old = [rng.choice("abcdef") for _ in range(rng.randrange(1, 40))]
    new = [x for x in old if rng.random() > 0.2]
    for _ in range(rng.randrange(5)):
        new.insert(rng.randrange(len(new) + 1), rng.choice("xyz"))
    for context in (0, 1, 3):
        assert similarity.apply_hunks("\n".join(old), similarity.unified_hunks("\n".join(old), "\n".join(new), context)) == "\n".join(new)
    script = similarity.edit_script(old, new)
    removed = sum(b - a for a, b, _, _ in script)
    same = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, j in itertools.product(range(len(old)), range(len(new))):
        same[i + 1][j + 1] = same[i][j] + 1 if old[i] == new[j] else max(same[i + 1][j], same[i][j + 1])
    assert removed == len(old) - same[-1][-1]


def slow_jaccard(a, b):
    x, y = set(a.split("\n")), set(b.split("\n"))
    return 0 if abs(len(a) - len(b)) > 0.5 * max(len(a), len(b)) else len(x & y) / len(x | y)


def test_similar_pairs_and_first_base(spark):
    rng = random.Random(3)
    base = [f"this is line number {i} of the text" for i in range(40)]
    rows = []
    for i in range(60):
        own = list(base[(i % 4) * 10 : (i % 4) * 10 + 10])
        for _ in range(rng.randrange(6)):
            own[rng.randrange(10)] = f"other {rng.randrange(1000)}"
        rows.append((i % 3, i, "\n".join(own)))
    rows += [(0, 60, "short"), (1, 61, ""), (2, 62, None), (0, 63, rows[0][2])]
    df = spark.createDataFrame(rows, "g int, id long, text string")
    first = {}
    for _, i, t in rows:
        if t is not None:
            first.setdefault(t, i)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if slow_jaccard(s, t) > 0.5}
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, "id").collect()}
    texts = {i: t for t, i in first.items()}
    assert set(got) == {(min(p), max(p)) for p in want} and all(v == pytest.approx(slow_jaccard(texts[a], texts[b])) for (a, b), v in got.items())
    found = {r.id: r for r in similarity.first_base(df, "g", "id").collect()}
    for g, i, t in rows:
        best = None
        for h, j, s in rows:
            if h == g and j < i and s and t and len(t) >= 200 and 0.5 < slow_jaccard(s, t) < 1 and len(similarity.unified_hunks(s, t)) < 0.5 * len(t):
                best = j
                break
        assert (found[i].base if i in found else None) == best
        if best is not None:
            assert similarity.apply_hunks(next(s for _, j, s in rows if j == best), found[i].patch) == t


def test_dedup_and_graph(spark):
    rows = [(1, 1, "x" * 600), (1, 2, "x" * 600), (1, 3, "tiny"), (1, 4, "tiny"), (2, 5, "x" * 600), (None, 6, "y" * 600), (None, 7, "y" * 600), (2, 8, None), (2, 9, None)]
    df = spark.createDataFrame(rows, "s int, o int, text string")
    dup = {r.o: r.is_dup for r in crossrow.dedup_within(df, "s", "o").collect()}
    assert [o for o in dup if dup[o]] == [2, 7] or sorted(o for o in dup if dup[o]) == [2, 7]
    refs = {r.o: (r.ref_id, r.is_ref) for r in crossrow.graph_refs(df, "s", "o").collect()}
    assert refs[1] == (1, False) and refs[2] == (1, True) and refs[3] == (None, False) and refs[7] == (1, True) and len(refs) == 9


def test_store(spark):
    rng = random.Random(0)
    rows = [(f"h{i:03}", rng.randrange(100, 900), rng.randrange(40)) for i in range(120)]
    entries = spark.createDataFrame(rows, "hash string, bytes long, last_access long")
    for budget in (0, 5000, 10**9):
        total, want = 0, {}
        for h, b, t in sorted(rows, key=lambda r: (-r[2], r[0])):
            total += b
            want[h] = total <= budget
        assert {r.hash: r.kept for r in crossrow.store_evict(entries, budget, buckets=8).collect()} == want
    assert crossrow.store_evict(entries.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 3, 500])
def test_eviction_of_a_bulk_load(spark, times):
    """Few access times, as after a load: the hash decides within one."""
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), 10 + i % 7, (i * 7919) % times) for i in range(500)]
    entries = spark.createDataFrame(rows, "hash string, bytes long, last_access long")
    for budget in (0, 9, 1000, 3500, 10**6):
        used, want = 0, {}
        for h, n, t in sorted(rows, key=lambda r: (-r[2], r[0])):
            used += n
            want[h] = used <= budget
        assert {r.hash: r.kept for r in crossrow.store_evict(entries, budget, buckets=4).collect()} == want


def test_store_lookup(spark):
    entries = spark.createDataFrame([("h1", "one", 3, 10), ("h2", "two", 3, 20)], "hash string, text string, bytes long, last_access long")
    found, touched = crossrow.store_lookup(entries, spark.createDataFrame([("h1", 15), ("h1", 30), ("h2", 5), ("h3", 9)], "hash string, at long"), "at")
    assert {(r.hash, r.at): r.text for r in found.collect()} == {("h1", 15): "one", ("h1", 30): "one", ("h2", 5): "two", ("h3", 9): None}
    assert {r.hash: r.last_access for r in touched.collect()} == {"h1": 30, "h2": 20}


def test_similarity_stays_in_its_group(spark):
    """Alike texts of other groups are no pairs, a null group is one of its own, and copies are diffed once."""
    same = "\n".join(f"a line of some words number {k}" for k in range(12))
    rows = [(g, k, f"head {g} {k % 3}\n{same}") for g in ("x", "y", None) for k in range(6)]
    df = spark.createDataFrame(rows, "g string, k long, text string")
    pairs = similarity.similar_pairs(df, "k", group="g").collect()
    assert sorted((str(r.g), r.a, r.b) for r in pairs) == sorted((str(g), a, b) for g in ("x", "y", None) for a, b in ((0, 1), (0, 2), (1, 2)))
    base = {(r.g, r.k): r.base for r in similarity.first_base(df, "g", "k").collect()}
    assert base == {(g, k): (0 if k % 3 else 1) for g in ("x", "y", None) for k in range(6) if k not in (0,)}


def test_prior_and_sessions(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("k", at(0), 1, "a"), ("k", at(7200), 2, "b"), ("k", at(14401), 3, "c")], "k string, ts timestamp, id int, text string")
    assert [r.prior for r in crossrow.prior_version(df, ["k"], "ts", "text", "id").orderBy("id").collect()] == [None, "a", None]
    assert [r.session_no for r in crossrow.sessions(df, "k", "ts", "id").orderBy("id").collect()] == [1, 1, 2]


def test_session_key(spark):
    rows = [("Bearer x", None, "hi"), ("Bearer x", None, "ho"), ("", None, "hi"), (None, None, "hi"), ("Bearer x", "sys", "hi")]
    keys = [r.k for r in spark.createDataFrame(rows, "a string, s string, f string").select(crossrow.session_key(F.col("a"), F.col("s"), F.col("f")).alias("k")).collect()]
    assert keys[2] is keys[3] is None and len({keys[0], keys[1], keys[4]}) == 3 and all(len(k) == 16 for k in keys if k)


def test_disclosure_round_trip(spark):
    rows = [(1, "é🚀" * 9000), (2, "small"), (3, "x" * 40000)]
    df = spark.createDataFrame(rows, "id int, text string")
    folded = disclosure.summarize(df)
    got = {r.id: r for r in folded.collect()}
    assert set(got) == {1, 3} and all(r.summary_bytes < r.original_bytes for r in got.values())
    mark = got[1].summary.split("\n")[-1]
    ask = spark.createDataFrame([(1, f"please {mark}"), (2, f"<{disclosure.TAG}:{'0' * 64}:5>"), (3, "none"), (4, f"{mark} again <{disclosure.TAG}:{got[1].hash} expanded - x"), (5, None)], "id int, text string")
    out = {r.id: r for r in disclosure.rehydrate(ask, folded.select("hash", "text"), "id").collect()}
    assert rows[0][1] in out[1].expanded and out[1].rehydrated == 1 and out[2].missed == 1 and out[3].expanded == "none" and rows[0][1] not in out[4].expanded and out[5].expanded is None


def test_ideal_order(spark):
    rows = [("a", 3.0, 1, True), ("a", 2.0, 2, True), ("a", 1.0, 3, False), ("b", 1.0, 1, False), ("b", 0.5, 2, True)]
    got = {r.g: r.ndcg for r in ranking.ndcg(spark.createDataFrame(rows, "g string, s double, p int, gold boolean"), "g", "s", "p", "gold").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(1 / math.log2(3))


def test_bucketed_store(spark):
    """Texts come back from a bucketed store whose side of the plan has no exchange; a second save replaces the first."""
    texts = [f"text {i} " * 2000 for i in range(40)]
    folded = disclosure.summarize(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), least=1000)
    held = {r.id: (r.hash, r.original_bytes) for r in folded.collect()}
    ask = spark.createDataFrame([(i, f"see <{disclosure.TAG}:{h}:{n}> and <{disclosure.TAG}:{'0' * 64}:9>") for i, (h, n) in held.items()], "id int, text string")
    try:
        for _ in range(2):
            store = disclosure.save_store(folded.select("hash", "text"), "kept_texts", buckets=8)
        found = disclosure.rehydrate(ask, store, "id")
        assert {r.id: texts[r.id] in r.expanded and r.rehydrated == 1 and r.missed == 1 for r in found.collect()} == {i: True for i in held}
        refs = ask.select(F.explode(disclosure.references(F.col("text"))).alias("hash"))
        plan = disclosure.held(refs, store)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert join.count("Exchange") == 1 and "Bucketed: true" in join and "Exchange" not in join[join.index("FileScan") - 400 : join.index("FileScan")]
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_texts")


def test_long_scripts_stay_bounded(monkeypatch):
    """What takes more steps than the bound is one change, and still gives the new text."""
    rng = random.Random(2)
    old, new = ([f"{rng.randrange(50)}" for _ in range(400)] for _ in range(2))
    whole = similarity.edit_script(old, new)
    monkeypatch.setattr(similarity, "MAX_EDITS", 20)
    assert len(similarity.edit_script(old, new)) == 1 < len(whole)
    assert similarity.apply_hunks("\n".join(old), similarity.unified_hunks("\n".join(old), "\n".join(new))) == "\n".join(new)
    near = [*old[:200], "x", *old[200:]]
    assert similarity.edit_script(old, near) == [(200, 200, 200, 201)]


def test_hunks_hold_little():
    """Of a batch no more than a slice of texts are Python objects at a time, and the way back of two texts
    without a line in common takes some 2 bytes a pair of steps, not 8."""
    import tracemalloc

    import pyarrow as pa

    class Batch:
        def __init__(self, values):
            self.values, self.most = values, 0

        def __len__(self):
            return len(self.values)

        def slice(self, start, n):
            part = pa.array(self.values[start : start + n], pa.string())
            self.most = max(self.most, len(part))
            return part

    old, new = (Batch([None if k % 7 == r else f"a\n{k * r}\nb" for k in range(1000)]) for r in (1, 2))
    patches = similarity.hunks.func(old, new)
    assert patches.to_pylist() == [None if a is None or b is None else similarity.unified_hunks(a, b) for a, b in zip(old.values, new.values)]
    back = similarity.restored.func(old, patches)
    assert back.to_pylist() == [None if a is None or b is None else b for a, b in zip(old.values, new.values)]
    assert max(old.most, new.most) <= 256
    a, b = [f"a{k}" for k in range(800)], [f"b{k}" for k in range(800)]
    tracemalloc.start()
    assert similarity.edit_script(a, b) == [(0, 800, 0, 800)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 1600**2


MALFORMED = ["", "{", "null", "7", "[]", '"x"', "{}", '{"messages":null}', '{"messages":{}}', '{"messages":[]}', '{"messages":[null]}', '{"messages":[1,"a",[]]}', '{"messages":[{"role":"user"}]}', '{"messages":[{"role":"user","content":5}]}',
             '{"messages":[{"role":"user","content":[null,1,"x",{}]}]}', '{"messages":[{"role":"tool","content":{"a":1}}]}', '{"input":"x"}', '{"input":[null,{"type":"function_call_output"}]}', '{"input":[{"type":"function_call_output","output":[null,{"type":"input_text"}]}]}',
             '{"contents":[null]}', '{"contents":[{"parts":null}]}', '{"contents":[{"parts":[null,{"functionResponse":null},{"functionResponse":{}}]}]}', '{"messages":[{"role":"user","content":[{"type":"tool_result","content":[null,{"type":"text"}]}]}]}']


def test_malformed_bodies(spark):
    rows = [(f"{p}{i}", p, b) for p, _ in requests.ROUTES for i, b in enumerate(MALFORMED)]
    df = spark.createDataFrame(rows, "request_id string, provider string, body string")
    assert requests.extract(df).count() == 0
    assert requests.last_user_text(df).count() == 0
    back = {r.request_id: r.body for r in requests.write_back(df, requests.extract(df).withColumn("compressed", F.lit("x"))).collect()}
    assert len(back) == len(rows)


def test_extract_and_write_back(spark):
    df = spark.createDataFrame(fixtures.BODIES, "request_id string, provider string, body string")
    found = requests.extract(df)
    texts = {(r.request_id, r.msg_idx, r.block_idx, r.sub_idx): r.text for r in found.collect() if r.skip is None}
    assert texts == {
        ("r1", 0, -1, -1): "read it", ("r1", 2, 0, -1): "body one", ("r2", 0, 0, 0): "sub a", ("r2", 0, 0, 2): "sub b", ("r3", 1, -1, -1): "early", ("r3", 3, -1, -1): "late", ("r3", 4, 0, -1): "part",
        ("r4", 1, -1, -1): "out", ("r4", 2, 0, -1): "p", ("r5", 1, 0, -1): '{\n  "b": 1,\n  "a": [\n    1,\n    2.5\n  ]\n}', ("r5", 1, 1, -1): "plain",
    }
    newest = {(r.request_id, r.msg_idx) for r in requests.newest_only(found, requests.last_other(df)).collect()}
    assert newest == {("r1", 2), ("r2", 0), ("r3", 3), ("r3", 4), ("r4", 1), ("r4", 2), ("r5", 1)}
    assert {r.request_id: r.user_text for r in requests.last_user_text(df).collect()} == {"r1": "go on", "r3": "hi", "r4": "do", "r5": "ask"}
    changed = found.withColumn("compressed", F.when(F.col("was_object"), "not json").otherwise(F.upper("text")))
    back = {r.request_id: r.body for r in requests.write_back(df, changed, df.select("request_id", F.lit("HINT").alias("hint"))).collect()}
    assert back["r6"] == "{broken" and json.loads(back["r5"])["contents"][1]["parts"][0]["functionResponse"]["response"] == {"b": 1, "a": [1, 2.5]}
    assert json.loads(back["r1"])["messages"][2]["content"][0]["content"] == "BODY ONE" and json.loads(back["r1"])["messages"][2]["content"][2]["text"] == "go on\n\nHINT"
    assert json.loads(back["r3"])["messages"][0]["content"] == "hi\n\nHINT" and json.loads(back["r4"])["input"][2]["output"][0]["text"] == "P"


def test_decode_and_auth(spark):
    data = "héllo" * 10
    import zstandard

    rows = [(gzip.compress(data.encode()), "gzip"), (zlib.compress(data.encode()), "Deflate"), (data.encode(), None), (data.encode(), "rot13"), (b"bad", "gzip"), (zstandard.ZstdCompressor().compress(data.encode()), "zstd"), (gzip.compress(b"x" * 10000), "gzip"), (b"\xff", None), (None, "gzip")]
    got = [r.t for r in spark.createDataFrame(rows, "b binary, e string").select(requests.decode_body(1000)("b", "e").alias("t")).collect()]
    assert got == [data, data, data, None, None, data, None, None, None]
    rows = [("acc", None), (None, "Bearer sk-1"), (None, "bearer eyJa.b.c"), (None, "Bearer eyJa.b"), (None, None)]
    got = [r.m for r in spark.createDataFrame(rows, "a string, h string").select(requests.auth_mode(F.col("a"), F.col("h")).alias("m")).collect()]
    assert got == ["oauth", "api-key", "oauth", "unknown", "unknown"]
    hinted = spark.createDataFrame([("POST", "/v1/chat/completions", "kimi"), ("POST", "/v1/chat/completions", "gemini"), ("GET", "/v1/messages", None)], "m string, u string, h string")
    assert [r.p for r in hinted.select(requests.provider(F.col("m"), F.col("u"), F.col("h")).alias("p")).collect()] == ["kimi", "openai", None]


def blocks(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spaced = "\n".join(f"row {i}" + " " * 30 for i in range(40))
    lines = [f"line {i} of a file that is read again" for i in range(30)]
    again = "\n".join(lines[:-1] + ["the last line is new"])
    rows = [
        ("r1", "s", at(1), 1, None, spaced, None), ("r1", "s", at(1), 2, None, spaced, None), ("r1", "s", at(1), 3, None, "tiny", None), ("r1", "s", at(1), 4, "/f", "\n".join(lines), None),
        ("r2", "s", at(2), 1, "/f", again, None), ("r2", "s", at(2), 2, None, json.dumps([{"id": i, "name": f"n{i}"} for i in range(30)], indent=1), None), ("r2", "s", at(2), 3, None, "failed", "error"),
        ("r3", "s", at(3), 1, None, "\n".join(lines), None), ("r3", "s", at(3), 2, None, f"API_KEY=abcdef123456 {'w ' * 120}", None), ("r3", "s", at(3), 3, None, None, None), ("r3", "s", at(3), 4, None, f'{{"id": 12345678901234567890, "x":   "{"y" * 300}"}}', None),
        ("r1", "s", at(1), 5, None, "\n".join(lines[:20] + [f"new {i}" for i in range(4)] + lines[24:]), None),
    ]
    rows.append(("r3", "s", at(3), 5, None, "word " * 9000, None))
    return spark.createDataFrame(rows, "request_id string, session_key string, ts timestamp, ord long, path string, text string, skip string")


def test_compact(spark):
    stages = ("cmd-strip", "minify", "toon", "strip-lines", "whitespace", "dedup", "diff", "read-diff", "prune", "graph", "disclosure", "bm25-trim")
    user = spark.createDataFrame([("r1", "look"), ("r2", "debug it"), ("r3", "look")], "request_id string, user_text string")
    done = compact.compact(blocks(spark), Config(stages=stages, disclosure_bytes=8192, trim_bytes=600), user).collect()
    method = {(r.request_id, r.ord): r.method for r in done}
    assert len(done) == 13
    assert method[("r1", 2)] == "dedup" and method[("r1", 1)] == "normalize" and method[("r3", 5)] == "disclosure" and method[("r1", 3)] is None and method[("r1", 5)] == "diff"
    assert method[("r2", 1)] == "read-diff" and method[("r2", 2)] == "toon" and method[("r2", 3)] is None and method[("r3", 1)] == "graph"
    assert method[("r3", 2)] == "redact" and method[("r3", 3)] is None and method[("r3", 4)] is None
    assert {r.skipped for r in done if r.method is None} == {"error", "empty", "no gain"}
    assert all(r.compressed_len < r.original_len for r in done if r.method not in (None, "redact")) and "abcdef123456" not in next(r.compressed for r in done if r.method == "redact")
    plain = {(r.request_id, r.ord): r.method for r in compact.compact(blocks(spark), Config(stages=("whitespace",), redact=False)).collect()}
    assert plain[("r1", 1)] == plain[("r1", 2)] == "normalize" and plain[("r3", 2)] is None
    totals = stats.session_totals(compact.compact(blocks(spark), Config(stages=stages)), "session_key").first()
    assert totals.requests == 3 and totals.saved > 0


def test_paraphraser(spark):
    text = "some words of prose that go on " * 20
    df = spark.createDataFrame([(1, text), (2, text + " see /usr/local/bin"), (3, "short")], "id int, text string")
    compact.PARAPHRASERS["llmlingua"] = lambda c: F.substring(c, 1, 50)
    try:
        got = {r.id: r.method for r in compact.rewrite_rows(df, Config(stages=("llmlingua", "textpress"))).collect()}
    finally:
        compact.PARAPHRASERS.clear()
    assert got == {1: "llmlingua", 2: None, 3: None}


def test_rules(spark):
    tasks = spark.createDataFrame([("safe",), ("dangerous",), ("complex",)], "task_type string")
    rules = lambda mode, agent=None: {r.task_type: r.rules for r in compact.output_rules(tasks, mode, agent).collect()}
    assert all(rules("conservative").values()) and all(rules("aggressive").values()) and rules("balanced")["dangerous"] == "" and rules("balanced", "codex")["safe"] != rules("balanced")["safe"]
    doc = spark.createDataFrame([("# A\n\n## Output rules\n\nold\n\n## Next\nstay",), ("# B",)], "d string").select(compact.rule_section(F.col("d"), F.lit("new $1")).alias("d"))
    assert [r.d for r in doc.collect()] == ["# A\n\n## Output rules\n\nnew $1\n\n## Next\nstay", "# B\n\n## Output rules\n\nnew $1\n"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": ["v"] * 100}, indent=4))
    (tmp_path / "b.md").write_text("plain")
    found = files.rewrite_files(files.read_files(spark, str(tmp_path)))
    got = {r.path.split("/")[-1]: (r.strategy, r.method) for r in found.collect()}
    assert got == {"a.json": ("json", "toon"), "b.md": ("markdown", None)}
    files.write_files(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and (tmp_path / "a.json").read_text().startswith("{\n")


def test_disclosure_summary_sizes(spark, tmp_path):
    """Sizes in KB as C prints them: ties to the even digit, and no MB."""
    import duckdb

    sizes = [8192 + 128 * k for k in range(16)] + [8243, 10 * 1024 + 51, 1024 * 1024 + 256, 3 * 1024 * 1024 + 768]
    spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line) for r in queries.disclosure_summary(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(f"SELECT doc_id, line FROM ({queries.ORACLE_SQL['disclosure_summary']})").fetchall())


def test_bodies_by_slices():
    """No more than a slice of a batch's values are Python objects at a time; nulls and empty batches go through."""
    import pyarrow as pa

    class Batch:
        def __init__(self, values):
            self.values, self.most = values, 0

        def __len__(self):
            return len(self.values)

        def slice(self, start, n):
            part = pa.array(self.values[start : start + n], pa.string())
            self.most = max(self.most, len(part))
            return part

    batch = Batch([None if k % 7 == 0 else f"text {k}" for k in range(1000)])
    out = requests.by_slices(lambda t: None if t is None else t.upper(), pa.string(), batch)
    assert out.to_pylist() == [None if t is None else t.upper() for t in batch.values] and batch.most <= 256
    assert requests.by_slices(str, pa.string(), pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_candidates_of_a_line_that_all_texts_share(spark, least):
    """No alike pair is lost, and texts that share no more than one very frequent line are no pairs to compare."""
    rng = random.Random(7)
    rows = [(k % 2, k, "\n".join(dict.fromkeys(rng.choice("abcdefghij") * 9 for _ in range(rng.randrange(1, 7))))) for k in range(80)]
    rows += [(2, 1000 + k, f"one line that all share\nthe second of {k}\nthe third of {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, text string")
    first = {}
    for g, k, t in rows:
        first.setdefault((g, t), k)
    want = {(min(a, b), max(a, b)) for ((g, s), a), ((h, t), b) in itertools.combinations(first.items(), 2) if g == h and slow_jaccard(s, t) > least}
    met = {(r.a, r.b) for r in similarity.candidates(similarity.distinct_texts(df, "id", "text", "g"), least).collect()}
    assert met == want and not any(a >= 1000 for a, _ in met)
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, "id", least=least, group="g").collect()} == want
