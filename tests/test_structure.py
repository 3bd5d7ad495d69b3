"""Blocks, innermost blocks, scores and trims against plain versions of one text at a time."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import fixtures
from palimpsest.operators import ranking, structure, trim

TEXTS = "id int, text string, path string"


def programs():
    rng = random.Random(21)
    out = []
    for i in range(60):
        lines, depth = [], 0
        for _ in range(rng.randrange(3, 45)):
            kind = rng.randrange(6)
            if kind == 0:
                lines.append("  " * depth + rng.choice(["f() {", "{ {", "x = {'}': 1, b: {"]))
                depth += lines[-1].count("{")
            elif kind == 1 and depth:
                depth -= 1
                lines.append("  " * depth + "}")
            else:
                lines.append("  " * depth + rng.choice(["x = '{'", "y // {", "z", "", "/* { */ w", "`{\n}` {}", "/* {\n{ */", 'q = "\\"{"', "a = 'open {", "# }", "\\'"]))
        if rng.random() < 0.9:
            lines += ["}"] * depth
        out.append((i, "\n".join(lines), "a.js"))
    return out


def marked(text):
    """Lines with only the braces that count, or None where the last comment stays open."""
    out, state = [], ""
    for line in text.split("\n"):
        kept, i = "", 0
        while i < len(line):
            two = line[i : i + 2]
            if state == "/*":
                if two == "*/":
                    state, i = "", i + 1
            elif state:
                if line[i] == "\\":
                    i += 1
                elif line[i] == state:
                    state = ""
            elif two == "//" or line[i] == "#":
                break
            elif two == "/*":
                state, i = "/*", i + 1
            elif line[i] in "\"'`":
                state = line[i]
            elif line[i] in "{}":
                kept += line[i]
            i += 1
        state = state if state in ("`", "/*") else ""
        out.append(kept)
    return None if state == "/*" else out


def brute_braces(text):
    lines = marked(text)
    events = [(i, c) for i, line in enumerate(lines or []) for c in line]
    depth = 0
    for _, c in events:
        depth += 1 if c == "{" else -1
        if depth < 0:
            return []
    if depth:
        return []
    out = []
    for k, (head, c) in enumerate(events):
        depth = 0
        for close, d in events[k:] if c == "{" else []:
            depth += 1 if d == "{" else -1
            if depth == 0:
                out += [(head, head + 1, close - 1, close)] if close > head + 1 else []
                break
    return sorted(out)


def brute_indents(text):
    lines, out = text.split("\n"), []
    width = lambda x: len(x) - len(x.lstrip(" \t"))
    for i, line in enumerate(lines):
        if re.match(r"\s*(?:async\s+)?(?:def|class|if|for|while|with|try|elif|else|except|finally)\b.*:\s*$", line):
            last = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip(" \t\r"):
                    if width(lines[j]) <= width(line):
                        break
                    last = j
            out += [(i, i + 1, last, None)] if last > i else []
    return sorted(out)


def outlines():
    rng = random.Random(22)
    parts = ["if x:", "def f(a):", "for i in y:  ", "z", "", "  \t", "else:", "async def g():", "iffy:", "class A: pass", "try:\r"]
    return [(i, "\n".join(rng.choice(["", "  ", "    ", "      ", "\t"]) + rng.choice(parts) for _ in range(rng.randrange(1, 40))), "b.py") for i in range(100, 160)]


@pytest.mark.parametrize("make, brute", [(programs, brute_braces), (outlines, brute_indents)])
def test_blocks_and_parents(spark, make, brute):
    given = make()
    df = spark.createDataFrame(given, TEXTS).repartition(3)
    got = {}
    for r in structure.blocks(df, ["id"]).collect():
        got.setdefault(r.id, []).append((r.head, r.first, r.last, r.closer))
    want = {i: brute(t) for i, t, _ in given}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 60
    parents = {(r.id, r.line): r.parent for r in structure.line_parents(df, ["id"]).collect()}
    assert len(parents) == sum(t.count("\n") + 1 for _, t, _ in given)
    for (i, line), parent in parents.items():
        around = [b for b in want[i] if b[1] <= line <= b[2]]
        assert parent == (max(around, key=lambda b: (b[1], -b[2]))[0] if around else -1)


def test_language(spark):
    many = "\n".join(["f {"] * 3 + ["x"] * 9)
    rows = [(1, "x", "a.TS"), (2, "x", "a.b.py"), (3, many, None), (4, many, "notes.txt"), (5, "f {\n" * 3, None), (6, "if x:\n y\n" * 6, None), (7, None, "a.c"), (8, None, None), (9, many + "\nif x:" * 4, "x")]
    got = spark.createDataFrame(rows, TEXTS).select("id", structure.language(F.col("text"), F.col("path")).alias("kind")).collect()
    assert {r.id: r.kind for r in got} == {1: "brace", 2: "indent", 3: "brace", 4: "brace", 5: None, 6: "indent", 7: "brace", 8: None, 9: "indent"}


def test_tree_nodes(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a, 40)] + [(0, 2**30 - 2), (5, 10**9)]
    for r in spark.createDataFrame(pairs, "a int, b int").select("a", "b", structure.tree_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        spans = sorted((x.node << x.level, (x.node + 1 << x.level) - 1) for x in r.n)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))
        assert max(Counter(x.level for x in r.n).values()) <= 2


def test_deep_nesting(spark):
    """20,000 blocks within one another: a row a line and level, not one a line and block."""
    n = 20_000
    df = spark.createDataFrame([(1, "{\n" * n + "x\n" + "}\n" * n, "a.c")], TEXTS)
    got = {r.line: r.parent for r in structure.line_parents(df, ["id"]).collect()}
    assert got[n] == n - 1 and all(got[i] == i - 1 for i in range(1, n)) and got[n + 1] == n - 2 and got[2 * n] == -1


def test_long_tokens(spark):
    rows = [(1, "{\n'" + "\\'" * 200_000 + "'\n}", "a.c"), (2, "{\n/*" + "x\n" * 100_000 + "*/\n}", "a.c"), (3, "`" + "{ \n" * 50_000, "a.c"), (4, "{\n\n/*", "a.c"), (5, "", "a.c"), (6, None, "a.c")]
    got = {r.id: (r.head, r.closer) for r in structure.blocks(spark.createDataFrame(rows, TEXTS), ["id"]).collect()}
    assert got == {1: (0, 2), 2: (0, 100_002)}


def slow_tokens(text):
    joint = re.compile(r"([A-Za-z0-9])[._\-]+([A-Za-z0-9])")
    out = []
    for word in re.split(r"[^A-Za-z0-9_]+", joint.sub(r"\1_\2", joint.sub(r"\1_\2", text))):
        parts = re.sub("_+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", word))).split(" ")
        out += [p.lower() for p in [word, *(parts if len(parts) > 1 else [])] if len(p) >= 2]
    return out


def slow_scores(lines, query, rerank):
    wanted, toks = set(slow_tokens(query)), [slow_tokens(x) for x in lines]
    mean = sum(map(len, toks)) / len(lines)
    df = Counter(t for ts in toks for t in set(ts) & wanted)
    out = []
    for ts, line in zip(toks, lines):
        s = sum(math.log(1 + (len(lines) - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in set(ts) & wanted)
        if rerank:
            named = re.search(r"(?<![A-Za-z0-9_])(?:function|class|def|const|let|var)\s+([A-Za-z_$][\w$]*)", line)
            s *= 1.6 if named and wanted & set(slow_tokens(named[1])) else 1
            s *= 0.6 if re.match(r"\s*(?://|#|\*|/\*|--|<!--|;)", line) else 1
        out.append(s)
    edge = [0.0, *out, 0.0]
    return [s + 0.25 * max(edge[i], edge[i + 2]) for i, s in enumerate(out)] if rerank and len(lines) >= 3 else out


def test_scores(spark):
    lines = [line for _, line in fixtures.CODE]
    asks = ["where is parseToken and the token store", "value", ""]
    df = spark.createDataFrame([(t, i, x) for t in range(3) for i, x in enumerate(lines)], "t int, line int, text string")
    scored = ranking.bm25(df, spark.createDataFrame(list(enumerate(asks)), "t int, ask string"), "t", "line", "text", None, "ask")
    whole = df.join(scored, ["t", "line"], "left").fillna(0.0, ["score"])
    for t, ask in enumerate(asks):
        got = ranking.rerank(whole.where(f"t = {t}"), "t", "line", "text", "score", ranking.tokens(F.lit(ask))).orderBy("line").collect()
        assert [r.score for r in got] == pytest.approx(slow_scores(lines, ask, False))
        assert [r.reranked for r in got] == pytest.approx(slow_scores(lines, ask, True))
    some = ["É straße ISO-8859 XMLParser __init__ HTTPserver v2Beta3", "getHTTPResponse_code", "a.b-c", "x", "", "snake_case camelCase"]
    toks = spark.createDataFrame([(s,) for s in some], "x string").select(ranking.tokens(F.col("x")).alias("t")).collect()
    assert [sorted(r.t) for r in toks] == [sorted(slow_tokens(s)) for s in some]


CODE = "\n".join(["import x", "class Store {", "  read(key) {", "    return this.map[key]", "  }", "", "  write(key) {", "    this.map[key] = 1", "  }", "}"] + [f"log line {i} with nothing of note" for i in range(60)] + ["end"])


def slow_trim(text, query, path, budget):
    """The lines that stay, chosen one by one from a set of all."""
    estimate = lambda s: max(1, math.ceil(len(s) / 4))
    lines = text.split("\n")
    n, ratio = len(lines), min(len(text) / estimate(text), 4)
    cost = [max(1, math.ceil((len(x) + 1) / ratio)) for x in lines]
    found = brute_braces(text) if path.endswith("js") else brute_indents(text)
    parent = lambda i: max((b for b in found if b[1] <= i <= b[2]), key=lambda b: (b[1], -b[2]), default=(-1,))[0]
    score = [round(s, 9) for s in slow_scores(lines, query, True)]
    keep = {0, n - 1, max((i for i in range(n) if lines[i]), default=0)}
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        need, more = {i} - keep, {i} - keep
        while more:
            near = {j for b in found for x in more if x in (b[0], b[3]) for j in (b[0], b[3])} | {parent(x) for x in more}
            more = {j for j in near if j is not None and j >= 0} - keep - need
            need |= more
        if sum(cost[j] for j in keep | need) <= budget:
            keep |= need
    for run in re.finditer("b+", "".join("b" if i in keep and not x.strip() and 0 < i < n - 1 else "." for i, x in enumerate(lines))):
        if run.start() - 1 not in keep and run.end() not in keep:
            keep -= set(range(*run.span()))
    out = []
    for i, x in enumerate(lines):
        if i in keep:
            out.append(x)
        elif i - 1 in keep:
            end = next(j for j in range(i, n) if j in keep)
            out.append(f"{x[: len(x) - len(x.lstrip(chr(32) + chr(9)))]}[... {end - i} lines omitted, {sum(len(y) + 1 for y in lines[i:end])} chars ...]")
    return "\n".join(out)


def test_trim(spark):
    rng = random.Random(5)
    filler = lambda n: "\n".join(" ".join(rng.choices(["map", "key", "note", "zero", "", "one two"], k=rng.randrange(9))) for _ in range(n))
    given = [(1, CODE, "write key map", "a.js"), (2, CODE, "read", "a.js"), (3, CODE, "nothing known", "a.js")]
    given += [(10 + k, f"{t}\n\n{filler(60)}\n", "map key f", p) for k, (_, t, p) in enumerate(programs()[:12] + outlines()[:12])]
    df = spark.createDataFrame(given + [(90, CODE[:60], "write", "a.js"), (91, None, "x", "a.js"), (92, "x" * 9000, "x", "a.js"), (93, CODE, None, None)], "id int, text string, query string, path string")
    got = {r.id: r for r in trim.trim(df.repartition(3), ["id"], budget=120).collect()}
    assert {90, 91, 92}.isdisjoint(got) and {1, 2, 3, 93} <= set(got)
    for i, text, query, path in given:
        if i in got:
            assert got[i].trimmed == slow_trim(text, query, path, 120), i
            assert got[i].kept_lines + got[i].dropped_lines == text.count("\n") + 1
    assert len(got) > 15
    kept = got[1].trimmed
    assert "  write(key) {" in kept and "class Store {" in kept and kept.startswith("import x") and kept.endswith("end") and got[1].used <= 120


def test_top_by_bounds(spark, monkeypatch):
    """Equal to ranking all scores, ties by line; with a rare term in each query few pairs are looked at closely."""
    rng = random.Random(12)
    common = [f"word{k}" for k in range(12)]
    rows = [(t, i, " ".join(rng.choices(common, weights=[1 / (k + 1) for k in range(12)], k=rng.randrange(1, 40)) + rng.choices([f"rare{r}" for r in range(60)], k=rng.randrange(2)))) for t in range(2) for i in range(900)]
    rows += [(0, 900 + i, rows[3][2]) for i in range(15)] + [(0, 950, None), (0, 951, "")]
    asks = [(k, f"{rng.choice(common)} {rng.choice(common)} rare{k} rare{k + 1}") for k in range(40)] + [(90, "word1 word0"), (91, "absent"), (92, None), (93, "")]
    docs, queries = spark.createDataFrame(rows, "t int, line int, text string").repartition(3), spark.createDataFrame(asks, "q int, ask string")
    whole = {}
    for r in ranking.bm25(docs, queries, "t", "line", "text", "q", "ask").collect():
        whole.setdefault((r.t, r.q), []).append((-round(r.score, 6), r.line))
    held = []
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: held.append((name, out := real(df, name))) or out)
    for k in (1, 10, 5000):
        got = {}
        for r in ranking.bm25_top(docs, queries, "t", "line", "text", "q", "ask", k).collect():
            got.setdefault((r.t, r.q), []).append((-r.score, r.line))
        assert {key: sorted(v) for key, v in got.items()} == {key: sorted(v)[:k] for key, v in whole.items()}
    hopeful = [df.where("q < 90").count() for name, df in held if name == "hopeful"]
    assert hopeful[1] < 0.1 * sum(len(v) for key, v in whole.items() if key[1] < 90)


def test_scores_within_the_row(spark):
    """Scores of a text's lines as arrays equal the plain version, and a trim deals no lines out."""
    texts = [CODE, "one\ntwo", "", "// parseToken here\nfunction parseToken(a) {\nmy_token x.y-z HTTPServer\n\nclass Zero", "K one Kelvin\nparse_token"]
    ask = "where is parseToken or the write key map, x_y and HTTPServer one"
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("x", F.split("text", "\n", -1)).withColumn("terms", F.array_distinct(ranking.tokens(F.lit(ask))))
    df = df.withColumn("s", ranking.line_scores("x", "terms"))
    for r in df.withColumn("r", ranking.reranked_lines("x", "s", "terms")).collect():
        assert r.s == pytest.approx(slow_scores(r.x, ask, False)) and r.r == pytest.approx(slow_scores(r.x, ask, True))
    given = spark.createDataFrame([(1, CODE, "write key map", "a.js")], "id int, text string, query string, path string")
    assert "posexplode" not in trim.trim(given, ["id"], budget=120)._jdf.queryExecution().optimizedPlan().toString()


def test_trim_works_a_text_out_once(spark):
    """A text that an expression makes is made once a row, and the trimmed one put together once, whatever is asked of them."""
    made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda k: F.concat(F.lit("entry "), k, F.lit(" of marked lines"))), "\n")
    given = spark.range(1, 4).select("id", made.alias("text"), F.lit("entry 70").alias("query"), F.lit("a.txt").alias("path"))
    done = trim.trim(given, ["id"], budget=60)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("of marked lines") == 1 and plan.count("lines omitted") == 1
    text = "\n".join(f"entry {k} of marked lines" for k in range(1, 81))
    assert {r.id: r.trimmed for r in done.collect()} == {i: slow_trim(text, "entry 70", "a.txt", 60) for i in (1, 2, 3)}


def test_scores_of_few_lines(spark):
    """Most lines are not tokenised, only counted: scores equal those of tokens taken out of every line, and a change of
    case is found where it was."""
    rng = random.Random(8)
    bits = ["where", "parseToken", "parse-token", "a.b.c", "x", "_", "__init__", "HTTPServer", "Zero", "k\u212a1", "\u0130x", "ABc", "A1b", "9Z", "..", "-", "caf\u00e9Bar", "snake_case.py", "zz", ""]
    texts = ["\n".join(rng.choice([" ", "", ".", "-"]).join(rng.choices(bits, k=rng.randrange(7))) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    asks = ["parseToken", "nothing of it", "", "zz b.c init", "k1 ix server where 9z"]
    df = spark.createDataFrame([(t, a) for t in texts for a in asks], "text string, ask string")
    df = df.select("ask", F.split("text", "\n", -1).alias("x"), F.array_distinct(ranking.tokens(F.col("ask"))).alias("terms")).withColumn("s", ranking.line_scores("x", "terms"))
    for r in df.collect():
        assert r.s == pytest.approx(slow_scores(r.x, r.ask, False)), (r.x, r.ask)
    shown = spark.createDataFrame([("".join(rng.choices("aB9_ Cd\u00e9", k=rng.randrange(6))),) for _ in range(600)], "x string")
    assert shown.where(F.col("x").rlike("_|[a-z0-9][A-Z]|[A-Z]{2}[a-z]") != F.col("x").rlike(ranking.SEVERAL)).isEmpty()


def test_scores_within_tasks(spark, monkeypatch):
    """Pairs are scored without an exchange, and equal those of the joins, which take over where terms are too many
    or a line is in two rows; nulls, repeated queries and targets without a token too."""
    from palimpsest.operators import postings

    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(40)] + ["snake_case", "camelCase", "a.b-c"]
    rows = [(t, i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for t in range(3) for i in range(120)]
    rows += [(0, 500, None), (0, 501, ""), (None, 502, "word1 word2"), (7, 1, ""), (7, 2, None)]
    asks = [(k, " ".join(rng.choices(vocabulary, k=5))) for k in range(25)] + [(3, "word1 word2 case"), (None, "word3 word4"), (90, None), (91, "absent")]
    docs, queries = spark.createDataFrame(rows, "t int, line int, text string").repartition(3), spark.createDataFrame(asks, "q int, ask string")
    read = lambda df: sorted(((r.t, r.line, r.q is None, r.q or 0, round(r.score, 9)) for r in df.collect()))
    within = ranking.bm25(docs, queries, "t", "line", "text", "q", "ask")
    assert "Exchange" not in within._jdf.queryExecution().executedPlan().toString()
    twice = docs.union(docs.where("line = 5"))
    double = read(ranking.bm25(twice, queries, "t", "line", "text", "q", "ask"))
    monkeypatch.setattr(postings, "MOST_TERMS", 0)
    joined = ranking.bm25(docs, queries, "t", "line", "text", "q", "ask")
    assert len(read(within)) > 3000 and read(within) == read(joined)
    assert double == read(ranking.bm25(twice, queries, "t", "line", "text", "q", "ask"))


def test_heads_are_enough(spark):
    """The head by a cut gives the same NDCG and recall as all pairs, with ties, a line that costs more than the
    budget and gold ones far behind, and most pairs are left out."""
    from palimpsest.operators import postings

    rng = random.Random(8)
    words = [f"word{k}" for k in range(20)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(20)], k=rng.randrange(1, 40)))) for i in range(3000)]
    rows += [(5000 + i, rows[3][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "line int, text string").withColumn("t", F.lit(1)).repartition(2)
    queries = spark.createDataFrame([(k, " ".join(rng.sample(words, 3))) for k in range(20)], "q int, ask string")
    marks = spark.createDataFrame([(i, 5000 if i % 50 == 0 else 1 + i % 9, None if i % 11 == 0 else i % 3 == 0) for i, _ in rows if i != 17], "line int, cost long, gold boolean")
    scored = ranking.bm25(docs, queries, "t", "line", "text", "q", "ask").withColumn("score", F.round("score", 6))
    whole = scored.join(marks, "line").persist()
    head = lambda cut: ranking.bm25_head(docs, queries, "t", "line", "text", "q", "ask", cut, marks=marks, cost="cost", gold="gold").persist()
    best, near = head(postings.best(10, 1e-6)), head(postings.affordable(60, 1e-6))
    pairs = whole.count()
    assert best.count() < pairs / 4 and near.count() < pairs / 2
    same = lambda a, b: {r.q: r[1] for r in a.collect()} == {r.q: r[1] for r in b.collect()}
    assert same(ranking.ndcg(whole, "q", "score", "line", "gold"), ranking.ndcg(best, "q", "score", "line", "gold", rest="rest"))
    assert same(ranking.recall_within(whole, "q", "score", "line", "cost", "gold", 60), ranking.recall_within(near, "q", "score", "line", "cost", "gold", 60, "rest"))
    assert best.where("rest is null").exceptAll(whole.select("t", "q", "line", "score", "cost", "gold", F.lit(None).cast("long"))).count() == 0


def test_top_by_bounds_exchanges_no_postings(spark):
    """Bounds are held and used within tasks: the terms that lead are few, and the plan has no join of postings."""
    from palimpsest.operators import postings

    rows = [(k, f"plain words of line{k % 50} " + ("rare" if k % 100 == 7 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "line int, text string").withColumn("t", F.lit(1))
    queries = spark.createDataFrame([(1, "plain rare words"), (2, "line3 of")], "q int, ask string")
    top = ranking.bm25_top(docs, queries, "t", "line", "text", "q", "ask", 4)
    assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.q, r.line) for r in top.collect()} == {(1, k) for k in (7, 107, 207, 307)} | {(2, k) for k in (3, 53, 103, 153)}
    by = postings.Asked(["plain", "rare"], [1], np.array([0, 1, 2]), np.array([0, 0]))
    most = np.zeros((1, postings.BLOCKS, 2))
    most[0, 2] = 0.1, 5.0
    lead, rest = postings.leads(most, np.array([[4.0]]), by)
    assert lead[0, 2].tolist() == [False, True] and rest[0, 2, 0] == pytest.approx(0.1) and not lead[0, 3].any()
