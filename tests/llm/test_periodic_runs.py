"""Periodic runs against trying every period at every word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import periodic_runs, queries


def brute(words, least=24, rounds=3):
    n, found = len(words), {}
    for q in range(1, n // rounds + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(least, rounds * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences(rng, times):
    for _ in range(times):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            if words:
                at, period, again = rng.randrange(len(words)), rng.randrange(1, 9), rng.randrange(2, 9)
                words[at:at] = (words[at : at + period] * again) + words[at : at + rng.randrange(period)]
        yield words


@pytest.mark.parametrize("least,rounds", [(24, 3), (2, 2), (5, 2), (9, 3), (4, 4)])
def test_against_brute_force(least, rounds):
    for words in sequences(random.Random(least), 500):
        got = [tuple(r) for r in periodic_runs.runs(np.array(words, np.int64), least, rounds).tolist()]
        assert got == brute(words, least, rounds)


def test_branching_repeats():
    """Every one of them, and no other."""
    for words in sequences(random.Random(6), 300):
        n, want = len(words), set()
        for d in range(1, n // 2 + 1):
            for i in range(n - 2 * d + 1):
                if words[i : i + d] == words[i + d : i + 2 * d] and (i + 2 * d == n or words[i + d] != words[i + 2 * d]):
                    want.add((i, d))
        assert set(zip(*(c.tolist() for c in periodic_runs.tandem_repeats(np.array(words, np.int64))))) == want


def test_hard_sequences():
    """Runs of one word, long ramps of common prefixes, Fibonacci and Thue-Morse words, within seconds."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    morse = [bin(i).count("1") & 1 for i in range(3000)]
    for words in (b, morse, [0] * 3000, ([1, 2] * 30 + [3]) * 40, list(range(700)) * 4):
        got = [tuple(r) for r in periodic_runs.runs(np.array(words, np.int64)).tolist()]
        assert got == brute(words)
    assert periodic_runs.runs(np.zeros(400_000, np.int64)).tolist() == [[0, 400_000, 1]]
    assert periodic_runs.runs(np.arange(400_000) % 999).tolist() == [[0, 400_000, 999]]


def test_texts_of_a_task_stay_apart():
    words, number, begin = periodic_runs.numbered([b"a a a", b"", b"a b\ta\n", "é é".encode()])
    assert [len(w) for w in words] == [3, 0, 3, 1] and begin.tolist() == [0, 3, 3, 6, 7]
    assert len(set(number.tolist())) == 4


def rows():
    rng = random.Random(9)
    out = []
    for i in range(120):
        words = [f"w{x}" for x in next(sequences(rng, 1))]
        for _ in range(rng.randrange(3)):
            words += [f"v{rng.randrange(4)}" for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 20)
        out.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return out + [(200, None), (201, ""), (202, " \n "), (None, "x " * 50), out[3], out[3], (203, "na na " * 30), (204, "long tail " * 30000)]


def test_collapse(spark, monkeypatch):
    given = rows()
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in given], "doc_id long, text string, runs string, start int").repartition(3)
    got = periodic_runs.collapse(docs)
    assert got.columns == ["doc_id", "start", "runs", "text"]
    want = []
    for i, t in given:
        words = split(t)
        found = brute(words) if i != 204 else [(0, 60000, 2)]
        want.append((i, found, collapsed(words, found)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(bool(w[1]) for w in want) > 30
    assert periodic_runs.collapse(docs.where("doc_id < 0")).count() == 0


def test_query(spark, tmp_path):
    given = rows() + [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(1000, 1200)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = set(), 0
    for i, text in given:
        words = split(text)
        if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
            g, n = zlib.crc32(str(i).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        else:
            words = words if text is None or words else []
        found = brute(words) if i != 204 else [(0, 60000, 2)]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapsed(words, found))]
        want.add((i, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, *digests))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want
    assert planted > 15
