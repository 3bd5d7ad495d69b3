"""The source audit against every group and every term taken one by one."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    docs, groups, counts = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        q = shares(whole)
        for g in groups:
            if g[0] != lang:
                continue
            p = shares(counts[g])
            pairs = [(o[1], sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for o in groups if o[0] == lang and o != g for r in [shares(counts[o])]]
            terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[g][t] > 0 and p[t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, item, value, k + 1) for k, (item, value) in enumerate(items[:limit])]
    return out


def rows():
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Ünder", "éa", "日本", "ZZ", "zz", "É"]
    some = [None, "", "a", "b", "c-d", "é"]
    out = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "en", None, "", "fr"]), rng.choice(["a", "a", "a", *some])
        mine = vocabulary[:30] if source == "a" else vocabulary
        text = rng.choice([" ", "-1-", "\x00", "@["]).join(rng.choices(mine, weights=[1 / (k + 1) for k in range(len(mine))], k=rng.randrange(60)))
        out.append((i, text, lang, source))
    out += [(300, None, "en", "empty"), (301, "", "en", "none"), (302, "123 !!", "xx", "only"), (303, "rare word", "yy", "a"), (304, "rare word", "yy", "b")]
    out += [out[5], out[5], (None, "wa WB", None, None), (305, "wa " * 5000, "en", "long")]
    return out


def test_audit(spark):
    given = rows()
    got = divergence.audit(spark.createDataFrame(given, DOCS).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(given))
    assert len(got) > 500


def test_limits(spark):
    given = rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in given], DOCS + ", term string, value int")
    got = divergence.audit(docs, least_docs=1, top=7).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(given, 1, 7))
    assert divergence.audit(docs, least_docs=10**6).where("value <> 0 or part = 'term'").count() == 0
    assert divergence.audit(docs.where("doc_id < 0")).count() == 0


def test_shares_beyond_64_bits(spark):
    """10^15 occurrences of a term: the product with the scale takes 80 bits."""
    given = [(0, 10**15, 10**6), (10**15 - 1, 10**15, 10**6), (7 * 10**14, 9 * 10**15, 1)]
    got = spark.createDataFrame(given, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in got.collect())
