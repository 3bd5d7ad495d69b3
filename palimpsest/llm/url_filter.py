"""URL filters by Bloom filter cascades.

Listed keys are rules, a host and the start of a path. A URL's candidate keys are its host and parent
domains, each with every path start of a listed length. The first level encodes the listed keys; the
second the keys of the corpus that the first takes wrongly for listed; the third the listed keys that
the second takes wrongly, and so on until a level takes none wrongly. As the levels are built over all
candidate keys of the corpus, an odd number of levels passed means listed, exactly, with no join.

One pass over the corpus finds all keys that the first level takes wrongly. Every later level is about
those and the listed keys alone. The first level's size follows from the number of candidate keys, so
that about as many keys are taken wrongly as are listed, however large the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LISTED = 4_000_000
MAX_LEVELS = 64
MAX_BITS = 64.0


class Bloom:
    """Bloom filter over UTF-8 keys, eight bits a byte; bits a key decide its false positives."""

    def __init__(self, keys: list[str], bits_per_key: float, level: int) -> None:
        self.size = max(64, math.ceil(len(keys) * bits_per_key))
        self.hashes = max(1, round(bits_per_key * math.log(2)))
        self.level = level
        bits = np.zeros((self.size + 7) // 8 * 8, bool)
        for key in keys:
            bits[self.places(key)] = True
        self.bits = np.packbits(bits, bitorder="little").tobytes()

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.level)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class Cascade:
    """Levels of Bloom filters; key in cascade is exact for keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def passed(self, key: str) -> int:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n
        return len(self.levels)

    def __contains__(self, key: str) -> bool:
        return self.passed(key) % 2 == 1


def first_bits(listed: int, keys: int) -> float:
    """Bits a listed key at which about `listed` of `keys` other keys pass."""
    return max(2.0, min(MAX_BITS, math.log2(max(2, keys) / max(1, listed)) / math.log(2)))


def completed(first: Bloom, listed: list[str], wrong: list[str], bits_per_key: float) -> Cascade:
    """The cascade of a first level and the keys that it takes wrongly: levels of those and of listed keys in turn."""
    levels, ours, theirs = [first], listed, wrong
    while theirs:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(Bloom(theirs, bits_per_key, len(levels)))
        # What the new level holds must not pass it on the other side: that is the next level's content.
        ours, theirs = theirs, [k for k in ours if k in levels[-1]]
    return Cascade(levels)


def build_cascades(universe: DataFrame, lists: list[list[str]], keys: int, bits_per_key: float | None = None, bound: int | None = None) -> list[Cascade]:
    """A cascade for each list of keys over universe(key), which may repeat keys; keys is their number or more.

    The lists are checked against a bound. The keys that a first level takes wrongly come back from one
    pass for all lists; if they should be more than the bound, the pass is taken again with more bits.
    bits_per_key sets the bits of all levels; a null key is no key.
    """
    bound = MAX_LISTED if bound is None else bound
    ours = [sorted(set(x)) for x in lists]
    for x in ours:
        if len(x) > bound:
            raise ValueError(f"{len(x)} listed keys; the bound of one cascade is {bound}: split the list by host")
    bits = [bits_per_key or first_bits(len(x), keys) for x in ours]
    while True:
        firsts = [Bloom(x, b, 0) for x, b in zip(ours, bits)]
        wrong = _passing(universe, firsts, [frozenset(x) for x in ours], bound)
        if wrong is not None:
            later = bits_per_key or 2.0
            return [completed(first, x, w, later) for first, x, w in zip(firsts, ours, wrong)]
        if min(bits) >= MAX_BITS:
            raise ValueError(f"more than {bound} keys pass wrongly with {MAX_BITS} bits a key")
        bits = [min(MAX_BITS, 2 * b) for b in bits]


def build_cascade(universe: DataFrame, listed: list[str], bits_per_key: float | None = None, bound: int | None = None) -> Cascade:
    """The cascade of one list over universe(key), whose keys are counted first."""
    keys = universe.where("key is not null").count() if bits_per_key is None else 1
    return build_cascades(universe, [listed], keys, bits_per_key, bound)[0]


def _passing(universe: DataFrame, firsts: list[Bloom], listed: list[frozenset], bound: int) -> list[list[str]] | None:
    """For each list the unlisted keys that pass its first level; None if they are more than bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keys = {k for k in batch.column("key").to_pylist() if k is not None} - seen
            found = [(n, k) for n, (first, own) in enumerate(zip(firsts, listed)) for k in keys if k in first and k not in own]
            if len(seen) < 1 << 16:  # keys come again and again; what was looked at need not be again
                seen |= keys
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], names=["list", "key"])

    found = universe.select(F.col("key").cast("string").alias("key")).mapInArrow(run, "list int, key string").distinct().limit(bound + 1).collect()
    if len(found) > bound:
        return None
    return [sorted(r.key for r in found if r.list == n) for n in range(len(firsts))]


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path start of a rule such as example.com/en/7; both are as written."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end with A-Z lower-cased, and from there up
    to ? # or the end; both empty if url is null or has no ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(
        F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """host and its parent domains of up to `labels` labels, each joined with the path starts of the lengths given."""
    if not host:
        return []
    parts = host.rsplit(".", labels)
    whole = [] if len(parts) > labels else [host]  # longer than any listed host
    hosts = whole + [".".join(parts[i:]) for i in range(1, len(parts))]
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [h + s for h in hosts for s in starts if h]


def filter_urls(pages: DataFrame, block: list[str], allow: list[str], default: str = "allow", bits_per_key: float | None = None, bound: int | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule
    wins, of equally long ones that of the longest host, and of a rule in both lists block. Where no
    candidate key is in a cascade, rule is null and the verdict is `default`. Null and malformed urls have
    empty host and path and fit no rule. Only as many labels of a host, from its end, are looked at as the
    longest listed host has. Lists of more than `bound` rules take further passes, each with cascades of
    its own, so no task holds more than these.
    """
    bound = MAX_LISTED if bound is None else bound
    host, path = parse_url(F.col("url"))
    parsed = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    split = [split_rule(r) for r in [*block, *allow]]
    lengths = sorted({len(p) for _, p in split}, reverse=True)
    labels = max((h.count(".") + 1 for h, _ in split), default=1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            keys = sorted({k for h, p in pairs for k in candidate_keys(h, p, lengths, labels)})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    universe = parsed.select("host", "path").mapInArrow(spread, "key string")
    most = pages.count() * labels * max(1, len(lengths)) if bits_per_key is None else 1
    kind = dict(parsed.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"

    def judged(rows: DataFrame, blocked: Cascade, allowed: Cascade) -> DataFrame:
        """rows with the longer of the rule that they have and of one in the cascades."""

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rules, verdicts = [], []
                for h, p, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict"))):
                    for key in sorted(candidate_keys(h, p, lengths, labels), key=len, reverse=True):
                        if key in blocked:
                            rule, verdict = key, "block"
                            break
                        if key == rule:  # no longer one here
                            break
                        if key in allowed:
                            rule, verdict = key, "allow"
                            break
                    rules.append(rule)
                    verdicts.append(verdict)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

        return rows.mapInArrow(judge, schema)

    out = parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    normal = [[h + p for h, p in map(split_rule, rules)] for rules in (block, allow)]
    for at in range(0, max(1, *map(len, normal)), bound):
        out = judged(out, *build_cascades(universe, [x[at : at + bound] for x in normal], most, bits_per_key, bound))
    return out
