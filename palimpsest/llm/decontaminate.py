"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Pairs of neighbouring words of the test items are seeds, and the words themselves where items are
short. An alignment that scores `least` keeps at least `needed` of an item's pairs whole and matches at
least that share of its words, so one of its rarest pairs and one of its rarest words, by document
frequency over the corpus, is among them: those are its triggers, and the most frequent ones are none. A
document that holds a trigger, and enough of the item's seeds within the reach of an alignment, is
aligned with the item word by word, so a paraphrased or edited copy scores by how much of the item it
keeps. All filters follow from the score, so no pair of document and item that scores `least` is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import union_all

MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.6
MAX_ITEM_BYTES = 64 << 20

#: ASCII other than letters and digits separates words, as white space does.
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; everything in ASCII but letters and digits separates them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def needed(n: int, least: float) -> int:
    """Neighbouring words of an item of n words that an alignment of this score keeps side by side.

    With m words matched in k blocks and at least k - 1 edits, 2m - (k - 1) >= 2n * least, so m - k is at
    least (2 * least - 1) * n - 1. Where that is no more than 0, blocks may be of one word each, and then
    all words of the item are matched.
    """
    return max(0, math.ceil((2 * least - 1) * n - 1 - 1e-9))


def matched(n: int, least: float) -> int:
    """Words of an item of n words that an alignment of this score matches, as each one adds 2 of 2n."""
    return math.ceil(least * n - 1e-9)


def reach(n: int, least: float) -> int:
    """Words of a document that an alignment of this score with an item of n words can cover."""
    return n + int((MATCH - MATCH * least) * n + 1e-9)


def ragged(ptr: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into rows, value) of all values of the rows chosen of a table of lists."""
    count = ptr[rows + 1] - ptr[rows]
    of = np.repeat(np.arange(rows.size), count)
    return of, values[ptr[rows][of] + np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)]


def lists(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the table of n lists with these (row, value) pairs."""
    table = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
    return np.searchsorted(table[:, 0], np.arange(n + 1)), table[:, 1]


class Seeds:
    """The distinct items as word codes, and their seeds: codes of word pairs, and of single words for
    items so short that no more than one pair need be left whole."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: float = LEAST_SCORE) -> None:
        if not 0.5 < least <= 1:
            raise ValueError("the least score is above 0.5 and at most 1")
        ids: dict[tuple[bytes, ...], set] = {}
        for i, text in items:
            if words := tuple(words_of(text)):
                ids.setdefault(words, set()).add(i)
        self.least = least
        self.ids = [sorted(x, key=lambda i: (i is None, i)) for x in ids.values()]
        vocabulary = sorted({w for words in ids for w in words})
        self.word = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        self.coded = [np.array([self.word[w] for w in words], np.int64) for words in ids]
        # Places that an alignment has at least: matched words where words are seeds, and else whole pairs.
        self.needed = np.array([matched(x.size, least) if self.short(x) else needed(x.size, least) for x in self.coded], np.int64)
        self.reach = np.array([reach(x.size, least) for x in self.coded], np.int64)
        own = [(code, k) for k, x in enumerate(self.coded) for code in self.of_item(x)]
        self.codes = np.array(sorted({code for code, _ in own}), np.int64)
        self.item_ptr, self.item_seeds = lists(list(zip((k for _, k in own), np.searchsorted(self.codes, [code for code, _ in own]).tolist())), len(self.coded))
        self.single = bool(self.codes.size) and int(self.codes[0]) < self.base
        self.rank(np.zeros(self.codes.size, np.int64))

    def short(self, coded: np.ndarray) -> bool:
        return needed(coded.size, self.least) <= 1

    def of_item(self, coded: np.ndarray) -> list[int]:
        pairs = (coded[:-1] * self.base + coded[1:]).tolist()
        return pairs + coded.tolist() if self.short(coded) else pairs

    def rank(self, frequency: np.ndarray) -> None:
        """Choose the triggers of every item by the document frequency of each seed."""

        def rarest(seeds: np.ndarray, spare: int) -> list[int]:
            """All kinds but the most frequent ones that together come no more than `spare` times."""
            kinds, count = np.unique(seeds, return_counts=True)
            out = []
            for seed, n in sorted(zip(kinds.tolist(), count.tolist()), key=lambda s: (-frequency[s[0]], s[0])):
                if n <= spare:
                    spare -= n
                else:
                    out.append(seed)
            return out

        triggers = []
        for k, x in enumerate(self.coded):
            at = np.searchsorted(self.codes, np.array(self.of_item(x), np.int64))
            pairs, words = at[: x.size - 1], at[x.size - 1 :]
            whole = needed(x.size, self.least)
            ways = [rarest(pairs, whole - 1)] if whole else []
            if words.size:
                ways.append(rarest(words, matched(x.size, self.least) - 1))
            best = min(ways, key=lambda way: sum(int(frequency[s]) for s in way))
            triggers += [(seed, k) for seed in best]
        self.trigger_ptr, self.trigger_items = lists(triggers, self.codes.size)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word codes, places in the document, seed numbers) of the seeds in a document."""
        get = self.word.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        none = np.zeros(0, np.int64)
        if not ids.size or not self.codes.size:
            return ids, none, none
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[at] * self.base + ids[at + 1]
        if self.single:
            own = np.flatnonzero(ids)
            at, code = np.concatenate([at, own]), np.concatenate([code, ids[own]])
        seed = np.minimum(np.searchsorted(self.codes, code), self.codes.size - 1)
        real = self.codes[seed] == code
        return ids, at[real], seed[real]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score as a share of the item's own, start, end) of the best local alignment of two code arrays;
    start and end are in the passage. Codes of 0 match nothing; of equal scores the first end wins."""
    if not item.size or not passage.size:
        return 0.0, 0, 0
    width = passage.size
    score = np.zeros(width + 1, np.int64)
    start = np.arange(width + 1)
    best, best_start, best_end = 0, 0, 0
    ramp = np.arange(width + 1) * -GAP
    for word in item.tolist():
        same = (passage == word) & (passage > 0)
        across = score[:-1] + np.where(same, MATCH, MISMATCH)
        down = score[1:] + GAP
        take = down > across
        now = np.concatenate([[0], np.where(take, down, across)])
        origin = np.concatenate([[0], np.where(take, start[1:], start[:-1])])
        fresh = now <= 0
        now[fresh] = 0
        origin[fresh] = np.flatnonzero(fresh)
        lifted = now + ramp  # gaps in the item: the best cell to the left less one gap for each step
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        left = top - ramp
        better = left > now
        score = np.where(better, left, now)
        start = np.where(better, origin[source], origin)
        k = int(np.argmax(score))
        if score[k] > best:
            best, best_start, best_end = int(score[k]), int(start[k]), k
    return best / (MATCH * item.size), best_start, best_end


def leaks_in(words: list[bytes], seeds: Seeds) -> list[tuple[int, float, int, int, int]]:
    """(number of the item, score, start word, end word, seeds) of the items that a document holds."""
    ids, at, seed = seeds.hits(words)
    if not at.size:
        return []
    # Items come first, from the triggers among the document's kinds of seeds, and then their seeds alone.
    order = np.argsort(seed, kind="stable")
    seed, at = seed[order], at[order]
    kinds, begin = np.unique(seed, return_index=True)
    wanted = np.unique(ragged(seeds.trigger_ptr, seeds.trigger_items, kinds)[1])
    if not wanted.size:
        return []
    of, own = ragged(seeds.item_ptr, seeds.item_seeds, wanted)
    there = np.minimum(np.searchsorted(kinds, own), kinds.size - 1)
    real = kinds[there] == own
    row, place = ragged(np.append(begin, seed.size), at, there[real])
    # A pair and a single word may be seeds at one place, which counts once.
    key = np.unique(wanted[of[real][row]] * np.int64(ids.size + 1) + place)
    item, place = key // (ids.size + 1), key % (ids.size + 1)
    last = np.arange(key.size) + seeds.needed[item] - 1
    fits = last < key.size
    fits[fits] = (item[last[fits]] == item[fits]) & (place[last[fits]] - place[fits] < seeds.reach[item[fits]])
    found = []
    first = np.flatnonzero(fits)
    for k in np.unique(item[first]).tolist():
        own, span = seeds.coded[k], int(seeds.reach[k])
        mine = first[item[first] == k]
        low = np.maximum(place[mine] - span, 0)
        high = np.minimum(place[last[mine]] + span + 1, ids.size)
        cut = np.flatnonzero(np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1]]))
        best = None
        for s, e in zip(low[cut].tolist(), np.maximum.reduceat(high, cut).tolist()):
            passage = ids[s:e]
            if np.isin(own, passage).sum() < seeds.least * own.size - 1e-9:
                continue  # too few of the item's words are there at all
            score, a, b = smith_waterman(own, passage)
            if score >= seeds.least - 1e-12 and (best is None or score > best[1]):
                inside = int(((item == k) & (place >= s + a) & (place < s + b)).sum())
                best = (k, score, s + a, s + b, inside)
        if best:
            found.append(best)
    return found


def parts_of(benchmark: DataFrame, bound: int) -> list[list[tuple[int | None, str | None]]]:
    """The test items in parts of at most about `bound` bytes, which are searched for one after the other."""
    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / bound))
    of = F.pmod(F.xxhash64("text"), F.lit(n))
    return ([(r.item_id, r.text) for r in (held.where(of == k) if n > 1 else held).collect()] for k in range(n))


def seed_frequency(docs: DataFrame, seeds: Seeds) -> np.ndarray:
    """Documents that hold each seed, over the whole corpus; at most one row a seed comes back."""

    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        total = np.zeros(max(1, seeds.codes.size), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                _, _, seed = seeds.hits(words_of(text.as_py()))
                total[np.unique(seed)] += 1
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], names=["seed", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seed long, n long")
    out = np.zeros(seeds.codes.size, np.int64)
    for r in counted.groupBy("seed").agg(F.sum("n").alias("n")).collect():
        out[r.seed] = r.n
    return out


def prepared(docs: DataFrame, benchmark: DataFrame, least: float, bound: int) -> Iterator[Seeds]:
    """The seeds of each part of the items, with triggers chosen by their frequency in docs."""
    for part in parts_of(benchmark, bound):
        seeds = Seeds(part, least)
        seeds.rank(seed_frequency(docs, seeds))
        yield seeds


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, bound: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_seeds): the best alignment of every pair of
    document and test item that scores at least `least`, which is above 0.5.

    Null and empty texts hold nothing. Items of equal words are each reported by their item_id, a null
    one too; an item listed twice is reported once. Repeated documents give repeated results. Items of
    more than `bound` bytes in all take further passes over docs.
    """

    def search(found: Seeds) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            for batch in batches:
                rows = [
                    (doc, i, *leak[1:])
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                    for leak in leaks_in(words_of(text.as_py()), seeds)
                    for i in seeds.ids[leak[0]]
                ]
                columns = list(zip(*rows)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return ready.mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return union_all([search(seeds) for seeds in prepared(docs, benchmark, least, bound)])


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, bound: int = MAX_ITEM_BYTES) -> DataFrame:
    """docs without the rows whose text holds a test item, named or not; all columns stay and nothing is
    shuffled."""

    def without(rows: DataFrame, found: Seeds) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            for batch in batches:
                keep = [not leaks_in(words_of(t.as_py()), seeds) for t in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    out = docs
    for seeds in prepared(docs, benchmark, least, bound):
        out = without(out, seeds)
    return out
