"""Periodic runs of words: stretches that say the same thing over and over, found and cut to one round.

A run is a stretch of words with smallest period q that is long enough and that no word beside it extends
with period q. The words of a task's documents are one sequence, in which words of different documents
differ. Its suffix tree is held as the intervals of its suffix array and the lengths of common prefixes.
Two leaves of a node of depth D that lie D words apart, in different children, are a branching tandem
repeat (Stoye and Gusfield). At each node only the leaves outside its largest child are gone through, and
their partners on both sides looked up by rank, which is n log n steps in all. A run has one branching
repeat of its period, at its end; rotating that to the left as far as words agree gives the whole run,
and repeats of multiples of the period, which end at the same word, merge into it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
CELLS = 1 << 20
SLICE_BYTES = 1 << 22


def _same_ahead(data: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words are the same from a and from b on, or backwards with step -1; a and b differ throughout."""
    size, n = np.zeros(a.size, np.int64), data.size
    todo, wide = np.arange(a.size), 1
    guarded = np.concatenate([data, [-1]])  # both sides leave the data at different words
    while todo.size:
        ahead = np.arange(wide) * step
        x, y = ((c[todo] + step * size[todo])[:, None] + ahead for c in (a, b))
        x[(x < 0) | (x > n)], y[(y < 0) | (y > n)] = n, n
        other = guarded[x] != guarded[y]
        # Outside on both sides is no agreement: the nearer side left first, at a word of the other.
        stop = other.any(1) | (x[:, -1] == n) | (y[:, -1] == n)
        agreed = np.where(other.any(1), other.argmax(1), wide)
        size[todo] += np.where(stop & ~other.any(1), 0, agreed)
        todo = todo[~stop]
        wide = int(min(wide * 8, max(CELLS // max(todo.size, 1), 1), 4096))
    return size


def suffix_array(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) by doubling; a round sorts only what is not yet told apart."""
    n = word.size
    order = np.argsort(word, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    slot = np.arange(n, dtype=np.int32)  # the places of the suffixes that still share a rank
    key, ahead = word[order].astype(np.int64), 1
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(slot.size), 0))
        mine = order[slot]
        rank[mine] = slot[begin]
        alone = new & np.concatenate([new[1:], [True]])
        slot, mine = slot[~alone], mine[~alone]
        if not slot.size:
            return order, rank
        follow = mine.astype(np.int64) + ahead
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1).astype(np.int64)
        key = rank[mine].astype(np.int64) * (n + 1) + after + 1
        sort = np.argsort(key, kind="stable")
        order[slot], key = mine[sort], key[sort]
        ahead *= 2


def common_prefixes(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix in order shares with the one before it; -1 for the first. Only where the
    words before the two differ are words compared (n log n in all), the rest follows from its left neighbour."""
    n = word.size
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    own = (here == 0) | (before <= 0) | (word[here - 1] != word[before - 1])
    at = np.flatnonzero(own)
    ends = np.zeros(n, np.int64)
    real = at[before[at] >= 0]
    ends[at] = at
    ends[real] += _same_ahead(word, real, before[real].astype(np.int64))
    last = np.maximum.accumulate(np.where(own, here, 0))
    shared = (ends[last] - here)[order].astype(np.int32)
    shared[0] = -1
    return shared


def _nearest(height: np.ndarray) -> np.ndarray:
    """For every border the nearest one before it that is as low or lower; the first, which none is below, for itself."""
    to = np.maximum(np.arange(height.size, dtype=np.int32) - 1, 0)
    todo = np.flatnonzero(height[to] > height)
    for _ in range(6):  # most are near
        to[todo] = to[to[todo]]
        todo = todo[height[to[todo]] > height[todo]]
    if not todo.size:
        return to
    # The others climb a tree of minima until one to the left is low enough, and go down to its last such leaf.
    wide = 1 << int(height.size - 1).bit_length()
    low = np.full(2 * wide, np.iinfo(np.int32).max, np.int32)
    low[wide : wide + height.size] = height
    level = wide
    while level > 1:
        low[level // 2 : level] = np.minimum(low[level : 2 * level : 2], low[level + 1 : 2 * level : 2])
        level //= 2
    at, own = todo + wide, height[todo]
    up = np.arange(todo.size)
    while up.size:
        there = ((at[up] & 1) == 1) & (low[at[up] - 1] <= own[up])
        at[up] = np.where(there, at[up] - 1, at[up] >> 1)
        up = up[~there]
    down = np.flatnonzero(at < wide)
    while down.size:
        at[down] = 2 * at[down] + (low[2 * at[down] + 1] <= own[down])
        down = down[at[down] < wide]
    to[todo] = at - wide
    return to


def tandem_repeats(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, D) of every branching tandem repeat: words [start, start + D) come twice, and the word
    after both is not the word after the first."""
    n = word.size
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = suffix_array(word)
    height = np.concatenate([common_prefixes(word, order), [-1]])  # of each border between leaves, with one at either end
    border = np.arange(n + 1, dtype=np.int32)
    left = _nearest(height)
    right = n - _nearest(height[::-1])[::-1]
    inner = np.flatnonzero(height > 0)
    first = height[left] < height  # the first border of its node
    node = np.where(first, border, left)
    while (node[node] != node).any():
        node = node[node]
    low, high = left[node], border.copy()
    last = inner[height[right[inner]] < height[inner]]
    high[node[last]] = right[last]
    # A child from each border to the next of the node, and one before the first.
    lead = inner[first[inner]]
    begin = np.concatenate([inner, left[lead]])
    end = np.concatenate([right[inner], lead])
    owner = node[np.concatenate([inner, lead])]
    size = end - begin
    largest = np.zeros(n + 1, np.int32)
    np.maximum.at(largest, owner, size)
    heavy = np.full(n + 1, -1, np.int64)
    most = np.flatnonzero(size == largest[owner])
    heavy[owner[most]] = most
    small = np.flatnonzero(heavy[owner] != np.arange(owner.size))
    found = []
    cut = np.cumsum(size[small], dtype=np.int64)
    for part in np.split(small, np.searchsorted(cut, np.arange(CELLS, int(cut[-1]) if cut.size else 0, CELLS))):
        times = size[part]
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        child = np.repeat(part, times)
        leaf = order[begin[child] + within].astype(np.int64)
        depth = height[owner[child]].astype(np.int64)
        for start, partner in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
            ok = np.flatnonzero((partner >= 0) & (partner < n))
            place, c = rank[partner[ok]], child[ok]
            ok = ok[(place >= low[owner[c]]) & (place < high[owner[c]]) & ((place < begin[c]) | (place >= end[c]))]
            found.append(np.stack([start[ok], depth[ok]]))
    both = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    key = np.unique(both[0] * (n + 1) + both[1])
    return key // (n + 1), key % (n + 1)


def runs(word: np.ndarray, least: int = 24, rounds: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` words and `rounds` periods, in order."""
    start, period = tandem_repeats(word)
    end = start + 2 * period
    out = np.zeros((0, 3), np.int64)
    sort = np.lexsort((period, end))
    start, period, end = start[sort], period[sort], end[sort]
    while start.size:
        new = np.concatenate([[True], end[1:] != end[:-1]])
        s, q, e = start[new], period[new], end[new]
        s = s - _same_ahead(word, s - 1, s + q - 1, -1)
        long = e - s >= np.maximum(least, rounds * q)
        out = np.concatenate([out, np.stack([s, e - s, q], 1)[long]])
        # What ends there within the run with a multiple of its period is the same run.
        mine = np.cumsum(new) - 1
        go = ~new & ~((period % q[mine] == 0) & (start >= s[mine]))
        start, period, end = start[go], period[go], end[go]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, their numbers in a row, where each text starts, with the end of the last).
    Equal words of a text have equal numbers, words of different texts different ones."""
    words = [t.split() for t in texts]  # ASCII white space
    name: dict[bytes, int] = defaultdict(count().__next__)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.array(list(map(name.__getitem__, chain.from_iterable(words))), np.int64)
    key = np.repeat(np.arange(size.size), size) * (len(name) + 1) + flat
    return words, key, np.concatenate([[0], np.cumsum(size)])


def collapse(docs: DataFrame, least: int = 24, rounds: int = 3, text: str = "text") -> DataFrame:
    """docs with runs, an array of (start, length, period) in words by start and period, and text replaced
    by its words, less those after the first period of any run that holds them, joined by one space.

    Null and empty texts and texts of white space have no runs and become ''. Bytes that are not UTF-8
    come back as U+FFFD. A column named runs is replaced. Every row is worked on by itself, so ties,
    repeated rows and an empty table are no cases of their own; nothing is shuffled. A task holds about
    SLICE_BYTES of texts, or one longer text, at a time: some 100 bytes a word of the longest.
    """
    own = [c for c in docs.columns if c not in ("runs", text)]
    given = docs.select(*own, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__text"))
    fields = [T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField(text, T.StringType(), False)]
    schema = T.StructType([*(given.schema[c] for c in own), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", SLICE_BYTES):
                words, number, begin = numbered(part.column("__text").to_pylist())
                found = runs(number, least, rounds)
                owner = np.searchsorted(begin, found[:, 0], "right") - 1
                change = np.zeros(number.size + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 0] + found[:, 1], -1)
                gone = np.cumsum(change) > 0
                kept = []
                for k, text_words in enumerate(words):
                    out = gone[begin[k] : begin[k + 1]]
                    kept.append(b" ".join(text_words if not out.any() else [w for w, o in zip(text_words, out.tolist()) if not o]).decode("utf-8", "replace"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
                values = [found[:, 0] - begin[owner], found[:, 1], found[:, 2]]
                items = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), lists, pa.array(kept, pa.string())], [*own, "runs", text])

    return given.mapInArrow(run, schema)
