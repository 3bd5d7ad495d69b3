"""Byte-level BPE with the ranks of a public vocabulary: texts to ids, and ids to bytes.

A text is cut by the vocabulary's pattern, and each piece is merged by itself. The distinct pieces of a
block are dealt into matrices by length, one row a piece, padded on the right. In each round every row
merges its leftmost pair of the smallest rank: the pairs' ranks come from a hash table of id pairs, the
columns behind the merge move up by one, the matrix loses a column, and rows without a pair left are
taken out. A piece that is itself in the vocabulary is its own id, without merging.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# A vocabulary goes to every task; a rank file over this size is refused.
MAX_VOCABULARY_BYTES = 1 << 26
# Wider rows would cost the square of their length; they are merged along a list with a heap, with the same result.
WIDEST = 512
MATRIX_CELLS = 1 << 19
BLOCK_PIECES = 1 << 18
KNOWN_PIECES = 1 << 19
NO_PAIR = np.int32(2**31 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`. All 256 single bytes must be there."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte is no token of the vocabulary")
    return ranks


class PairTable:
    """Rank of the joined token for every pair of ids that joins to one, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(int(left.size * 2).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.joined = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32)
        keys = self.key(left, right)
        at, todo = self.slot(keys), np.arange(keys.size)
        while todo.size:
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)  # one key a slot and round
            won = free[first]
            self.keys[at[won]], self.joined[at[won]] = keys[won], joined[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * GOLDEN) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_PAIR where there is none or where an id is padding (-1)."""
        out = np.full(left.size, NO_PAIR, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self.key(left[todo], right[todo])
        at = self.slot(keys)
        while todo.size:
            seen = self.keys[at]
            hit = seen == keys
            out[todo[hit]] = self.joined[at[hit]]
            on = ~hit & (seen >= 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return out

    def rank_of(self, left: int, right: int) -> int:
        """rank of one pair of ids."""
        key = left << 32 | right
        at = (key * int(GOLDEN) & (1 << 64) - 1) >> int(self.shift)
        while (seen := self.keys.item(at)) != key:
            if seen < 0:
                return int(NO_PAIR)
            at = (at + 1) & self.mask
        return self.joined.item(at)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.changed = ranks, pattern, engine_differences()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*pairs))) if pairs else PairTable(*(np.zeros(0, np.int64),) * 3)
        self.ids = np.array(sorted(ranks.values()), np.int64)
        self.tokens = np.array([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])] + [b""], object)

    def bytes_of(self, ids: np.ndarray) -> list[bytes]:
        """The token of each id, b"" for ids that are not in the vocabulary."""
        at = np.searchsorted(self.ids, ids) if self.ids[-1] != self.ids.size - 1 else np.clip(ids, 0, self.ids.size)
        return self.tokens[np.where(np.append(self.ids, -1)[at] == ids, at, -1)].tolist()


def engine_differences() -> dict[int, int]:
    """Code points whose class the two regular expression engines know differently, as newer Unicode
    tables hold more letters: each with a stand-in of the class that the tokenizers' engine gives it."""
    everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single, out = {bytes([b]): b for b in range(256)}, {}
    theirs, ours = {}, {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        engine = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs[kind] = set(bytes(engine.encode_ordinary(everything)).decode())
        ours[kind] = set(regex.findall(kind, everything))
    # A letter, digit and space that no contraction names, and a code point of private use for the rest.
    stand_in = {r"\p{L}": "é", r"\p{N}": "7", r"\s": "\t"}
    for kind in theirs:
        out |= dict.fromkeys(ours[kind] - theirs[kind], "\ue000")
    for kind in theirs:
        out |= dict.fromkeys(theirs[kind] - ours[kind], stand_in[kind])
    return {ord(c): ord(s) for c, s in out.items()}


def merge_rows(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in a row, where each piece starts, with the end of the last) by matrices."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = vocabulary.single[np.frombuffer(b"".join(pieces), np.uint8)]
    start = np.concatenate([[0], np.cumsum(size)])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    at = 0
    while at < order.size:
        width = int(1 << max(int(size[order[at]]) - 1, 1).bit_length())  # lengths up to the next power of two share a matrix
        until = int(np.searchsorted(size[order], width, "right"))
        until = min(until, at + max(MATRIX_CELLS // width, 1))
        rows = order[at:until]
        at = until
        if size[rows[-1]] > WIDEST:
            done += [(rows[k : k + 1], merge_along(data[start[r] : start[r + 1]], vocabulary)[None, :]) for k, r in enumerate(rows)]
        else:
            done += _rounds(rows, data, start, size, vocabulary.pairs)
    length = np.zeros(size.size, np.int64)
    for rows, ids in done:
        length[rows] = (ids >= 0).sum(1)
    end = np.concatenate([[0], np.cumsum(length)])
    flat = np.empty(int(end[-1]), np.int32)
    for rows, ids in done:
        real = ids >= 0
        flat[(end[rows][:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
    return flat, end


def _rounds(rows, data, start, size, pairs: PairTable) -> list[tuple[np.ndarray, np.ndarray]]:
    width = int(size[rows[-1]])
    ids = np.full((rows.size, width), -1, np.int32)
    real = np.arange(width) < size[rows][:, None]
    ids[real] = data[(start[rows][:, None] + np.arange(width))[real]]
    rank = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows.size, width - 1)
    done = []
    while rows.size:
        if not rank.shape[1]:
            done.append((rows, ids))
            break
        best = rank.argmin(1)  # the leftmost of the smallest
        low = rank[np.arange(rows.size), best]
        over = low == NO_PAIR
        if over.any():
            done.append((rows[over], ids[over]))
            go = ~over
            rows, ids, rank, best, low = rows[go], ids[go], rank[go], best[go], low[go]
            if not rows.size:
                break
        each = np.arange(rows.size)
        ids[each, best] = low
        column = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
        column = column[:-1]
        rank = np.take_along_axis(rank, column + (column >= best[:, None]), 1)
        has = best > 0
        rank[each[has], best[has] - 1] = pairs.rank(ids[each[has], best[has] - 1], ids[each[has], best[has]])
        has = best < column.size
        rank[each[has], best[has]] = pairs.rank(ids[each[has], best[has]], ids[each[has], best[has] + 1])
    return done


def merge_along(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The same merges of one long piece, in n log n steps."""
    n, join = ids.size, vocabulary.pairs
    held, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    first = join.rank(ids[:-1], ids[1:])
    heap = [(int(first[k]), int(k)) for k in np.flatnonzero(first != NO_PAIR)]
    heapq.heapify(heap)
    now = first.tolist() + [int(NO_PAIR)]
    while heap:
        low, k = heapq.heappop(heap)
        if now[k] != low:
            continue  # merged away or changed since
        gone = after[k]
        held[k], held[gone], now[gone] = low, -1, int(NO_PAIR)
        after[k] = after[gone]
        if after[k] < n:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0:
                now[left] = join.rank_of(held[left], held[after[left]]) if after[left] < n else int(NO_PAIR)
                if now[left] != NO_PAIR:
                    heapq.heappush(heap, (now[left], left))
    out = np.array(held, np.int32)
    return out[out >= 0]


class Numbers(dict):
    """Numbers for pieces in order of first sight; new holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        return self.setdefault(piece, len(self))


class Encoder:
    """Encodes texts block by block; pieces met before are looked up, as many as KNOWN_PIECES."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pattern = vocabulary, regex.compile(vocabulary.pattern)
        self.differs = np.zeros(0x110000, bool)
        self.differs[list(vocabulary.changed)] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.end = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches in lists of bounded length."""
        if not text.isascii() and self.differs[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.vocabulary.changed)))
        elif len(text) > 4 * BLOCK_PIECES:
            found = (m.group() for m in self.pattern.finditer(text))
        else:
            yield self.pattern.findall(text)
            return
        while block := list(islice(found, BLOCK_PIECES)):
            yield block

    def learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        whole = np.array([self.vocabulary.ranks.get(b, -1) for b in raw])
        flat, end = merge_rows([b if r < 0 else b"\0" for b, r in zip(raw, whole.tolist())], self.vocabulary)
        flat[end[:-1][whole >= 0]] = whole[whole >= 0]
        self.flat = np.concatenate([self.flat, flat])
        self.end = np.concatenate([self.end, self.end[-1] + end[1:]])

    def encode(self, pieces: list[str], has_nul: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in a row, number of ids of each piece)."""
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        # pandas numbers a block's strings fast, but sees them only up to a NUL.
        own, distinct = (slice(None), pieces) if has_nul else pd.factorize(np.array(pieces, object))
        code = np.array(list(map(self.known.__getitem__, distinct)), np.int64)[own]
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        size = self.end[code + 1] - self.end[code]
        behind = np.cumsum(size)
        shift = self.end[code] - (behind - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(behind[-1]) if len(pieces) else 0)], size

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        out, count = [], np.zeros(len(texts), np.int64)
        block, owner, nul = [], [], []

        def flush():
            ids, size = self.encode(block, any(nul))
            out.append(ids)
            np.add.at(count, np.repeat([o for o, _ in owner], [n for _, n in owner]), size)
            block.clear(), owner.clear(), nul.clear()

        for k, text in enumerate(texts):
            for found in self.pieces(text):
                block += found
                owner.append((k, len(found)))
                nul.append("\0" in text)
                if len(block) >= BLOCK_PIECES:
                    flush()
        if block:
            flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), count


def vocabulary(docs: DataFrame, path: str, pattern: str) -> Broadcast:
    """The vocabulary of a rank file, read here (it may be on this machine alone) and sent to the tasks."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(docs: DataFrame, words: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs without text and with ids, an array of int: what the tiktoken library's encode_ordinary gives.

    Null and empty texts have no ids. Bytes that are not UTF-8 count as U+FFFD. Special tokens' strings
    are ordinary text. A column of docs named like ids is replaced. Every row is encoded by itself, so
    ties, repeated rows and an empty table are no cases of their own; nothing is shuffled. A text is
    encoded in blocks of pieces, so beside its own ids a very long text needs no more than a block.
    """
    own = [c for c in docs.columns if c not in (ids, text)]
    given = docs.select(*own, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__text"))
    schema = T.StructType([*(given.schema[c] for c in own), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words.value)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 22):
                flat, count = encoder.texts([t.decode("utf-8", "replace") for t in part.column("__text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), lists], [*own, ids])

    return given.mapInArrow(run, schema)


def decode(coded: DataFrame, words: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """coded without ids and with decoded, binary: the joined bytes of the ids.

    Null and empty arrays give no bytes, nor do null ids and ids that are not in the vocabulary. A column
    named like decoded is replaced. Nothing is shuffled.
    """
    own = [c for c in coded.columns if c not in (ids, decoded)]
    given = coded.select(*own, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*(given.schema[c] for c in own), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__ids", 1 << 20):
                lists = part.column("__ids")
                size = pc.list_value_length(lists).to_numpy()
                tokens = words.value.bytes_of(lists.flatten().fill_null(-1).to_numpy())
                end = np.cumsum(size).tolist()
                texts = [b"".join(tokens[e - n : e]) for e, n in zip(end, size.tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(texts, pa.binary())], [*own, decoded])

    return given.mapInArrow(run, schema)
