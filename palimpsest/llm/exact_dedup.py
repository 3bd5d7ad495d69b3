"""Exact deduplication with Patricia tries over (length, content hash) partitions.

Every map task first inserts its own texts in a trie, which leaves one row a distinct text and task,
so a hot group is small before the shuffle. Rows are then dealt out by length and content hash, and
each partition inserts its full byte strings into a compressed radix trie whose terminal nodes hold
the smallest and largest identifier and the count. A partition comes in order of length and bytes, so
every subtree left of the last insertion is complete: once the trie holds `budget` bytes these are
written out and freed, and only the path to the last string stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

BUDGET = 32 << 20


class PatriciaTrie:
    """Compressed radix trie over bytes; each edge holds a whole byte string."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, owner
        self.held = 0

    def insert(self, key: bytes) -> list:
        """The terminal node of key; its owner, node[2], is None the first time."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.held += len(child[0]) + 200
                return child
            label = child[0]
            if not key.startswith(label, at):
                same = common_prefix(label, key[at : at + len(label)])
                middle = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                node[1][key[at]] = middle
                self.held += 200
                child = middle
            at += len(child[0])
            node = child
        return node

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """(key, owner) of all terminal nodes in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack.extend((node[1][b], key) for b in sorted(node[1], reverse=True))

    def finished(self) -> Iterator[tuple[bytes, list]]:
        """Write out and free what is complete where strings come in byte order: all but the path of the
        last one."""
        node, prefix, path = self.root, b"", []
        while node[1]:
            path.append((node, prefix))
            last = max(node[1])
            node, prefix = node[1][last], prefix + node[1][last][0]
        self.held = 0
        for node, prefix in path:
            if node[2] is not None:
                yield prefix, node[2]  # a string that others continue; its like would have come before them
                node[2] = None
            last = max(node[1])
            for b in sorted(node[1]):
                if b != last:
                    part = PatriciaTrie()
                    part.root = node[1].pop(b)
                    for key, owner in part.terminals():
                        yield prefix + key, owner
            self.held += len(node[1][last][0]) + 200


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that a and b share at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _owner(old: list | None, low, high, count: int) -> list:
    if old is None:
        return [low, high, count]
    ids = [x for x in (old[0], low) if x is not None], [x for x in (old[1], high) if x is not None]
    return [min(ids[0], default=None), max(ids[1], default=None), old[2] + count]


_PARTIAL = pa.schema(
    [("n_bytes", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("group_size", pa.int64())]
)
_CLASSES = pa.schema([("sha256", pa.binary()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("group_size", pa.int64())])


def content_hash(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def _rows(found: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes."""
    rows: list[tuple] = []
    held = 0
    for row in found:
        rows.append(row)
        held += size(row)
        if len(rows) >= 20000 or held >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def classes(docs: DataFrame, hash_fn: Callable[[bytes], bytes] = content_hash, budget: int = BUDGET) -> DataFrame:
    """(sha256, first_id, last_id, group_size) of every normalised text of docs(doc_id, text) that more
    than one row has. hash_fn only deals texts out: equal hashes of different texts do no harm, for the
    trie compares whole texts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            trie = PatriciaTrie()
            for batch in batches:
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    node = trie.insert(normalise(text.as_py()))
                    node[2] = _owner(node[2], i, i, 1)
                    if trie.held > budget:
                        yield from trie.terminals()
                        trie = PatriciaTrie()
            yield from trie.terminals()

        yield from _rows(((len(body), hash_fn(body), body, *owner) for body, owner in found()), _PARTIAL, lambda r: r[0])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            trie, last = PatriciaTrie(), None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("n_bytes", "first_id", "last_id", "group_size")]
                for n, low, high, count, body in zip(*columns, batch.column("body")):
                    if n != last:
                        yield from trie.terminals()
                        trie, last = PatriciaTrie(), n
                    elif trie.held > budget:
                        yield from trie.finished()
                    node = trie.insert(body.as_py())
                    node[2] = _owner(node[2], low, high, count)
            yield from trie.terminals()

        yield from _rows(((sha256(body), *owner) for body, owner in found() if owner[2] > 1), _CLASSES, lambda r: 100)

    partial = "n_bytes long, digest binary, body binary, first_id long, last_id long, group_size long"
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = ready.mapInArrow(local, partial).repartition(partitions(docs.sparkSession), "n_bytes", "digest").drop("digest")
    return met.sortWithinPartitions("n_bytes", "body").mapInArrow(meet, "sha256 binary, first_id long, last_id long, group_size long")


def dedup(docs: DataFrame, keep: str = "last", hash_fn: Callable[[bytes], bytes] = content_hash, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept and text_sha256.

    keep is "first" or "last": the smallest or largest doc_id of a group stays. Rows that repeat a
    doc_id with an equal text are one document listed twice: each counts in group_size, and all carry
    the same kept. A null doc_id never wins over another; where a group has only nulls, keep_id is
    null and its rows are kept. Rows meet their group, settled by whole texts, by the SHA-256 that they return.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([sha256(normalise(t.as_py())) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests], names=["doc_id", "sha256"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ready.mapInArrow(members, "doc_id long, sha256 binary")
    groups = classes(docs, hash_fn, budget).select("sha256", F.col("first_id" if keep == "first" else "last_id").alias("__keep"), "group_size")
    joined = rows.join(groups, "sha256", "left")
    chosen = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    return joined.select(
        "doc_id", chosen.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(chosen).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )
