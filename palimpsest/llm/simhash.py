"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints form a binary trie, held as a sorted array in which a node is a range. Pairs of
nodes are walked down together from the root; each pair carries the bits that differ so far and is
dropped once those exceed the budget. The top levels of the walk deal the pairs of subtrees out to
tasks; a task hands on a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, partitions, remove, written

NODE_SIZE = 8192
MAX_DEPTH = 14
FRONTIER = 1 << 18


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text: words between ASCII white space, A-Z lower-cased, shingles of `width`
    words with repeats. A text of fewer words is one shingle; one without words has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for part in range(0, hashes.size, 65536):
        bits = np.unpackbits(hashes[part : part + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > hashes.size).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, fp long")


def spelled_out(x0: np.ndarray, n: np.ndarray, y0: np.ndarray, m: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the ranges x0..x0+n and y0..y0+m, in arrays of about `most` pairs."""
    large = n.astype(np.int64) * m > most
    for k in np.flatnonzero(large):
        rows = max(1, most // int(m[k]))
        for s in range(0, int(n[k]), rows):
            i = np.arange(x0[k] + s, x0[k] + min(int(n[k]), s + rows))
            yield np.repeat(i, m[k]), np.tile(np.arange(y0[k], y0[k] + m[k]), i.size)
    x0, n, y0, m = (v[~large] for v in (x0, n, y0, m))
    each = n.astype(np.int64) * m
    bins = (np.cumsum(each) - 1) // most if each.size else each
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b) if bins[-1] else np.arange(each.size)
        own = each[at]
        node = np.repeat(at, own)
        k = np.arange(node.size) - np.repeat(np.cumsum(own) - own, own)
        yield x0[node] + k // m[node], y0[node] + k % m[node]


def trie_pairs(
    a: np.ndarray, b: np.ndarray, budget: int, same: bool, frontier: int = FRONTIER, bits: int = 64
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted uint64 arrays a and b whose first `bits` bits, the only ones set,
    differ in at most `budget`; with same (b is a) each pair once and none of a row with itself.
    Memory is bounded by `frontier`."""
    if not a.size or not b.size:
        return
    zero = np.zeros(1, np.int32)
    stack = [(0, zero, zero + np.int32(a.size), zero, zero + np.int32(b.size), np.zeros(1, np.int8))]
    ones: dict[tuple[int, int], np.ndarray] = {}

    def upto(which: int, x: np.ndarray, depth: int) -> np.ndarray:
        if (which, depth) not in ones:
            bit = ((x >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int32)
            ones[which, depth] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        return ones[which, depth]

    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if al.size > frontier:
            half = al.size // 2
            for s in (slice(half, None), slice(None, half)):
                stack.append((depth, al[s], ah[s], bl[s], bh[s], err[s]))
            continue
        small = (ah - al).astype(np.int64) * (bh - bl) <= 4
        if depth == bits:
            small[:] = True
        if small.any():
            for i, j in spelled_out(al[small], (ah - al)[small], bl[small], (bh - bl)[small], 4 * frontier):
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
            big = ~small
            al, ah, bl, bh, err = al[big], ah[big], bl[big], bh[big], err[big]
        if not al.size:
            continue
        ca, cb = upto(0, a, depth), upto(1, b, depth)
        am, bm = ah - (ca[ah] - ca[al]), bh - (cb[bh] - cb[bl])
        sides = []
        for left, right, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            x, y = ((al, am) if left == 0 else (am, ah)), ((bl, bm) if right == 0 else (bm, bh))
            live = (x[1] > x[0]) & (y[1] > y[0]) & (err + cost <= budget)
            if same and cost:
                live &= (al != bl) | ((left, right) == (0, 1))
            if live.any():
                sides.append((x[0][live], x[1][live], y[0][live], y[1][live], (err[live] + cost).astype(np.int8)))
        if sides:
            stack.append((depth + 1, *(np.concatenate(c) for c in zip(*sides))))


class Forest:
    """Union-find over indices, for whole arrays of links at a time; roots are smallest indices."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            i, j = self.parent[i], self.parent[j]
            apart = i != j
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(i, j), np.minimum(i, j))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def node_masks(depth: int, budget: int) -> list[int]:
    """Differences of at most `budget` bits between two nodes `depth` levels down."""
    return [sum(1 << x for x in c) for r in range(min(budget, depth) + 1) for c in combinations(range(depth), r)]


def links(fps: DataFrame, budget: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """(a, b): a forest of links that joins exactly the fingerprints of fps(fp), each given once, that
    a chain of at most `budget` differing bits joins."""
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / node_size))))
    masks = np.array(node_masks(depth, budget), np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            for part in range(0, signed.size, 4096):
                fp = signed[part : part + 4096]
                top = (fp.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(fp.size, np.int64)
                low = np.minimum(top[:, None], top[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(np.tile(masks, fp.size)), pa.array(np.repeat(fp, masks.size))], names=["low", "mask", "fp"]
                )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in groups(batches):
            every = np.unique(fp.view(np.uint64))
            forest = Forest(every.size)
            if key[1] == 0 or depth == 0:
                for i, j in trie_pairs(every, every, budget, True):
                    forest.add(i, j)
            else:
                lower = (every >> np.uint64(64 - depth)).astype(np.int64) == key[0]
                first, second = np.flatnonzero(lower), np.flatnonzero(~lower)
                for i, j in trie_pairs(every[first], every[second], budget, False):
                    forest.add(first[i], second[j])
            child = np.flatnonzero(forest.parent != np.arange(every.size))
            if child.size:
                signed = every.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[forest.parent[child]])], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(spread, "low long, mask long, fp long")
    dealt = dealt.repartition(partitions(fps.sparkSession), "low", "mask").sortWithinPartitions("low", "mask")
    return dealt.mapInArrow(walk, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((low, mask), fingerprints) of each run of equal keys in sorted batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        low, mask, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "mask", "fp"))
        edges = np.flatnonzero((np.diff(low) != 0) | (np.diff(mask) != 0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), low.size]):
            now = int(low[s]), int(mask[s])
            if now != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = now, []
            held.append(fp[s:e].copy())
    if held:
        yield key, np.concatenate(held)


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long) and component_id, the smallest doc_id that
    links reach. Null texts count as empty; documents without words share fingerprint 0. Null doc_ids
    take part and never are a component_id unless a component has only such."""
    marked = materialize(fingerprints(docs, width), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = connected_components(links(distinct, budget, node_size))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "roots")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = placed.join(lowest, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


# Fixed by this module: signatures of many bits, of which bands are walked and the whole is compared.
SIGNATURE_BITS = 512
BAND_BITS, BAND_BUDGET, BAND_MISS = 28, 2, 1e-4
BAND_NODE_SIZE = 1 << 16
#: Texts of at most so many shingles also meet by the shingles themselves, as few votes make odd signatures.
FEW_SHINGLES = 64
#: Shingles that one task compares; groups of more are cut into blocks.
BLOCK_SHINGLES = 1 << 21
BROADCAST_ROWS = 1 << 19


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of `width` words; a text of fewer words is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits of a text's distinct shingles; zero without any."""
    votes = np.zeros(SIGNATURE_BITS, np.int64)
    lanes = np.arange(1, SIGNATURE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in range(0, hashes.size, 255 * 64):
        x = hashes[part : part + 255 * 64, None] + lanes[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        whole = bits.shape[0] // 255 * 255
        votes += bits[:whole].reshape(-1, 255, SIGNATURE_BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > hashes.size).tobytes()


def bit_share(similarity: float) -> float:
    """Share of signature bits by which texts of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands_needed(depth: int, similarity: float, miss: float = BAND_MISS) -> int:
    """Bands that leave at most `miss` of the pairs at a similarity in no band's node together with few
    enough differing bits, where nodes are `depth` levels down."""
    p, rest = bit_share(similarity), BAND_BITS - depth
    hit = (1 - p) ** depth * sum(math.comb(rest, k) * p**k * (1 - p) ** (rest - k) for k in range(BAND_BUDGET + 1))
    return math.ceil(math.log(miss) / math.log(1 - hit))


def bits_apart(similarity: float, slack: float = 6.0) -> int:
    """Signature bits by which texts of this Jaccard similarity differ, with `slack` deviations: no
    decision, only what is worth an exact comparison."""
    share = bit_share(similarity)
    return int(SIGNATURE_BITS * share + slack * math.sqrt(SIGNATURE_BITS * share * (1 - share)))


def band_values(signatures: np.ndarray, band: int) -> np.ndarray:
    """The bits of one band as the first bits of a uint64, for rows of signature bytes."""
    chosen = np.sort(np.random.default_rng(band).permutation(SIGNATURE_BITS)[:BAND_BITS])
    bits = (signatures[:, chosen >> 3] >> (7 - (chosen & 7)).astype(np.uint8)) & 1
    weight = np.uint64(1) << np.arange(63, 63 - BAND_BITS, -1, dtype=np.uint64)
    return (bits.astype(np.uint64) * weight[None, :]).sum(axis=1, dtype=np.uint64)


def least_prefix(n: int, similarity: float) -> int:
    """Shingles, the first in any one order of all, of which two sets at the similarity share one."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join exactly the sets that a chain of Jaccard similarities of at least
    `similarity` joins. Rare elements come first; sets are compared once they share one of their
    first elements, and only while nothing joins them yet."""
    sizes = [s.size for s in sets]
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(count.size, np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(count.size)
    ends = np.cumsum(sizes)
    ordered = [np.sort(place[code[e - n : e]]) for n, e in zip(sizes, ends.tolist())]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    found, held, trees = [], defaultdict(list), 0
    for x in sorted(range(len(sets)), key=lambda k: sizes[k]):
        first = ordered[x][: least_prefix(sizes[x], similarity)].tolist() if sizes[x] else []
        seen: set[int] = set()
        joined = 0
        for y in (y for token in first for y in held[token]):
            if joined == trees:
                break
            if y in seen:
                continue
            seen.add(y)
            if sizes[y] < similarity * sizes[x] - 1e-9 or (r := root(y)) == (own := root(x)):
                continue
            small, large = ordered[y], ordered[x]
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, large.size - 1)] == small).sum())
            if both / (sizes[x] + sizes[y] - both) >= similarity:
                parent[own] = r
                found.append((x, y))
                joined += 1
        trees += 1 - joined
        for token in first:
            held[token].append(x)
    return found


def similar_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, node_size: int = BAND_NODE_SIZE) -> DataFrame:
    """(doc_id, t1, t2, component_id, stays) for every row of docs: t1 and t2 are hashes of the text,
    component_id is the smallest doc_id that a chain of texts alike reaches, null if all are null, and
    stays marks the row of each group with the smallest doc_id and, of one doc_id, the smallest t1 and
    t2. So different texts of one doc_id, and of none, are documents of their own; rows that repeat
    doc_id and text are one document listed twice. Texts are alike when the Jaccard similarity of their
    sets of shingles is at least `similarity`; texts without words are alike.

    Signatures only find what to compare. Texts at a Jaccard similarity of 0.8 differ in some 15% of
    their SimHash bits, too many for a trie walk over whole fingerprints. So signatures have 512 bits,
    and each band of 28 of them has its own trie, walked with a budget of 2 bits. Where signatures are
    many, a task walks one subtree of a band with itself: pairs then have to agree down to that node, so
    bands are added until 9,999 of 10,000 pairs at the similarity meet in one, at every size of input.
    Pairs that meet and are within six deviations on all 512 bits join a loose forest; only its links
    leave the task.

    The texts of each loose group, and besides the texts of at most FEW_SHINGLES shingles that share one
    of their first shingles, then meet with all their shingles, and only pairs at the similarity link.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(F.col("text")), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("text")]
            first = [h[: least_prefix(h.size, similarity)].view(np.int64) if 0 < h.size <= FEW_SHINGLES else np.zeros(0, np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in row), pa.array([signature(h) for h in sets], pa.binary()), pa.array([h.size for h in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                names=[*row, "sig", "n", "first"],
            )

    row = ("doc_id", "t1", "t2")
    who = F.struct(F.col("doc_id").isNull().alias("none"), *row)
    marked = materialize(texts.mapInArrow(sign, "doc_id long, t1 long, t2 long, sig binary, n long, first array<long>"), "signatures")
    distinct = marked.groupBy("sig").agg(F.min(who).alias("who"), F.first("n").alias("n"), F.first("first").alias("first"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")  # written once, so identifiers stay
    n = distinct.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / node_size))))
    bands, apart = bands_needed(depth, similarity), bits_apart(similarity)

    def bytes_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE_BITS // 8)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = bytes_of(part)
                for band in range(bands):
                    value = band_values(sigs, band)
                    node = (value >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(value.size, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(value.size, band, np.int32)), pa.array(node), part.column("id"), part.column("sig")], names=["band", "node", "id", "sig"])

    def settle(key: tuple, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        band = key[0]
        ids, sigs = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        value = band_values(sigs, band)
        order = np.lexsort((ids, value))
        ids, sigs, value = ids[order], np.ascontiguousarray(sigs[order]).view(np.uint64), value[order]
        forest = Forest(ids.size)
        for i, j in trie_pairs(value, value, BAND_BUDGET, True, bits=BAND_BITS):
            for at in range(0, i.size, 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                new = forest.parent[x] != forest.parent[y]
                x, y = x[new], y[new]
                alike = np.bitwise_count(sigs[x] ^ sigs[y]).sum(axis=1, dtype=np.int64) <= apart
                if alike.any():
                    forest.add(x[alike], y[alike])
        child = np.flatnonzero(forest.parent != np.arange(ids.size))
        if not child.size:
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[forest.parent[child]])], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "node")])
            ids, sigs = batch.column("id").to_numpy(zero_copy_only=False), bytes_of(batch)
            edges = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), ids.size]):
                now = tuple(keys[:, s].tolist())
                if now != key:
                    if held and (found := settle(key, held)):
                        yield found
                    key, held = now, []
                held.append((ids[s:e].copy(), sigs[s:e].copy()))
        if held and (found := settle(key, held)):
            yield found

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([h.tobytes() for h in sets], pa.binary())], names=["id", "shingles"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (links := alike(sets, similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "low", "high")))
            for now, i, held in zip(keys, batch.column("id").to_pylist(), batch.column("shingles")):
                if now != key:
                    yield from found()
                    key, ids, sets = now, [], []
                ids.append(i)
                sets.append(np.frombuffer(held.as_py(), np.uint64))
        yield from found()

    dealt = distinct.select("id", "sig").mapInArrow(spread, "band int, node long, id long, sig binary")
    dealt = dealt.repartition(max(bands, partitions(docs.sparkSession)), "band", "node").sortWithinPartitions("band", "node")
    loose = connected_components(dealt.mapInArrow(walk, "a long, b long"))
    close = distinct.join(loose, distinct["id"] == loose["node"]).select(F.lit(0).alias("kind"), F.col("root").alias("key"), "id", "n")
    few = distinct.select(F.lit(1).alias("kind"), F.explode("first").alias("key"), "id", "n")
    shared = few.groupBy("key").count().where("count > 1").select("key")
    met = materialize(close.unionByName(few.join(shared, "key", "left_semi").select(*close.columns)), "met")
    chosen = distinct.join(met.select("id").distinct(), "id").select("id", F.col("who.doc_id").alias("__d"), F.col("who.t1").alias("__1"), F.col("who.t2").alias("__2"))
    chosen = materialize(chosen, "chosen")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    same = (F.col("t1") == F.col("__1")) & (F.col("t2") == F.col("__2")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    sets = texts.join(chosen, same).select("id", "text").mapInArrow(gather, "id long, shingles binary")
    sets, path = written(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")

    def links(cells: DataFrame) -> DataFrame:
        """Links within each cell of cells(kind, key, low, high, id)."""
        held = cells.join(sets, "id").select("kind", "key", "low", "high", "id", "shingles")
        held = held.repartition(partitions(docs.sparkSession), "kind", "key", "low", "high").sortWithinPartitions("kind", "key", "low", "high")
        return held.mapInArrow(compare, "a long, b long")

    # A group of more shingles than one task should hold is cut into blocks.
    group = ["kind", "key"]
    large = materialize(met.groupBy(*group).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks")).where("blocks > 1"), "large")
    n_large = large.count()
    if n_large <= BROADCAST_ROWS:
        large = F.broadcast(large)
    cells = met.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    found = links(cells.select(*group, F.col("own").alias("low"), F.col("own").alias("high"), "id"))
    if n_large:
        found = across_blocks(materialize(found, "links"), materialize(cells.where("blocks > 1"), "cells"), links)
    roots = connected_components(found)
    remove(docs.sparkSession, path)  # all links are in the components' own table
    placed = distinct.join(roots, distinct["id"] == roots["node"], "left").select("sig", "who", F.coalesce("root", "id").alias("root"))
    placed = materialize(placed, "placed")
    lowest = placed.groupBy("root").agg(F.min("who").alias("low"))
    placed = placed.join(lowest, "root").select("sig", "low")
    return marked.join(placed, "sig").select(*row, F.col("low.doc_id").alias("component_id"), (who == F.col("low")).alias("stays"))


def across_blocks(found: DataFrame, cells: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """found(a, b), the links within blocks, with links between the blocks of groups that have several,
    cells(kind, key, blocks, own, id, n), so that all that is alike in a group is joined.

    One text for each tree of a group is compared with the others first. Copies of one text, however
    many, are a single tree after that, which no more links can change. Blocks meet in pairs only in
    groups that are still apart.
    """
    group = ["kind", "key"]

    def rooted(edges: DataFrame) -> DataFrame:
        roots = connected_components(edges)
        return materialize(cells.join(roots, cells["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node"), "rooted")

    trees = rooted(found).groupBy(*group, "root").agg(F.min(F.struct("id", "n")).alias("x")).select(*group, "x.*")
    few = trees.groupBy(*group).agg(F.sum("n").alias("total")).where(F.col("total") <= BLOCK_SHINGLES)
    leaders = trees.join(few, group).select(*group, F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), "id")
    found = materialize(found.unionByName(links(leaders)), "links")
    apart = rooted(found).groupBy(*group).agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select(*group)
    both = cells.join(apart, group).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other")
    return found.unionByName(links(both.select(*group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id")))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """t1 and t2, hashes of a text of 64 bits each; a null text counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("second"), whole).alias("t2")
