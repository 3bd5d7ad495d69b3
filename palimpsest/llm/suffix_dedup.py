"""Repeated-substring removal with suffix arrays and longest-previous-factor arrays.

Texts are byte strings. A byte goes where it is covered by a string of `length` bytes that also starts
earlier in the corpus, that is where the longest-previous-factor (LPF) array is at least `length`.

To build suffix arrays in tasks of bounded size, equal strings first have to meet. Every string holds
one anchor, the least hash among its k-grams, which only its own bytes decide. Starts in a row with one
anchor form a segment; segments meet by anchor hash. Where all segments of an anchor are equal, the
first keeps its bytes and the others lose theirs. Where they differ, one segment of each kind goes
with its bytes into a suffix array: previous and next smaller positions in suffix order give every
start's earlier match. Anchors of very many kinds of segment are dealt out string by string instead, by
hashes of the strings, so their starts spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

LENGTH = 100
ANCHOR = 36
PIECE = 4 << 20
HOT = 4096
BUFFER = 2 << 20
SINGLES = 1 << 18
_POS_BITS = 24
#: A place is a byte position and below it these bits of the text's second hash.
_TAG_BITS = 32


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as little-endian numbers."""
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-gram (k from 8) of a byte array."""
    n = data.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for at in [*range(0, k - 8, 8), k - 8]:
        h = _mix((h ^ words_at(data[at:], n)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
    return h


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of w."""
    n, span = x.size - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def segments(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, first start, starts, anchor's place after the first start) of all segments.

    starts are ascending places of `data` at which whole strings start.
    """
    h = gram_hashes(data, k)
    w = length - k + 1
    keyed = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(h.size, dtype=np.uint64)
    anchor = (window_min(keyed, w)[starts] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first = starts[cut]
    count = np.diff(np.append(cut, starts.size))
    return h[anchor[cut]], first, count, anchor[cut] - first


def pieces(bodies: list[bytes], length: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """(bytes, parts) of bounded size; a part is (text, place in bytes, starts, place in text). Parts of
    one text overlap by length - 1 bytes, so every start is in one part."""
    held: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    size = 0
    for i, body in enumerate(bodies):
        at = 0
        total = len(body) - length + 1
        while at < total:
            n = min(total - at, piece)
            held.append(body[at : at + n + length - 1])
            parts.append((i, size, n, at))
            size += n + length - 1
            at += n
            if size >= piece:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                held, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(held), np.uint8), parts


def prev_smaller(v: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, or -1, by pointer jumping."""
    j = np.arange(-1, v.size - 1)
    live = np.arange(v.size)
    while True:
        live = live[j[live] >= 0]
        live = live[v[j[live]] >= v[live]]
        if not live.size:
            return j
        j[live] = j[j[live]]


def dense(key: np.ndarray) -> np.ndarray:
    """Rank of every key among the distinct keys."""
    order = np.argsort(key)
    ranked = key[order]
    rank = np.empty(key.size, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
    return rank


def has_previous(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each start whether the string of `length` bytes there is also at a start of smaller place.

    A suffix array to depth `length` by prefix doubling; the LPF of a start is its longest match with
    the previous or next smaller place in suffix order.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n = data.size
    rank = dense(words_at(padded, n).byteswap())
    span = 8
    while span * 2 <= length:
        tail = np.zeros(n, np.int64)
        if n > span:
            tail[: n - span] = rank[span:]
        rank = dense(rank * np.int64(n + 1) + tail)
        span *= 2
    last = starts + (length - span)
    order_key = rank[starts] * np.int64(n + 1) + rank[last]
    suffix = np.lexsort((place, order_key))
    key, position = order_key[suffix], place[suffix]
    before = prev_smaller(position)
    after = position.size - 1 - prev_smaller(position[::-1])[::-1]
    full = np.zeros(position.size, bool)
    for other, there in ((before, before >= 0), (after, after < position.size)):
        full[there] |= key[other[there]] == key[there]
    out = np.zeros(starts.size, bool)
    out[suffix] = full
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_FOUND = "anchor long, segment long, doc long, mark long, at long, shape int, known boolean"


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, segment, doc, mark, at, shape, known) of all segments of docs(doc, mark, tag, text).

    doc, mark and tag are a text's identity; at is the first start above the tag; shape is the number of
    starts and the anchor's place. A segment whose like the same batch has earlier is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            marks, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "tag"))
            bodies = [text_bytes(t.as_py()) for t in batch.column("text")]
            for data, parts in pieces(bodies, length):
                starts = np.concatenate([np.arange(p[1], p[1] + p[2]) for p in parts])
                h, first, count, offset = segments(data, starts, length, k)
                edge = np.array([p[1] for p in parts])
                part = np.searchsorted(edge, first, "right") - 1
                text = np.array([p[0] for p in parts])[part]
                at = first - edge[part] + np.array([p[3] for p in parts])[part]
                raw = data.tobytes()
                tails = (first + count + length - 1).tolist()
                segment = np.array([digest(raw[a:b], o) for a, b, o in zip(first.tolist(), tails, offset.tolist())], np.uint64)
                doc, mark, where = ids[text], marks[text], (at << _TAG_BITS) | tags[text]
                order = np.lexsort((where, mark, doc, segment, h))
                same = np.zeros(order.size, bool)
                a, b = order[1:], order[:-1]
                same[1:] = (h[a] == h[b]) & (segment[a] == segment[b])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(order.size)))
                lead = order[head]
                known = np.zeros(order.size, bool)
                known[order] = (doc[order] != doc[lead]) | (mark[order] != mark[lead]) | (where[order] != where[lead])
                shape = count << 8 | offset
                # Known segments need not meet others: those that touch become one row with a key of its own.
                touch = known[1:] & known[:-1] & (text[1:] == text[:-1]) & (first[1:] == first[:-1] + count[:-1])
                head = np.flatnonzero(np.concatenate([[True], ~touch]))
                total = np.add.reduceat(count, head)
                own = _mix((doc[head] ^ mark[head]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + where[head].view(np.uint64))
                lone = known[head]
                key = np.where(lone, own, h[head])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(segment[head].view(np.int64)), pa.array(doc[head]), pa.array(mark[head]), pa.array(where[head]),
                     pa.array(np.where(lone, total << 8, shape[head]).astype(np.int32)), pa.array(lone)],
                    names=["anchor", "segment", "doc", "mark", "at", "shape", "known"],
                )

    return docs.mapInArrow(run, _FOUND)


_MET = "key long, sub long, doc long, mark long, at long, known boolean, body binary"
_MET_NAMES = ["key", "sub", "doc", "mark", "at", "known", "body"]


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Wanted segments of each document: their bytes by anchor, or where the anchor is hot, each of their
    strings by its hash. A string that the batch has earlier in the corpus is known."""
    rows: list[tuple] = []
    single: list[np.ndarray] = []
    held = count_single = 0

    def strings() -> pa.RecordBatch:
        high, low, doc, mark, at = np.concatenate(single, axis=1)
        order = np.lexsort((at, mark, doc, low, high))
        known = np.zeros(order.size, bool)
        known[order] = after_first(high[order], low[order], doc[order], mark[order], at[order])
        arrays = [pa.array(x) for x in (high, low, doc, mark, at, known)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(at.size, pa.binary())], names=_MET_NAMES)

    for batch in batches:
        for doc, mark, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), batch.column("wanted")):
            body = text_bytes(text.as_py())
            for w in wanted.as_py():
                at, count = w["at"] >> _TAG_BITS, w["shape"] >> 8
                if not w["hot"]:
                    rows.append((w["anchor"], 0, doc, mark, w["at"], False, body[at : at + count + length - 1]))
                    held += count + length
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                    continue
                digests = b"".join(xxhash.xxh3_128_digest(body[s : s + length]) for s in range(at, at + count))
                pair = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
                place = w["at"] + (np.arange(count, dtype=np.int64) << _TAG_BITS)
                single.append(np.stack([*pair, np.full(count, doc), np.full(count, mark), place]))
                count_single += count
                if count_single > SINGLES:
                    yield strings()
                    single, count_single = [], 0
    if rows:
        yield _rows(rows)
    if single:
        yield strings()


def after_first(high: np.ndarray, low: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows sorted by all five, whether a row's place is beyond the first of its (high, low)."""
    same = np.zeros(high.size, bool)
    same[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(high.size)))
    return (doc != doc[lead]) | (mark != mark[lead]) | (at != at[lead])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_MET_NAMES)


def _previous(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Removed ranges (doc, mark, at, n) from rows that come sorted by key, sub, doc, mark and at, in
    bounded buffers."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size, last = 0, None
    lead: tuple[int, ...] | None = None

    def settle() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
        width = np.array([len(h[4]) for h in held])
        base = np.cumsum(width) - width
        count = width - length + 1
        owner = np.repeat(np.arange(count.size), count)
        inner = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
        starts = base[owner] + inner
        doc, mark, at = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
        where = at[owner] + (inner << _TAG_BITS)
        order = np.lexsort((where, mark[owner], doc[owner]))
        moved = np.zeros(max(0, order.size - 1), bool)
        for x in (doc[owner], mark[owner], where):
            moved |= x[order][1:] != x[order][:-1]
        step = np.concatenate([[0], moved.astype(np.int64)])
        place = np.empty(order.size, np.int64)
        place[order] = np.cumsum(step)
        flags = has_previous(data, starts, place, length)
        # Runs end with their segment: a False between segments keeps them apart.
        spread = np.zeros(flags.size + count.size, bool)
        spread[np.arange(flags.size) + owner] = flags
        s, e = runs(spread)
        mine = np.searchsorted(np.cumsum(count + 1), s, "right")
        shift = (np.cumsum(count + 1) - (count + 1))[mine]
        low = at[mine] + ((s - shift) << _TAG_BITS)
        return _ranges(doc[mine], mark[mine], low, e - s)

    for batch in batches:
        lone = batch.filter(pc.is_null(batch.column("body")))
        if lone.num_rows:
            rows = [lone.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "doc", "mark", "at")]
            known = lone.column("known").to_numpy(zero_copy_only=False)
            if lead is not None:  # the first of a string may have come in an earlier batch
                rows = [np.concatenate([[x], r]) for x, r in zip(lead, rows)]
                known = np.concatenate([[False], known])
            late = after_first(*rows) | known
            yield _ranges(rows[2][late], rows[3][late], rows[4][late], np.ones(int(late.sum()), np.int64))
            same = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0]
            lead = tuple(int(r[same]) for r in rows)
        whole = batch.filter(pc.is_valid(batch.column("body")))
        for row in zip(*(whole.column(c).to_pylist() for c in ("key", "doc", "mark", "at", "body"))):
            if size >= BUFFER and row[0] != last:
                yield settle()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield settle()


def _ranges(doc: np.ndarray, mark: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, mark, at, n)], names=["doc", "mark", "at", "n"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
            body = text_bytes(text.as_py())
            merged: list[list[int]] = []
            for span in sorted((s["at"] >> _TAG_BITS, (s["at"] >> _TAG_BITS) + s["n"] + length - 1) for s in spans.as_py() or ()):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            kept, at = [], 0
            for low, high in merged:
                kept.append(body[at:low])
                at = high
            kept.append(body[at:])
            rest = b"".join(kept)
            rows.append((doc, len(body), len(body) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [x for span in merged for x in span]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    spans, the removed byte ranges as one flat list of starts and ends.

    A null text counts as empty, a null doc_id as smaller than all others. Rows that repeat a doc_id
    and text are one document listed twice, neither earlier than the other; different texts of one
    doc_id, or without any, are different documents in an order of their own. These are told apart by
    95 bits of two hashes of the text, beside the doc_id. `hot` only chooses between the two exact ways
    of settling an anchor.
    """
    if anchor < 8 or length <= anchor or length - anchor >= 256:
        raise ValueError("anchors have at least 8 bytes and fewer than the strings, by up to 255")
    spark = docs.sparkSession
    n = partitions(spark)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    whole = F.coalesce(text, F.lit(""))
    mark = F.xxhash64(whole).bitwiseAND(F.lit((1 << 63) - 1))
    ready = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), text.alias("text"),
        F.when(doc_id.isNull(), -1 - mark).otherwise(mark).alias("mark"),  # null comes before the smallest number too
        F.xxhash64(F.lit("second"), whole).bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).alias("tag"),
    )
    found = anchors(ready.select("doc", "mark", "tag", "text"), length, anchor).repartition(n, "anchor")
    # Equal segments of one task are known already, so an anchor has few rows a task and kind.
    fresh = found.withColumn("kind", F.dense_rank().over(W.partitionBy("anchor").orderBy("segment"))).withColumn(
        "turn", F.rank().over(W.partitionBy("anchor", "segment").orderBy("doc", "mark", "at"))
    )
    fresh = fresh.withColumn("kinds", F.max("kind").over(W.partitionBy("anchor")))
    later = F.col("known") | (F.col("turn") > 1)
    kept = fresh.where(later | (F.col("kinds") > 1)).select("anchor", "doc", "mark", "at", "shape", later.alias("later"), (F.col("kinds") > hot).alias("hot"))
    kept = materialize(kept, "segments")
    later = kept.where("later").select("doc", "mark", "at", F.expr("shiftright(shape, 8)").cast("long").alias("n"))
    heads = kept.where("not later").dropDuplicates(["anchor", "doc", "mark", "at"])
    tag = F.col("at").bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).alias("tag")
    wanted = heads.groupBy("doc", "mark", tag).agg(F.collect_list(F.struct("anchor", "at", "shape", "hot")).alias("wanted"))
    # Both joins below read this one exchange of the texts; doc_id is kept in the first to that end.
    base = ready.select("doc_id", "doc", "mark", "tag", "text").repartition(n, "doc", "mark", "tag")
    met = base.join(wanted, ["doc", "mark", "tag"]).select("doc_id", "doc", "mark", "text", "wanted").mapInArrow(lambda b: _strings(b, length), _MET)
    met = met.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "doc", "mark", "at")
    spans = later.unionByName(met.mapInArrow(lambda b: _previous(b, length), "doc long, mark long, at long, n long"))
    by_doc = spans.groupBy("doc", "mark", tag).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = base.join(by_doc, ["doc", "mark", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        lambda b: _cut(b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    )
