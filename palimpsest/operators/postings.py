"""Lines as counts of the terms that are asked for, and their BM25 scores, a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# What is held at once: rows of (query, term), numbers of (target, term), and cells of lines by queries.
MOST_TERMS, MOST_STATS, CELLS = 1 << 20, 1 << 22, 1 << 20
DL, TERMS, COUNTS = "__dl", "__terms", "__f"
BLOCKS = 32  # of lines whose lengths are of one power of two

#: (scores of a slice, lines by queries; their costs) -> which of them may be in the head of a ranking.
Cut = Callable[[np.ndarray, np.ndarray | None], np.ndarray]


@dataclass(frozen=True)
class Asked:
    """The distinct terms of queries: term i is asked for by ids[item[start[i]:start[i + 1]]]."""

    terms: list[str]
    ids: list
    start: np.ndarray
    item: np.ndarray


@dataclass(frozen=True)
class Stats:
    """Each target's mean length, and its terms' idf: that of term i of target t at t * terms + i."""

    targets: list
    avgdl: np.ndarray
    idf: np.ndarray


def asked(terms: DataFrame) -> Asked | None:
    """terms(id, term), a row for each term of a query; None where there are none or more than MOST_TERMS."""
    rows = terms.limit(MOST_TERMS + 1).collect()
    if not 0 < len(rows) <= MOST_TERMS:
        return None
    place = {w: k for k, w in enumerate(sorted({r[1] for r in rows}))}
    ids = {i: k for k, i in enumerate(dict.fromkeys(r[0] for r in rows))}
    term, item = np.array([place[r[1]] for r in rows]), np.array([ids[r[0]] for r in rows])
    order = np.argsort(term, kind="stable")
    return Asked(list(place), list(ids), np.searchsorted(term[order], np.arange(len(place) + 1)), item[order])


def counted(docs: DataFrame, target: str, line: str, toks: Column, terms: list[str]) -> DataFrame:
    """(target, line, __dl, __terms, __f): of each row its number of tokens, and the asked terms it holds, as places
    in terms, with their counts. Rows without a target are left out."""
    given = docs.where(F.col(target).isNotNull()).select(target, line, toks.alias("__toks"))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([given.schema[target], given.schema[line], T.StructField(DL, T.IntegerType()), T.StructField(TERMS, numbers), T.StructField(COUNTS, numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(terms, pa.string())
        for batch in batches:
            each = batch.column("__toks")
            dl = each.value_lengths().to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(each.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
            key = (np.repeat(np.arange(len(batch)), dl) * len(terms) + found)[found >= 0]
            key, f = np.unique(key, return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(batch) + 1) * len(terms)), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % len(terms), f)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dl, pa.int32()), *arrays], names=schema.names)

    return given.mapInArrow(run, schema)


def stats(counts: DataFrame, target: str, width: int) -> Stats | None:
    """Of counted rows over `width` terms; None where that is more than MOST_STATS numbers."""
    sizes = counts.groupBy(target).agg(F.count("*").alias("n"), F.avg(DL).alias("avgdl")).limit(MOST_STATS // width + 1).collect()
    if len(sizes) * width > MOST_STATS:
        return None
    place = {r[0]: k for k, r in enumerate(sizes)}
    df = np.zeros(len(sizes) * width)
    held = counts.select(target, F.explode(TERMS).alias("term")).groupBy(target, "term").agg(F.count("*").alias("df"))
    for r in held.collect():  # no more than MOST_STATS rows
        df[place[r[0]] * width + r[1]] = r[2]
    n = np.repeat([float(r[1]) for r in sizes], width)
    return Stats(list(place), np.array([r[2] for r in sizes], float), np.log(1 + (n - df + 0.5) / (df + 0.5)))


def _parts(batch: pa.RecordBatch, target: str, of: Stats, width: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, part) of all postings of a batch, row by row: what each adds to its line's score."""
    each = batch.column(TERMS)
    t = pc.index_in(batch.column(target), value_set=pa.array(of.targets, batch.column(target).type)).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(batch)), each.value_lengths().to_numpy(zero_copy_only=False))
    term, f = (x.flatten().to_numpy(zero_copy_only=False) for x in (each, batch.column(COUNTS)))
    with np.errstate(invalid="ignore", divide="ignore"):  # a target without any token has no postings
        base = k1 * (1 - b + b * (batch.column(DL).to_numpy(zero_copy_only=False) / of.avgdl[t]))
    return row, term, of.idf[t[row] * width + term] * (f * (k1 + 1) / (f + base[row]))


def weighed(counts: DataFrame, target: str, line: str, of: Stats, terms: list[str], k1: float, b: float) -> DataFrame:
    """(target, line, dl, term, part): a row for each posting of counted rows."""
    schema = T.StructType([counts.schema[target], counts.schema[line], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("part", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(terms, pa.string())
        for batch in batches:
            row, term, part = _parts(batch, target, of, len(terms), k1, b)
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in (target, line, DL)), words.take(pa.array(term)), pa.array(part)], names=schema.names)

    return counts.mapInArrow(run, schema)


def scored(counts: DataFrame, target: str, line: str, query_id: T.StructField, of: Stats, by: Asked, k1: float, b: float, cut: Callable[[int], Cut] | None = None, cost: str | None = None, gold: str | None = None) -> DataFrame:
    """(target, line, query_id, score) of each counted row and query that share a term, then cost, gold and rest.

    Rows are scored for all queries in slices of at most about CELLS cells and CELLS sums, so memory is bounded
    however many rows, queries or shared terms there are, and nothing is exchanged. cut, made once a task from
    the number of queries, may leave pairs out. The gold ones among these are counted: rest is null in a row
    of a pair, and is their number in a last row of the task for each query that has some.
    """
    more = [c for c in (cost, gold) if c is not None]
    schema = T.StructType([counts.schema[target], counts.schema[line], query_id, T.StructField("score", T.DoubleType()), *(counts.schema[c] for c in more)])
    if gold is not None:
        schema = schema.add("rest", T.LongType())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    kinds, width, reach = [to_arrow_type(f.dataType) for f in schema], len(by.ids), np.diff(by.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(by.ids, kinds[2])
        left, choose = np.zeros(width, np.int64), cut(width) if cut else None
        for batch in batches:
            row, term, part = _parts(batch, target, of, len(by.terms), k1, b)
            reps = reach[term]
            first = np.searchsorted(row, np.arange(len(batch) + 1))  # of each row's postings
            sums = np.concatenate([[0], np.cumsum(reps)])[first]
            low = 0
            while low < len(batch):
                high = min(low + max(1, CELLS // width), int(np.searchsorted(sums, sums[low] + CELLS, "right")) - 1)
                high = min(max(high, low + 1), len(batch))
                own = slice(first[low], first[high])
                r = reps[own]
                at = np.repeat(by.start[term[own]] - (np.cumsum(r) - r), r) + np.arange(r.sum())
                cells = np.repeat((row[own] - low) * width, r) + by.item[at]
                score = np.bincount(cells, np.repeat(part[own], r), (high - low) * width).reshape(high - low, width)
                some = score > 0
                if choose:
                    kept = some & choose(score, batch.column(cost).slice(low, high - low).to_numpy(zero_copy_only=False) if cost else None)
                    if gold is not None:
                        left += (some & ~kept)[pc.fill_null(batch.column(gold).slice(low, high - low), False).to_numpy(zero_copy_only=False)].sum(0)
                    some = kept
                i, q = np.nonzero(some)
                place = pa.array(low + i)
                out = [batch.column(target).take(place), batch.column(line).take(place), ids.take(pa.array(q)), pa.array(score[i, q]), *(batch.column(c).take(place) for c in more)]
                yield pa.RecordBatch.from_arrays(out if gold is None else [*out, pa.nulls(len(i), pa.int64())], names=schema.names)
                low = high
        if left.any():
            q = np.flatnonzero(left)
            none = [pa.nulls(len(q), kind) for kind in kinds]
            none[2], none[-1] = ids.take(pa.array(q)), pa.array(left[q])
            yield pa.RecordBatch.from_arrays(none, names=schema.names)

    return counts.mapInArrow(run, schema)


def _block(dl: np.ndarray) -> np.ndarray:
    """The block of lines of so many tokens, at least one: from a half of its longest on."""
    return np.frexp(dl)[1] - 1


def bounded(of: Stats, by: Asked) -> bool:
    """Whether what says where each query's terms may lead is few enough numbers for strongest and hopeful."""
    return len(of.targets) * BLOCKS * len(by.item) <= MOST_STATS and len(of.targets) * len(by.ids) <= MOST_STATS


def strongest(counts: DataFrame, target: str, line: str, of: Stats, width: int, k1: float, b: float, k: int) -> DataFrame:
    """(target, line, term, block, part) of counted rows: of each task, the k strongest lines of each term, where
    block is null, and the strongest part of each term and block, where line is null."""
    schema = T.StructType([counts.schema[target], T.StructField(line, counts.schema[line].dataType), T.StructField("term", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("part", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(of.targets) * width * BLOCKS)
        key, parts, at = np.empty(0, np.int64), np.empty(0), pa.array([], kinds[1])
        for batch in batches:
            row, term, part = _parts(batch, target, of, width, k1, b)
            t = pc.index_in(batch.column(target), value_set=pa.array(of.targets, kinds[0])).to_numpy(zero_copy_only=False)
            own = t[row] * np.int64(width) + term
            np.maximum.at(most, own * BLOCKS + _block(batch.column(DL).to_numpy(zero_copy_only=False)[row]), part)
            own, part, place = np.concatenate([key, own]), np.concatenate([parts, part]), np.concatenate([np.arange(len(key)), len(key) + row])
            order = np.lexsort((-part, own))
            first = np.searchsorted(own[order], own[order])
            kept = order[np.arange(len(order)) - first < k]
            held = pa.concat_arrays([at, batch.column(line)])
            key, parts, at = own[kept], part[kept], held.take(pa.array(place[kept]))
        some = np.flatnonzero(most)
        ids = pa.array(of.targets, kinds[0])
        for at_, key_, block, part in ((at, key, pa.nulls(len(key), kinds[3]), parts), (pa.nulls(len(some), kinds[1]), some // BLOCKS, pa.array(some % BLOCKS, kinds[3]), most[some])):
            if len(key_):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(key_ // width)), at_, pa.array(key_ % width, kinds[2]), block, pa.array(part)], names=schema.names)

    return counts.mapInArrow(run, schema)


def leads(most: np.ndarray, bars: np.ndarray, by: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Of the strongest parts (target, block, term) and the bars (target, query): which terms of a query may
    lead a line of a block to its bar (target, block, place in by.item), and what the others can add at most
    (target, block, query). The weakest terms that together stay below the bar lead nowhere."""
    term = np.repeat(np.arange(len(by.terms)), np.diff(by.start))
    lead, rest = np.zeros((*most.shape[:2], len(term)), bool), np.zeros((*most.shape[:2], len(by.ids)))
    for t, block in np.ndindex(*most.shape[:2]):
        part = most[t, block, term]
        order = np.lexsort((term, part, by.item))
        item, run = by.item[order], np.cumsum(part[order])
        begins = np.searchsorted(item, item)
        run = run - (run - part[order])[begins]
        lead[t, block, order] = (run >= bars[t][item] - 1e-9) & (part[order] > 0)
        rest[t, block] = np.bincount(by.item[~lead[t, block]], part[~lead[t, block]], len(by.ids))
    return lead, rest


def hopeful(counts: DataFrame, target: str, line: str, query_id: T.StructField, of: Stats, by: Asked, lead: np.ndarray, rest: np.ndarray, bars: np.ndarray, k1: float, b: float) -> DataFrame:
    """(target, line, query_id, score) of the pairs of counted rows and queries whose score reaches the bar.

    In slices as in scored, but only leading terms are summed at first; the others are looked up for the
    pairs that reach the bar with these at their strongest."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (counts.schema[target], counts.schema[line], query_id)] + [T.StructField("score", T.DoubleType())])
    kinds, width, pairs = [to_arrow_type(f.dataType) for f in schema], len(by.ids), len(by.item)
    reach = np.diff(by.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(by.ids, kinds[2])
        flat = lead.reshape(-1)
        sets = [(np.concatenate([[0], np.cumsum(x)]), np.tile(by.item, lead.shape[0] * BLOCKS)[x]) for x in (flat, ~flat)]
        for batch in batches:
            row, term, part = _parts(batch, target, of, len(by.terms), k1, b)
            t = pc.index_in(batch.column(target), value_set=pa.array(of.targets, kinds[0])).to_numpy(zero_copy_only=False)
            dl = batch.column(DL).to_numpy(zero_copy_only=False)
            place = t.astype(np.int64) * BLOCKS + _block(np.maximum(dl, 1))  # a line without a token has no postings
            first = np.searchsorted(row, np.arange(len(batch) + 1))  # of each row's postings
            sums = np.concatenate([[0], np.cumsum(reach[term])])[first]
            low = 0
            while low < len(batch):
                high = min(low + max(1, CELLS // width), int(np.searchsorted(sums, sums[low] + CELLS, "right")) - 1)
                high = min(max(high, low + 1), len(batch))
                shape = (high - low, width)

                def summed(own: np.ndarray, which: int) -> np.ndarray:
                    """What the terms that lead (0), or the others (1), of these postings add to each line and query."""
                    ends, items = sets[which]
                    base = place[row[own]] * pairs
                    start = ends[base + by.start[term[own]]]
                    r = ends[base + by.start[term[own] + 1]] - start
                    at = np.repeat(start - (np.cumsum(r) - r), r) + np.arange(r.sum())
                    return np.bincount(np.repeat((row[own] - low) * width, r) + items[at], np.repeat(part[own], r), shape[0] * width).reshape(shape)

                own = np.arange(first[low], first[high])
                score, bar = summed(own, 0), bars[t[low:high]]
                may = (score > 0) & (score + rest.reshape(-1, width)[place[low:high]] >= bar - 1e-9)
                score += np.where(may, summed(own[may.any(1)[row[own] - low]], 1), 0)
                i, q = np.nonzero(may & (score >= bar - 1e-9))
                rows = pa.array(low + i)
                yield pa.RecordBatch.from_arrays([batch.column(target).take(rows), batch.column(line).take(rows), ids.take(pa.array(q)), pa.array(score[i, q])], names=schema.names)
                low = high

    return counts.mapInArrow(run, schema)


def best(k: int, slack: float) -> Callable[[int], Cut]:
    """A cut that leaves out what `slack` or more below the k-th highest score of its query so far is."""

    def make(width: int) -> Cut:
        top = np.zeros((k, width))

        def choose(score: np.ndarray, _: np.ndarray | None) -> np.ndarray:
            nonlocal top
            every = np.concatenate([top, score])
            top = np.partition(every, len(every) - k, axis=0)[len(every) - k :]
            return score >= top.min(axis=0) - slack

        return choose

    return make


def affordable(budget: int, slack: float) -> Callable[[int], Cut]:
    """A cut that leaves out what comes after lines, of a slice and by more than `slack` better ones, whose costs
    exceed the budget already: the line that exceeds it stays, as none after it may fit in its place."""

    def make(_: int) -> Cut:
        def choose(score: np.ndarray, cost: np.ndarray) -> np.ndarray:
            order = np.argsort(-score, axis=0, kind="stable")
            falling = np.take_along_axis(-score, order, axis=0)
            spent = np.concatenate([np.zeros((1, score.shape[1]), cost.dtype), np.cumsum(cost[order], axis=0)])
            kept = np.empty(score.shape, bool)
            for q in range(score.shape[1]):
                better = np.searchsorted(falling[:, q], -(score[:, q] + slack), "left")
                kept[:, q] = spent[better, q] <= budget
            return kept

        return choose

    return make
