"""Line-set similarity join and diffs against similar earlier texts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import by_slices
from ..functions.text import js_len, let, lines
from ..workdir import materialize
from . import crossrow

LEAST_SIMILARITY, DIFF_LEAST, DIFF_SHARE = 0.5, 200, 0.5
MAX_EDITS = 4096
LENGTH_BITS = 20
LONGEST = (1 << LENGTH_BITS) - 1


def line_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lines; 0 if lengths are more than half the longer apart."""
    x, y = F.array_distinct(lines(a)), F.array_distinct(lines(b))
    apart = F.abs(js_len(a) - js_len(b)) > F.greatest(js_len(a), js_len(b)) * 0.5
    return F.when(apart, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def marked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __hash, __len and __lines, unless it has them: a number for each distinct line of a text, 44
    bits of its hash and then its length up to LONGEST. What is alike in texts, and how long what is not at
    least is, can be told from these; texts are fetched only for the pairs that may count."""
    if "__lines" in df.columns:
        return df
    number = lambda x: F.shiftleft(F.xxhash64(x), LENGTH_BITS).bitwiseOR(F.least(F.length(x), F.lit(LONGEST)).cast("long"))
    return crossrow.marked(df, text).withColumn("__lines", F.transform(F.array_distinct(lines(F.col(text))), number))


def least_new(new: str, old: str) -> Column:
    """At least so many characters of the one text are in lines that the other has not: both by __lines."""
    return F.aggregate(F.array_except(new, old), F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(LONGEST).cast("long")))


def distinct_texts(df: DataFrame, key: str, text: str, group: str | None) -> DataFrame:
    """(g, id, last, hash, len, lines): one row for each distinct text of a group, id its smallest key and last
    its largest; written once, without the texts. A null group is one of its own; without a group all rows are one."""
    own = F.lit(None).cast("string") if group is None else F.col(group)
    held = marked(df, text).where("__hash is not null").select(own.alias("g"), F.col(key).alias("k"), F.col("__hash").alias("hash"), F.col("__len").alias("len"), F.col("__lines").alias("lines"))
    once = held.groupBy("g", "hash").agg(F.min("k").alias("id"), F.max("k").alias("last"), F.first("len").alias("len"), F.first("lines").alias("lines"))
    return materialize(once, "texts")


def similar_pairs(df: DataFrame, key: str, text: str = "text", least: float = LEAST_SIMILARITY, group: str | None = None) -> DataFrame:
    """(a, b, similarity) of the pairs a < b of distinct texts whose line sets are over `least` alike,
    preceded by the group where one is named: texts are compared within their group alone.

    Copies collapse to their smallest key before the join. See candidates for which pairs are compared in
    full. Keys are unique within a group.
    """
    pairs = materialize(candidates(distinct_texts(df, key, text, group), least), "pairs")
    own = F.lit(None).cast("string") if group is None else F.col(group)
    held = texts_of(df.select(own.alias("g"), F.col(key).alias("id"), F.col(text).alias("text")), pairs)
    one, two = (held.select(F.col("g").alias(f"g{x}"), F.col("id").alias(f"i{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(one, F.col("g").eqNullSafe(F.col("ga")) & (F.col("a") == F.col("ia"))).join(two, F.col("g").eqNullSafe(F.col("gb")) & (F.col("b") == F.col("ib")))
    out = both.withColumn("similarity", _alike("ta", "tb")).where(F.col("similarity") > least).select("g", "a", "b", "similarity")
    return out.drop("g") if group is None else out.withColumnRenamed("g", group)


def _alike(a: str, b: str) -> Column:
    """Jaccard similarity of the line sets of two texts, whatever their lengths."""
    sets = F.struct(F.array_distinct(lines(F.col(a))).alias("x"), F.array_distinct(lines(F.col(b))).alias("y"))
    return let(sets, lambda s: let(F.size(F.array_intersect(s.x, s.y)), lambda n: n / (F.size(s.x) + F.size(s.y) - n)))


def texts_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, id, text) of those rows(g, id, text) that pairs(g, a, b), a written table, name; written once.
    Few pairs go to the rows, and the other texts stay where they are."""
    wanted = pairs.select("g", F.col("a").alias("id")).union(pairs.select("g", F.col("b").alias("id"))).distinct().select(F.col("g").alias("__g"), F.col("id").alias("__id"))
    wanted = materialize(wanted, "wanted")
    return materialize(rows.join(wanted, F.col("g").eqNullSafe(F.col("__g")) & (F.col("id") == F.col("__id")), "left_semi"), "compared")


def candidates(texts: DataFrame, least: float) -> DataFrame:
    """(g, a, b): pairs a < b of distinct_texts, among them all whose line sets are over `least` alike, and
    no others but by equal hashes of different lines.

    Lines are ordered by how few texts of the group hold them, those of one text first and so left out. Two
    sets over `least` alike share more than so many lines, by their sizes; the first that they share is
    followed by all the others, so it stands before so many in both. The smaller set of a pair need bring
    only lines before what it would share with one of its own size (prefix and positional filters): a line
    that very many texts share pairs only texts that have hardly any rarer one.
    """
    each = texts.select("g", "id", "len", F.size("lines").alias("n"), F.explode("lines").alias("h"))
    rarity = each.groupBy(F.col("g").alias("__g"), F.col("h").alias("__h")).agg(F.count("*").alias("df")).where("df > 1")
    placed = each.join(rarity, F.col("g").eqNullSafe(F.col("__g")) & (F.col("h") == F.col("__h")))
    placed = placed.withColumn("rest", F.row_number().over(W.partitionBy("g", "id").orderBy(F.desc("df"), F.desc("h"))))  # lines from this one on
    share, slack = least / (1 + least), 1e-9
    prefix = placed.where(F.col("rest") > F.col("n") * least - slack).select("g", "id", "len", "n", "h", "rest")
    a, b = prefix.where(F.col("rest") > F.col("n") * (2 * share) - slack).alias("a"), prefix.alias("b")
    fits = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    fits = fits & (F.least("a.rest", "b.rest") > (F.col("a.n") + F.col("b.n")) * share - slack)
    fits = fits & (F.abs(F.col("a.len") - F.col("b.len")) <= F.greatest("a.len", "b.len") * 0.5)
    same = (F.col("a.h") == F.col("b.h")) & F.col("a.g").eqNullSafe(F.col("b.g"))
    met = a.join(b, same & fits).select(F.col("a.g").alias("g"), F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    one, two = (texts.select(F.col("g").alias(f"g{x}"), F.col("id").alias(f"i{x}"), F.col("lines").alias(f"l{x}")) for x in "ab")
    met = met.join(one, F.col("g").eqNullSafe(F.col("ga")) & (F.col("a") == F.col("ia"))).join(two, F.col("g").eqNullSafe(F.col("gb")) & (F.col("b") == F.col("ib")))
    both = F.size("la") - F.size(F.array_except("la", "lb"))  # at least the lines they share
    met = met.withColumn("both", both)
    return met.where(F.col("both") / (F.size("la") + F.size("lb") - F.col("both")) > least).select("g", "a", "b")


def edit_script(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Changed ranges (a from, a to, b from, b to) by Myers' greedy algorithm, common ends apart. What takes
    more than MAX_EDITS steps is one change of all between the ends: the way back holds a number of four bytes
    for each step and every second diagonal, some 2 * MAX_EDITS^2 bytes at most."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    n, m = len(x), len(y)
    limit = min(n + m, MAX_EDITS)
    frontier, trace, mid = array("i", [-1]) * (2 * limit + 5), [], limit + 2  # places of -limit - 2 to limit + 2
    frontier[mid + 1] = 0
    for d in range(limit + 1):
        trace.append(frontier[mid - d - 1 : mid + d + 2 : 2])  # a step reads only the diagonals beside its own
        for k in range(-d, d + 1, 2):
            left, right = frontier[mid + k - 1], frontier[mid + k + 1]
            i = right if k == -d or (k != d and left < right) else left + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            frontier[mid + k] = i
            if i >= n and i - k >= m:
                break
        else:
            continue
        break
    else:
        return [(low, low + n, low, low + m)]
    i, j, steps = n, m, []
    for d in range(len(trace) - 1, -1, -1):
        if not (i or j):
            break
        v, k = trace[d], i - j
        left, right = v[(k + d) // 2], v[(k + d) // 2 + 1]  # of k - 1 and k + 1, the first place being that of -d - 1
        down = k == -d or (k != d and left < right)
        p = right if down else left
        q = p - (k + 1 if down else k - 1)
        while i > p + (not down) and j > q + down and i and j:
            i, j = i - 1, j - 1
        if d:
            steps.append((i, j, down))
            i, j = p, q
    changes: list[list[int]] = []
    for i, j, down in reversed(steps):
        span = [i, i, j - 1, j] if down else [i - 1, i, j, j]
        if changes and changes[-1][1] == span[0] and changes[-1][3] == span[2]:
            changes[-1][1], changes[-1][3] = span[1], span[3]
        else:
            changes.append(span)
    return [(s[0] + low, s[1] + low, s[2] + low, s[3] + low) for s in changes]


def unified_hunks(old: str, new: str, context: int = 1) -> str:
    """Hunks of a unified diff of two texts by line."""
    a, b = old.split("\n"), new.split("\n")
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in edit_script(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        s, e = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        t, f = max(0, g[0][2] - context), min(len(b), g[-1][3] + context)
        out.append(f"@@ -{s + 1},{e - s} +{t + 1},{f - t} @@")
        at = s
        for i, j, k, m in g:
            out += [" " + x for x in a[at:i]] + ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]]
            at = j
        out += [" " + x for x in a[at:e]]
    return "\n".join(out)


def apply_hunks(old: str, hunks: str) -> str:
    """The new text from the old one and its hunks."""
    a, out, at = old.split("\n"), [], 0
    for line in hunks.split("\n") if hunks else []:
        if line.startswith("@@ "):
            start = int(line.split(" ")[1][1:].split(",")[0]) - 1
            out += a[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            at += 1
            if line[0] == " ":
                out.append(line[1:])
    return "\n".join(out + a[at:])


@F.arrow_udf(T.StringType())
def hunks(old: pa.Array, new: pa.Array) -> pa.Array:
    return by_slices(lambda a, b: unified_hunks(a, b) if a is not None and b is not None else None, pa.string(), old, new)


@F.arrow_udf(T.StringType())
def restored(old: pa.Array, patch: pa.Array) -> pa.Array:
    return by_slices(lambda a, p: apply_hunks(a, p) if a is not None and p is not None else None, pa.string(), old, patch)


def first_base(df: DataFrame, group: str, order: str, text: str = "text") -> DataFrame:
    """(group, order, base, similarity, patch) of rows that a diff replaces: the first earlier row of the
    group over half but not wholly alike whose hunks are under half the text. Needs order unique in a group.

    Only texts of one group are paired, and each pair of distinct texts is diffed once: the base of a
    row is the first row that has a text, and whether a text serves as base is the pair's matter alone.
    """
    df = marked(df, text)
    texts = distinct_texts(df, order, text, group)
    pairs = candidates(texts, LEAST_SIMILARITY)
    both = pairs.union(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    new = texts.where(F.col("len") >= DIFF_LEAST).select(F.col("g").alias("__g"), "id", "last", "hash")
    tried = materialize(both.join(new, F.col("g").eqNullSafe(F.col("__g")) & (F.col("b") == F.col("id"))).where("a < last").select("g", "hash", "a", "b"), "pairs")
    held = texts_of(df.select(F.col(group).alias("g"), F.col(order).alias("id"), F.col(text).alias("text")), tried)
    old, new = (held.select(F.col("g").alias(f"g{x}"), F.col("id").alias(f"i{x}"), F.col("text").alias(x)) for x in ("old", "new"))
    tried = tried.join(old, F.col("g").eqNullSafe(F.col("gold")) & (F.col("a") == F.col("iold"))).join(new, F.col("g").eqNullSafe(F.col("gnew")) & (F.col("b") == F.col("inew")))
    tried = tried.withColumn("similarity", _alike("old", "new")).where(F.col("similarity") > LEAST_SIMILARITY)
    bases = _first_short(tried.select(F.col("g").alias("gb"), "hash", F.col("a").alias("base"), "similarity", "old", "new"))
    rows = df.where("__hash is not null").select(F.col(group).alias("g"), F.col(order).alias("o"), F.col("__hash").alias("h"))
    found = rows.join(bases, F.col("g").eqNullSafe(F.col("gb")) & (F.col("h") == F.col("hash"))).where("base < o")
    return found.select(F.col("g").alias(group), F.col("o").alias(order), "base", "similarity", "patch")


def _first_short(tried: DataFrame) -> DataFrame:
    """(gb, hash, base, similarity, patch) of tried(gb, hash, base, similarity, old, new): for each new text
    the smallest base whose hunks are short enough. Candidates pass in order of base, one at a time, and
    none is diffed after the first that serves."""
    spark = tried.sparkSession
    place = ["gb", "hash", "base"]
    dealt = tried.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gb", "hash").sortWithinPartitions(*place)
    schema = T.StructType([*(tried.schema[c] for c in (*place, "similarity")), T.StructField("patch", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, served = None, False
        for batch in batches:
            patches = []
            for group, hash_, old, new in zip(*(batch.column(c) for c in ("gb", "hash", "old", "new"))):
                key = (group.as_py(), hash_.as_py())
                if key != now:
                    now, served = key, False
                patch = None if served else unified_hunks(old.as_py(), new := new.as_py())
                served = served or utf16(patch) < DIFF_SHARE * utf16(new)
                patches.append(patch if patch is not None and served else None)
            out = pa.array(patches, pa.string())
            kept = batch.select([*place, "similarity"]).append_column("patch", out)
            yield kept.filter(out.is_valid())

    return dealt.mapInArrow(run, schema)


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2
