"""How far the sources of a language differ in their terms, in exact integers.

A group is a (lang, source); a kept term of a language is one in at least `least_docs` of its documents.
A term with c occurrences in a group has the smoothed share p(c) = 1 + floor(SCALE * (c + 1) / (N + V)),
N occurrences of kept terms in the group and V kept terms in the language. Two shares p and q are
f(p, q) = floor((p - q)^2 / q) apart, and two groups the sum of f over all kept terms.

That sum is never taken term by term. With S_g the terms that g has and p0 the share of an absent term,

    sum f = V f(p0, q0)                                             every term, as if absent in both
          + over S_g of f(p, q0) - f(p0, q0)                        from the histogram of g's counts
          + over S_o of f(p0, q) - f(p0, q0)                        from the histogram of o's counts
          + over both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)  from a join of the postings

The shares of a group add up to at most SCALE + 2 V, so sums of squares stay below the square of
2 SCALE + 4 V: 64 bits hold them up to 10^8 kept terms; beyond, Spark's ANSI sums raise and never wrap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, remove, slices, written

SCALE = 1_000_000_000
# Runs of letters and of whatever is not ASCII are terms; A to Z become lower case, all else parts them.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A task hands on its counts when it holds so many.
HELD = 1 << 19


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count; the product is a decimal, as it passes 64 bits from 10^10 occurrences on."""
    wide = ((count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"))
    return F.lit(1) + F.call_function("div", wide, (n + v).cast("decimal(28,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of docs(lang, source, text): occurrences, and documents that have the term.

    Each task counts its own documents, up to HELD terms at a time, and only counts are exchanged.
    """
    given = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                rows = len(n)
                numbers = [pa.array(v, pa.int64()) for v in (list(n.values()), list(map(df.__getitem__, n)))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows), pa.array([source] * rows), pa.array(list(n), pa.binary()), *numbers], ["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", 1 << 24):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    found = text.translate(KEPT).split()
                    if found:
                        n, df = held.setdefault((lang, source), (Counter(), Counter()))
                        before = len(n)
                        n.update(found)
                        df.update(set(found))
                        size += len(n) - before
                    if size > HELD:
                        yield from emit()
                        size = 0
        yield from emit()

    each = given.mapInArrow(count, "lang string, source string, term binary, n long, df long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).withColumn("term", F.col("term").cast("string"))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of a documents table.

    Part `pair`: for each other source of the language, how far this one is from it, all ranks. Part
    `term`: the terms that the group has and has more often than its language, the `top` furthest ones.
    Ranks start at 1 in a group and part, by falling value and then the item's bytes. Null text, lang and
    source are ''; a group without terms takes part with N = 0; a language without kept terms has pairs of
    0; a language of one source has no pair; repeated rows are documents of their own; an empty table has
    no rows; other columns are not read. Only counts are shuffled: a hot source or term is summed before
    the exchange, and the joins on (lang, term) have a row a source on either side.
    """
    spark = docs.sparkSession
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted, path = written(postings(given), "postings")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).drop("df")
    posted = materialize(counted.drop("df").join(kept, ["lang", "term"]), "kept")
    remove(spark, path)
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = posted.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total"))
    groups = materialize(
        given.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sizes, ["lang", "source"], "left").join(v, ["lang"], "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "total"))),
        "groups",
    )
    absent = groups.select("lang", "source", "v", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).alias("p0"))
    priced = posted.withColumnRenamed("n", "c").join(groups, ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n_lang", "total", "v", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    pairs = _pairs(absent, priced)
    below = priced.withColumn("q", share(F.col("n_lang"), F.col("total"), F.col("v"))).where("p > q")
    best = below.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # The limit on a rank is applied to each partition before the exchange, so a hot group is cut there.
    return pairs.withColumn("rank", place).unionByName(best.withColumn("rank", place).where(F.col("rank") <= top))


def _pairs(absent: DataFrame, priced: DataFrame) -> DataFrame:
    g, o = absent.select("lang", "source", "v", "p0"), absent.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = g.join(o, "lang").where("source <> item")
    none = apart(F.col("p0"), F.col("q0"))
    parts = [both.select("lang", "source", "item", F.coalesce(F.col("v") * none, F.lit(0)).alias("value"))]
    # A row a group and count: at most about the square root of twice its words.
    bars = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    mine = bars.join(both, ["lang", "source"])
    parts.append(mine.select("lang", "source", "item", (F.col("k") * (apart(F.col("p"), F.col("q0")) - none)).alias("value")))
    theirs = bars.withColumnsRenamed({"source": "item", "p": "q"}).join(both, ["lang", "item"])
    parts.append(theirs.select("lang", "source", "item", (F.col("k") * (apart(F.col("p0"), F.col("q")) - none)).alias("value")))
    # Pairs of postings of one term, each pair of sources once, then both directions.
    known = priced.join(absent.select("lang", "source", "p0"), ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    other = known.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = known.join(other, ["lang", "term"]).where("source < item")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    overlap = met.groupBy("lang", "source", "item").agg(
        F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("there"),
        F.sum(apart(q, p) - apart(q, p0) - apart(q0, p) + apart(q0, p0)).alias("back"),
    )
    parts.append(overlap.select("lang", "source", "item", F.col("there").alias("value")))
    parts.append(overlap.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
