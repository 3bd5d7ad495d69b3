"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is r times its size takes floor(r) whole copies of every document for certain.
The rest of its words come from a Pareto order sample (Rosen, 1997) with inclusion odds in proportion
to size: documents whose odds reach one are taken for certain, the others rank by their random odds
over their inclusion odds. The sample's size is fixed in words, as targets are: it is the head of that
order whose words come nearest to what is left. Random numbers are digests of the identifier, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 4096
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    """What tells a document from others: its doc_id, or where that is null, its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))


def uniform(who: Column, seed: str) -> Column:
    """A number inside (0, 1) of 52 bits from the MD5 of seed and identity."""
    digest = F.md5(F.concat(F.lit(seed + ":"), who))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share the total; a target stops at
    `most` times its source's size and the excess goes to the others by weight. With sources in order
    of size over weight this is one level: the first at which no later source is above its cap.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("__w", pick.cast("long")).withColumn("__cap", F.col("source_size") * most)
    order = [(F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last()]
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stepped = weighed.withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(upto), F.lit(0))).withColumn(
        "__open", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(upto), F.lit(0))
    )
    level = F.col("__left") / F.col("__open")
    # Once the caps of sources with less room are taken, the first source below its cap sets the level.
    first = F.struct((F.col("__cap") / F.col("__w")).alias("room"), level.alias("level"))
    level = F.min(F.when(level * F.col("__w") <= F.col("__cap"), first)).over(every)["level"]
    share = F.least(F.coalesce(level * F.col("__w"), F.col("__cap").cast("double")), F.col("__cap").cast("double"))
    return stepped.select("source", "source_size", F.round(share, 6).alias("target"))


def goals(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row a source of sizes(source, size, n), the number of documents of each size: source_size,
    target, __whole copies, the words __need beyond them, and __per_word, the inclusion odds a word.

    A sample of __need words with odds of min(1, __per_word * size) has __need words in the mean. Down
    from the largest size, __per_word is known at the first size whose odds are not above one, when all
    larger ones are certain.
    """
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("__whole", F.least(F.floor(rate), F.lit(most)).cast("long"))
    goal = goal.withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size")).withColumnRenamed("source", "__source")
    down = W.partitionBy("source").orderBy(F.col("size").desc())
    squares = F.col("size").cast("double") * F.col("size") * F.col("n")
    kinds = sizes.where("size > 0").withColumn("__above", F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kinds = kinds.withColumn("__below", F.sum(squares).over(down.rowsBetween(W.currentRow, W.unboundedFollowing)))
    kinds = kinds.join(goal.select("__source", "__need"), kinds["source"].eqNullSafe(F.col("__source")))
    per_word = (F.col("__need") - F.col("__above")) / F.col("__below")
    largest = F.max(F.when(per_word * F.col("size") <= 1, F.struct("size", per_word.alias("c")))).alias("x")
    level = kinds.groupBy(F.col("source").alias("__s")).agg(largest).select("__s", F.col("x.c").alias("__per_word"))
    return goal.join(level, goal["__source"].eqNullSafe(level["__s"]), "left").drop("__s").withColumn("__per_word", F.coalesce("__per_word", F.lit(0.0)))


def ratio(u: Column, size: Column, per_word: Column) -> Column:
    """Random odds over inclusion odds; 0 for what is certain, null for what is never taken."""
    odds = per_word * size
    return F.when(odds >= 1, F.lit(0.0)).when(odds > 0, (u / (1 - u)) / (odds / (1 - odds)))


def limits(rows: DataFrame, weights: tuple[int, ...], most: int, buckets: int) -> DataFrame:
    """The goals of every source of rows(source, who, size, u), and where its sample ends: the bucket
    __cut of the Pareto order and the last key __last taken in it, null if none is.

    The cut is found among bucket sums, and only the bucket that holds it is ordered row by row. Rows of
    one key, which repeat a document, are taken or left together; those that cross the need are taken if
    that comes nearer to it.
    """
    goal = materialize(goals(rows.groupBy("source", "size").agg(F.count("*").alias("n")), weights, most), "goals")
    ranked = rows.join(goal, rows["source"].eqNullSafe(goal["__source"])).withColumn("__ratio", ratio(F.col("u"), F.col("size"), F.col("__per_word")))
    ranked = ranked.where("__need > 0 and __ratio is not null").withColumn("__bucket", bucket(F.col("__ratio"), buckets))
    sums = ranked.groupBy("__source", "__need", "__bucket").agg(F.sum("size").alias("__n"))
    run = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__from", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    cut = sums.where("__from < __need and __from + __n >= __need").select(F.col("__source").alias("__s"), F.col("__bucket").alias("__cut"), "__from")
    inside = ranked.join(cut, ranked["__source"].eqNullSafe(cut["__s"]) & (ranked["__bucket"] == cut["__cut"]))
    peers = inside.groupBy("__source", "__need", "__from", key(F.col("__ratio"), F.col("who"), F.col("size")).alias("__key")).agg(F.sum("size").alias("__n"))
    done = F.col("__from") + F.sum("__n").over(W.partitionBy("__source").orderBy("__key").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = (done <= F.col("__need")) | (done - F.col("__need") < F.col("__need") - (done - F.col("__n")))
    last = peers.withColumn("__near", near).where("__near").groupBy(F.col("__source").alias("__t")).agg(F.max("__key").alias("__last"))
    out = goal.join(cut.drop("__from"), goal["__source"].eqNullSafe(cut["__s"]), "left").drop("__s")
    return out.join(last, out["__source"].eqNullSafe(last["__t"]), "left").drop("__t")


def bucket(ratio: Column, buckets: int) -> Column:
    """Place of a Pareto ratio among equal parts of ratio / (1 + ratio)."""
    return F.least(F.floor(ratio / (1 + ratio) * buckets), F.lit(buckets - 1)).cast("int")


def key(ratio: Column, who: Column, size: Column) -> Column:
    """The Pareto order within a source."""
    return F.struct(ratio.alias("r"), who.alias("w"), size.alias("s"))


def shares(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, buckets: int = BUCKETS, own: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows(source, who, size, u, ...) with source_size, target and copies; own names the columns to keep.
    sizes are the same rows without more columns, written where rows are costly to read. The rows meet one row a source, broadcast while there are at
    most SOURCES of them and joined otherwise."""
    sizes = rows if sizes is None else sizes
    ends = materialize(limits(sizes.select("source", "who", "size", "u"), weights, most, buckets), "mix")
    if ends.count() <= SOURCES:
        ends = F.broadcast(ends)
    joined = rows.join(ends, rows["source"].eqNullSafe(F.col("__source")))
    order = ratio(F.col("u"), F.col("size"), F.col("__per_word"))
    place = bucket(order, buckets)
    more = (F.col("__need") > 0) & ((place < F.col("__cut")) | ((place == F.col("__cut")) & (key(order, F.col("who"), F.col("size")) <= F.col("__last"))))
    copies = F.least(F.col("__whole") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(most)).cast("long")
    return joined.select(*(rows.columns if own is None else own), "source_size", "target", copies.alias("copies"))


def measured(docs: DataFrame, seed: str, *more: str) -> DataFrame:
    """(source, who, size, u, ...) of docs(doc_id, source, text, ...)."""
    who = identity(F.col("doc_id"), F.col("text"))
    held = docs.select(F.col("source").cast("string").alias("source"), who.alias("who"), word_count(F.col("text")).alias("size"), *more)
    return held.withColumn("u", uniform(F.col("who"), seed))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs(doc_id, source, text): doc_id, source, size, source_size, target, copies
    and taken, the words that the mix takes of it.

    Null texts have size 0 and take no words; a null source is a source of its own, last in order. A
    null doc_id stands for the text. Words are counted in one pass, which writes identifiers and sizes;
    all that follows reads those.
    """
    rows = materialize(measured(docs, seed, "doc_id"), "sizes")
    found = shares(rows, weights, most, buckets, ["doc_id", "source", "size"])
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: the columns of docs, whatever their names, each row as often as the mix takes it.

    Texts are read twice, to count their words and to write the copies, and never shuffled.
    """
    rows = measured(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), seed, "__row")
    sizes = materialize(measured(docs, seed), "sizes")
    taken = shares(rows, weights, most, buckets, ["__row"], sizes).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
