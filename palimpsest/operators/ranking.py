"""Line ranking: tokens, BM25 as aggregations and joins, rerank, and evaluation of rankings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..functions.text import B_LEFT, JS_SPACE, let
from ..workdir import materialize
from . import postings as P

K1, B = 1.5, 0.75
BLOCKS_AN_OCTAVE = 1
DEFINITION_BOOST, COMMENT_PENALTY, COHERENCE = 1.6, 0.6, 0.25
# An underscore or a change of case, told by the character that few words have. \w and \p{Alnum} are ASCII in Java, and
# a table there, where a class of ranges is several calls a character.
SEVERAL = "[A-Z_](?:(?<=_|[a-z0-9][A-Z])|(?<=[A-Z]{2})(?=[a-z]))"
# What a line that defines a name, and one that is a comment, look like.
DEFINES = (
    f"{B_LEFT}(?:export\\s+(?:default\\s+)?)?(?:async\\s+)?(?:function|class|def|const|let|var|type|interface|enum|struct|impl|trait|fn|func|module|namespace)\\s+"
    "([A-Za-z_$][A-Za-z0-9_$]*)"
)
COMMENT = f"^[{JS_SPACE}]*(?://|#|\\*|/\\*|--|<!--|;)"


def tokens(c: Column) -> Column:
    """Lower-case tokens of two or more characters: words joined over . _ and -, and the camel-case and
    underscore parts of those that have several."""
    # Words are taken out, not split apart: Java tests a negated class several times as slowly.
    words = lambda x, least: F.regexp_extract_all(x, F.lit(f"\\w{{{least},}}"), F.lit(0))
    # Only words with an underscore or a change of case have parts; most texts have few of them.
    of = lambda word: F.when(word.rlike(SEVERAL), F.concat(F.array(F.lower(word)), _parts(word))).otherwise(F.array(F.lower(word)))
    whole = lambda x: F.filter(F.flatten(F.transform(words(x, 1), of)), lambda w: F.length(w) >= 2)
    # A text none of whose words have parts, as most lines are, is not gone through word by word.
    every = let(_joined(c), lambda x: F.when(x.rlike(SEVERAL), whole(x)).otherwise(F.transform(words(x, 2), F.lower)))
    return F.coalesce(every, F.array().cast("array<string>"))


def _joined(c: Column) -> Column:
    """c with words that . _ and - stand between joined by an underscore."""
    joint = "(\\p{Alnum})[._\\-]+(\\p{Alnum})"
    once = F.regexp_replace(F.regexp_replace(c, joint, "$1_$2"), joint, "$1_$2")
    return F.when(F.contains(c, F.lit(".")) | F.contains(c, F.lit("_")) | F.contains(c, F.lit("-")), once).otherwise(c)


def _parts(word: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.split(F.lower(spaced), "[ _]+", -1)


def _token_count(c: Column) -> Column:
    """size(tokens(c)), with only the words taken out that have a capital or an underscore: no others have parts."""
    marked = lambda x: F.regexp_extract_all(x, F.lit("(?<!\\w)[a-z0-9]*+[A-Z_]\\w*+"), F.lit(0))
    parts = lambda word: F.when(word.rlike(SEVERAL), F.size(F.filter(_parts(word), lambda w: F.length(w) >= 2))).otherwise(0)
    may = lambda x: ((x != F.lower(x)) | F.contains(x, F.lit("_"))) & x.rlike(SEVERAL)
    more = lambda x: F.when(may(x), F.aggregate(marked(x), F.lit(0), lambda a, word: a + parts(word))).otherwise(0)
    return let(_joined(c), lambda x: F.regexp_count(x, F.lit("\\w{2,}")) + more(x))


def bm25(docs: DataFrame, queries: DataFrame, target: str, line: str, text: str, query_id: str | None, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(target, query_id, line, score) of all lines that hold a term of a query.

    docs has a row for each line of a target; every line counts in N and the mean length. Only terms of
    queries are counted: tokens meet the distinct query terms before the frequencies are aggregated.
    Without a query_id every target has a query of its own, in a row (target, query), and no other's.
    """
    if query_id is not None and (held := _held(docs, queries, target, line, text, query_id, query)):
        counts, of, by = held
        return P.scored(counts, target, line, queries.schema[query_id], of, by, k1, b).select(target, query_id, line, "score")
    own = [target] if query_id is None else []
    named = own or [query_id]
    terms = query_terms(queries, named, query)
    weighed = impacts(docs, terms.select(*own, "term").distinct(), target, line, text, k1, b).join(terms, [*own, "term"])
    return weighed.groupBy(*dict.fromkeys([target, *named, line])).agg(F.sum("part").alias("score"))


def bm25_head(docs: DataFrame, queries: DataFrame, target: str, line: str, text: str, query_id: str, query: str, cut: Callable[[int], P.Cut], digits: int = 6, marks: DataFrame | None = None, cost: str | None = None, gold: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(target, query_id, line, score) of bm25, scores rounded, without pairs that a cut of postings tells not to
    be in the head of their query's ranking. marks(line, cost, gold) gives lines what is named, and leaves out
    lines that it does not have; with gold there is rest: see postings.scored. With several targets nothing is cut.
    """
    more = [c for c in (cost, gold) if c is not None]
    if held := _held(docs, queries, target, line, text, query_id, query):
        counts, of, by = held
        counts = counts if marks is None else counts.join(marks.select(line, *more), line)
        pairs = P.scored(counts, target, line, queries.schema[query_id], of, by, k1, b, cut if len(of.targets) == 1 else None, cost, gold)
    else:
        pairs = bm25(docs, queries, target, line, text, query_id, query, k1, b)
        pairs = pairs if marks is None else pairs.join(marks.select(line, *more), line)
        pairs = pairs if gold is None else pairs.withColumn("rest", F.lit(None).cast("long"))
    return pairs.select(target, query_id, line, F.round("score", digits).alias("score"), *more, *(["rest"] if gold is not None else []))


def _held(docs: DataFrame, queries: DataFrame, target: str, line: str, text: str, query_id: str, query: str) -> tuple[DataFrame, P.Stats, P.Asked] | None:
    """The lines' counts of asked terms, written once, with what scores them within a task. None where the
    queries' terms, or the numbers of all targets, are too many to hold there, or where a line is in several rows."""
    by = P.asked(query_terms(queries, [query_id], query).select(query_id, "term"))
    if by is None:
        return None
    counts = materialize(P.counted(docs, target, line, tokens(F.col(text)), by.terms), "counts")
    of = P.stats(counts, target, len(by.terms))
    if of is None or not counts.groupBy(target, line).count().where("count > 1").isEmpty():
        return None
    return counts, of, by


def query_terms(queries: DataFrame, named: list[str], query: str) -> DataFrame:
    """(named, term): the distinct terms of each query."""
    return queries.select(*named, F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))


def impacts(docs: DataFrame, wanted: DataFrame, target: str, line: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(target, line, dl, term, part): what each wanted term, (term) or (target, term), adds to the score of a
    line of dl tokens."""
    toked = docs.select(target, line, tokens(F.col(text)).alias("toks"))
    toked = toked.withColumn("dl", F.size("toks"))
    sizes = toked.groupBy(target).agg(F.count("*").alias("n_lines"), F.avg("dl").alias("avgdl"))
    # The outer form, as the inner one makes the scan below filter by the tokens and so find them twice.
    each = toked.select(target, line, "dl", F.explode_outer("toks").alias("term")).where("term is not null")
    tf = each.join(wanted, wanted.columns, "left_semi").groupBy(target, line, "dl", "term").agg(F.count("*").alias("f"))
    # Counting by f keeps both readers of tf on one exchange.
    df = tf.groupBy(target, "term").agg(F.count_if(F.col("f") > 0).alias("df"))
    scored = tf.join(df, [target, "term"]).join(sizes, target)
    idf = F.log(1 + (F.col("n_lines") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * (F.col("dl") / F.col("avgdl")))))
    return scored.select(target, line, "dl", "term", part.alias("part"))


def bm25_top(docs: DataFrame, queries: DataFrame, target: str, line: str, text: str, query_id: str, query: str, k: int = 10, digits: int = 6, k1: float = K1, b: float = B) -> DataFrame:
    """(target, query_id, line, score): the k lines of each target and query with the highest scores, equal
    ones by line, without scoring every line that shares a term.

    Scores are rounded to `digits`, so the order of sums cannot change ranks. The heads of the postings, the
    k strongest lines of each term, are scored first: the k-th score of a query among them is its bar.
    Postings stand in blocks of lines of about one length, whose strongest impact is known: impacts fall
    with length, so a block's bound is close. In each block, a query's weakest terms that together stay
    below its bar bring no line in by themselves: only the postings of its other terms are gathered, and of
    those lines only the ones that reach the bar with the weak terms at their strongest are looked up in
    the weak terms' postings. It pays where queries hold rare terms; where all terms are about as strong,
    bounds are loose and bm25 with a rank is faster. A null or empty query has no lines, a null text no terms.
    Where the bounds are few enough to be held, tasks go by them line by line and no postings are exchanged.
    """
    slack, place = 10.0**-digits, [target, query_id]
    terms = query_terms(queries, [query_id], query)
    block = F.floor(F.log2("dl") * BLOCKS_AN_OCTAVE).cast("int")
    if held := _held(docs, queries, target, line, text, query_id, query):
        counts, of, by = held
        if P.bounded(of, by):
            return _top_within(counts, target, line, queries.schema[query_id], of, by, k, digits, k1, b)
        parts = P.weighed(counts, target, line, of, by.terms, k1, b)
    else:
        parts = impacts(docs, terms.select("term").distinct(), target, line, text, k1, b)
    postings = materialize(parts.withColumn("block", block).drop("dl"), "postings")
    best = lambda by, score: F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), line))
    heads = postings.withColumn("__r", best([target, "term"], "part")).where(F.col("__r") <= k)
    seeds = heads.join(terms, "term").select(*place, line).distinct()
    first = seeds.join(terms, query_id).join(postings, [target, "term", line]).groupBy(*place, line).agg(F.sum("part").alias("score"))
    first = first.withColumn("__r", best(place, "score")).where(F.col("__r") <= k)
    bars = first.groupBy(*place).agg(F.when(F.count("*") >= k, F.min("score") - slack).otherwise(0.0).alias("bar"))
    strong = postings.groupBy(target, "term", "block").agg(F.max("part").alias("most")).join(terms, "term").join(bars, place)
    inside = W.partitionBy(*place, "block")
    summed = F.sum("most").over(inside.orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = strong.withColumn("leads", summed >= F.col("bar"))
    rest = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("most"))).over(inside), F.lit(0.0))
    plan = materialize(ranked.withColumn("rest", rest).drop("most"), "terms")  # a row a query, term and block
    gathered = postings.join(plan.where("leads").drop("leads"), [target, "term", "block"])
    gathered = gathered.groupBy(*place, line).agg(F.sum("part").alias("part"), F.max("bar").alias("bar"), F.max("rest").alias("rest"))
    hopeful = materialize(gathered.where(F.col("part") + F.col("rest") >= F.col("bar")).select(*place, line, "part"), "hopeful")
    # From the postings' side, so this is never more than all postings of the weak terms, however many lines are left.
    weak = postings.join(plan.where(~F.col("leads")).select(*place, "term", "block"), [target, "term", "block"]).select(*place, line, "part")
    weak = weak.join(hopeful.drop("part"), [*place, line], "left_semi")
    whole = hopeful.unionByName(weak).groupBy(*place, line).agg(F.round(F.sum("part"), digits).alias("score"))
    return whole.withColumn("__r", best(place, "score")).where(F.col("__r") <= k).drop("__r")


def _top_within(counts: DataFrame, target: str, line: str, query_id: StructField, of: P.Stats, by: P.Asked, k: int, digits: int, k1: float, b: float) -> DataFrame:
    """bm25_top of counted rows. The strongest lines, the bars and the bounds are few numbers; with them each
    task goes through its own lines."""
    slack, width, place = 10.0**-digits, len(by.terms), [target, query_id.name]
    best = lambda by, score: F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), line))
    found = materialize(P.strongest(counts, target, line, of, width, k1, b, k), "strongest")
    heads = found.where("block is null").withColumn("__r", best([target, "term"], "part")).where(F.col("__r") <= k)
    seeds = materialize(heads.select(F.col(target).alias("__t"), F.col(line).alias("__l")).distinct(), "seeds")
    first = counts.join(seeds, (F.col(target) == F.col("__t")) & F.col(line).eqNullSafe(F.col("__l")), "left_semi")
    first = P.scored(first, target, line, query_id, of, by, k1, b, P.best(k, slack) if len(of.targets) == 1 else None)
    first = first.withColumn("__r", best(place, "score")).where(F.col("__r") <= k)
    targets, items = {v: n for n, v in enumerate(of.targets)}, {v: n for n, v in enumerate(by.ids)}
    bars = np.zeros((len(targets), len(items)))
    for r in first.groupBy(*place).agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") >= k).collect():  # a row a target and query at most
        bars[targets[r[0]], items[r[1]]] = r[2] - slack
    most = np.zeros((len(targets), P.BLOCKS, width))
    for r in found.where("block is not null").groupBy(target, "block", "term").agg(F.max("part")).collect():  # no more than MOST_STATS
        most[targets[r[0]], r[1], r[2]] = r[3]
    lead, rest = P.leads(most, bars, by)
    pairs = materialize(P.hopeful(counts, target, line, query_id, of, by, lead, rest, bars, k1, b), "hopeful")
    ranked = pairs.select(*place, line, F.round("score", digits).alias("score"))
    return ranked.withColumn("__r", best(place, "score")).where(F.col("__r") <= k).drop("__r")


def rerank(lines: DataFrame, target: str, line: str, text: str, score: str, query_terms: Column) -> DataFrame:
    """lines (all lines of each target, score 0 where none) with reranked: definitions of query terms
    count more, comments less, and neighbours lift a line by a quarter where there are three lines."""
    name = F.regexp_extract(text, DEFINES, 1)
    defines = (F.length(name) > 0) & F.arrays_overlap(tokens(name), query_terms)
    s = F.col(score) * F.when(defines, DEFINITION_BOOST).otherwise(1.0) * F.when(F.col(text).rlike(COMMENT), COMMENT_PENALTY).otherwise(1.0)
    w = W.partitionBy(target).orderBy(line)
    count = F.count("*").over(W.partitionBy(target))
    own = lines.withColumn("__s", s)
    lift = COHERENCE * F.greatest(F.lag("__s", 1, 0.0).over(w), F.lead("__s", 1, 0.0).over(w))
    return own.withColumn("reranked", F.when(count >= 3, F.col("__s") + lift).otherwise(F.col("__s"))).drop("__s")


def line_scores(lines: str, terms: str, k1: float = K1, b: float = B) -> Column:
    """The BM25 scores of one text's lines (an array column, no line with a line end) for its own distinct terms (an
    array column), as bm25 gives them without a query_id, 0 where a line holds none: an array, worked out within the row.

    Terms that the text does not show are left out first, and only lines that show one are tokenised; the
    tokens of the others are counted all at once."""

    def looked(text: Column, asked: Column) -> Column:
        low = F.lower(_joined(text))
        return let(low, lambda y: F.struct(F.split(y, "\n", -1).alias("lines"), F.filter(asked, lambda t: F.rlike(y, t)).alias("terms")))

    def counted(low: Column, asked: Column) -> Column:
        hits = lambda toks: F.filter(toks, lambda w: F.array_contains(asked, w))
        held = lambda x: let(tokens(x), lambda toks: F.struct(F.size(toks).alias("dl"), hits(toks).alias("hits")))
        return F.transform(lines, lambda x, i: F.when(F.exists(asked, lambda t: F.contains(F.get(low, i), t)), held(x)))

    def scored(rows: Column, asked: Column) -> Column:
        n, some = F.size(rows), F.filter(rows, lambda r: F.size(r.hits) > 0)
        others = F.array_join(F.filter(lines, lambda x, i: F.get(rows, i).isNull()), "\n")
        total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r.dl, F.lit(0))) + let(others, _token_count)
        df = lambda s, t: F.size(F.filter(s, lambda r: F.array_contains(r.hits, t)))
        idf = let(some, lambda s: F.transform(asked, lambda t: F.struct(t.alias("term"), let(df(s, t), lambda d: F.log(1 + (n - d + 0.5) / (d + 0.5))).alias("idf"))))
        return let(F.struct(idf.alias("terms"), F.try_divide(total, n).alias("avgdl")), lambda g: F.transform(rows, lambda r: F.when(F.size(r.hits) > 0, summed(g, r)).otherwise(0.0)))

    def summed(g: Column, r: Column) -> Column:
        base = k1 * (1 - b + b * (r.dl / g.avgdl))
        part = lambda t: let(F.size(F.filter(r.hits, lambda w: w == t.term)), lambda f: F.when(f > 0, t.idf * (f * (k1 + 1) / (f + base))).otherwise(0.0))
        return F.aggregate(g.terms, F.lit(0.0), lambda a, t: a + part(t))

    seen = lambda asked: let(F.array_join(lines, "\n", ""), lambda text: looked(text, asked))
    return let(F.col(terms), lambda asked: let(seen(asked), lambda w: let(counted(w.lines, w.terms), lambda rows: scored(rows, w.terms))))


def reranked_lines(lines: str, scores: str, terms: str) -> Column:
    """rerank of one text's lines and scores (array columns) for its terms, worked out within the row. A score
    of 0 stays one whatever the line is, so most lines are not looked at."""

    def own(x: Column, s: Column, asked: Column) -> Column:
        name = F.regexp_extract(x, DEFINES, 1)
        defines = (F.length(name) > 0) & F.arrays_overlap(tokens(name), asked)
        return F.when(s > 0, s * F.when(defines, DEFINITION_BOOST).otherwise(1.0) * F.when(x.rlike(COMMENT), COMMENT_PENALTY).otherwise(1.0)).otherwise(0.0)

    def lifted(every: Column) -> Column:
        near = lambda i: F.coalesce(F.get(every, i), F.lit(0.0))
        return F.when(F.size(every) >= 3, F.transform(every, lambda s, i: s + COHERENCE * F.greatest(near(i - 1), near(i + 1)))).otherwise(every)

    return let(F.col(terms), lambda asked: let(F.zip_with(lines, scores, lambda x, s: own(x, s, asked)), lifted))


def _listed(ranked: DataFrame, gold: str, rest: str | None) -> tuple[DataFrame, Column]:
    """The rows that are ranked, and the number of gold ones: a row with `rest` stands for so many that are not listed."""
    if rest is None:
        return ranked, F.count_if(gold)
    return ranked.where(F.col(rest).isNull()), F.count_if(gold) + F.coalesce(F.sum(rest), F.lit(0).cast("long"))


def ndcg(ranked: DataFrame, group: str, score: str, position: str, gold: str, k: int = 10, rest: str | None = None) -> DataFrame:
    """(group, ndcg): gain 1 for gold rows by score falling and position rising, over the ideal's. Only the
    k first rows of a group are ranked, and each task cuts its own rows to k before they are exchanged.
    Rows with a number in rest stand for so many gold rows below the k first."""
    listed, golds = _listed(ranked, gold, rest)
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), F.col(position)))
    top = listed.select(group, score, position, gold).withColumn("__r", place).where(F.col("__r") <= k)
    gains = top.groupBy(group).agg(F.sum(F.when(F.col(gold), 1 / F.log2(F.col("__r") + 1)).otherwise(0.0)).alias("dcg"))
    counts = ranked.groupBy(group).agg(F.least(golds, F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    return counts.join(gains, group).select(group, F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def recall_within(ranked: DataFrame, group: str, score: str, position: str, cost: str, gold: str, budget: int, rest: str | None = None) -> DataFrame:
    """(group, recall): share of gold rows among the head of the ranking whose costs sum to the budget.
    Costs are at least 1, so no more than `budget` rows of a group can fit, and only those are ranked. Rows
    with a number in rest stand for so many gold rows that do not fit."""
    listed, golds = _listed(ranked, gold, rest)
    order = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(position))
    head = listed.select(group, score, position, cost, gold).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= budget)
    spent = F.sum(cost).over(W.partitionBy(group).orderBy("__r").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = head.withColumn("__in", spent <= budget).groupBy(group).agg(F.count_if(F.col(gold) & F.col("__in")).alias("__k"))
    counts = ranked.groupBy(group).agg(golds.alias("__n"))
    return counts.join(found, group).select(group, F.coalesce(F.try_divide(F.col("__k"), F.col("__n")), F.lit(0.0)).alias("recall"))
