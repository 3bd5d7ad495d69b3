"""Code structure: blocks of texts as intervals of lines, and for each line its innermost block.

Texts are (key columns, text, path). Their tokens and lines become rows; nesting is a running sum over a
text's tokens, and lines meet blocks in an equi-join on the nodes of a binary tree over line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import B_RIGHT, JS_SPACE, let, lines, once

# File extensions of languages with braces and with indentation, and openers of indented blocks.
BRACE_FILES = tuple("js jsx mjs cjs ts tsx mts cts java c h cc cpp hpp cs go rs swift kt kts scala php dart zig".split())
INDENT_FILES = tuple("py pyi yaml yml".split())
OPENS_INDENT = f"^[{JS_SPACE}]*(?:async[{JS_SPACE}]+)?(?:def|class|if|for|while|with|try|elif|else|except|finally){B_RIGHT}[^\\n]*:[{JS_SPACE}]*\\z"
OPENS_BRACE = f"\\{{[{JS_SPACE}]*\\z"
LOOKED_AT, LEAST_LINES, LEAST_OPENERS = 400, 10, 3


def _string(mark: str, not_in: str) -> str:
    return f"{mark}(?:\\\\[^\\n]|[^{mark}\\\\{not_in}]|\\\\(?![^\\n]))*+{mark}?+"


# Strings end with their line but for those in backticks; comments; braces; line ends. What repeats is possessive
# or a single character, which Java goes through without recursion.
TOKENS = "|".join([_string('"', "\\n"), _string("'", "\\n"), _string("`", ""), "//[^\\n]*+", "#[^\\n]*+", "/\\*(?s:.*?)\\*/", "/\\*(?s:.*)", "[{}\\n]"])


def language(text: Column, path: Column) -> Column:
    """brace or indent by the path's extension, else by the first lines; null if neither shows."""
    ending = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
    first = F.slice(F.split(text, "\n", LOOKED_AT + 1), 1, LOOKED_AT)
    shows = lambda x, mark, opens: F.size(F.filter(x, lambda y: F.contains(y, F.lit(mark)) & y.rlike(opens)))  # noqa: E731  # few lines have the mark
    counted = let(first, lambda x: F.struct(shows(x, "{", OPENS_BRACE).alias("brace"), shows(x, ":", OPENS_INDENT).alias("indent")))
    shown = let(counted, lambda n: F.when((n.brace >= LEAST_OPENERS) & (n.brace > n.indent), "brace").when(n.indent >= LEAST_OPENERS, "indent"))
    enough = F.size(F.split(text, "\n", LEAST_LINES)) >= LEAST_LINES
    return F.when(ending.isin(*BRACE_FILES), "brace").when(ending.isin(*INDENT_FILES), "indent").when(enough, shown)


def brace_blocks(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, head, first, last, closer) of blocks in braces with lines between; none of a text whose braces
    do not balance or whose last comment is open.

    A brace's depth is a running sum over its text's tokens. At one depth openings and closings alternate,
    so an opening's closing is the next row of its depth.
    """
    tokens = texts.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))).alias("pos", "tok"))
    ends = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    delta = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    is_open = F.startswith("tok", F.lit("/*")) & ~((F.length("tok") >= 4) & F.endswith("tok", F.lit("*/")))
    seen = tokens.select(*key, "pos", ends.alias("ends"), delta.alias("delta"), is_open.alias("open")).where("ends > 0 or delta <> 0 or open")
    so_far = W.partitionBy(*key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*key)
    placed = seen.withColumn("line", F.sum("ends").over(so_far) - F.col("ends")).withColumn("depth", F.sum("delta").over(so_far))
    sound = (F.min("depth").over(whole) >= 0) & (F.sum("delta").over(whole) == 0) & ~F.max("open").over(whole)
    braces = placed.withColumn("sound", sound).where("sound and delta <> 0").withColumn("level", F.when(F.col("delta") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    closed = braces.withColumn("closer", F.lead("line").over(W.partitionBy(*key, "level").orderBy("pos"))).where("delta > 0 and closer > line + 1")
    return closed.select(*key, F.col("line").cast("int").alias("head"), (F.col("line") + 1).cast("int").alias("first"), (F.col("closer") - 1).cast("int").alias("last"), F.col("closer").cast("int").alias("closer"))


def indent_blocks(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, head, first, last, closer), closer null, of indented blocks; blank lines do not end one.

    An opener's block goes up to the next line that is indented no more. Each line stands in the class
    of every opener's indent of its text that it is not beyond (few: each deeper one costs its own width),
    and within a class the next row ends the block.
    """
    width = F.length("line_text") - F.length(F.ltrim("line_text", F.lit(" \t")))
    every = texts.select(*key, F.posexplode(lines(F.col(text))).alias("line", "line_text")).where(F.length(F.trim("line_text", F.lit(" \t\r"))) > 0)
    each = every.select(*key, "line", width.alias("width"), F.col("line_text").rlike(OPENS_INDENT).alias("opens"))
    whole = W.partitionBy(*key)
    each = each.withColumn("before", F.lag("line").over(whole.orderBy("line"))).withColumn("end", F.max("line").over(whole))
    each = each.withColumn("classes", F.collect_set(F.when(F.col("opens"), F.col("width"))).over(whole))
    dealt = each.select(*key, "line", "width", "opens", "before", "end", F.explode(F.filter("classes", lambda c: c >= F.col("width"))).alias("class"))
    last = F.coalesce(F.lead("before").over(W.partitionBy(*key, "class").orderBy("line")), "end")
    found = dealt.withColumn("last", last).where("opens and class = width and last > line")
    return found.select(*key, F.col("line").alias("head"), (F.col("line") + 1).alias("first"), "last", F.lit(None).cast("int").alias("closer"))


def kinds(texts: DataFrame, key: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """(key, text, kind) of texts in languages that have blocks, each looked at once."""
    found = once(texts.select(*key, F.col(text).alias("text"), language(F.col(text), F.col(path)).alias("kind")), "kind")
    return found.where("kind is not null")


def blocks(texts: DataFrame, key: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """(key, head, first, last, closer) of the texts' blocks in their languages."""
    return blocks_of(kinds(texts, key, text, path), key)


def blocks_of(known: DataFrame, key: list[str]) -> DataFrame:
    """blocks of texts whose kinds are known. It goes through them twice."""
    return brace_blocks(known.where("kind = 'brace'"), key).unionByName(indent_blocks(known.where("kind = 'indent'"), key))


def tree_nodes(first: Column, last: Column) -> Column:
    """The fewest nodes (level, node) of a binary tree over whole numbers that make up [first, last]; node n
    of level k holds n * 2^k to (n + 1) * 2^k - 1. Two a level at most."""
    none = F.array().cast("array<struct<level: int, node: int>>")
    start = F.struct(first.cast("int").alias("lo"), (last + 1).cast("int").alias("hi"), none.alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        odd = lambda n: n % 2 == 1
        here = acc.lo < acc.hi
        left = F.when(here & odd(acc.lo), F.array(F.struct(level.alias("level"), acc.lo.alias("node")))).otherwise(none)
        right = F.when(here & odd(acc.hi), F.array(F.struct(level.alias("level"), (acc.hi - 1).alias("node")))).otherwise(none)
        up = F.when(odd(acc.lo), acc.lo + 1).otherwise(acc.lo)
        return F.struct(F.shiftright(up, 1).alias("lo"), F.shiftright(acc.hi, 1).alias("hi"), F.concat(acc.nodes, left, right).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(last + 1))), start, step, lambda acc: acc.nodes)


def innermost(points: DataFrame, intervals: DataFrame, key: list[str], at: str, first: str, last: str, value: str) -> DataFrame:
    """(key, at, value): for every point that some interval of its key holds, the value of the one that
    starts last, and of those the one that ends first.

    An interval is a few tree nodes, and a node keeps its innermost interval alone; a point looks at the
    nodes above it, one a level. So however deep intervals nest, rows grow with the logarithm of their lengths.
    """
    rank = F.struct(F.col(first).alias("first"), (-F.col(last)).alias("ends"), F.col(value).alias("value"))
    held = intervals.select(*key, rank.alias("rank"), F.explode(tree_nodes(F.col(first), F.col(last))).alias("n")).groupBy(*key, "n.level", "n.node").agg(F.max("rank").alias("rank"))
    levels = held.groupBy(*key).agg(F.collect_set("level").alias("levels"))
    asked = points.select(*key, at).join(levels, key).select(*key, at, F.explode("levels").alias("level"))
    met = asked.withColumn("node", F.expr(f"shiftright({at}, level)")).join(held, [*key, "level", "node"])
    return met.groupBy(*key, at).agg(F.max("rank").alias("rank")).select(*key, at, F.col("rank.value").alias(value))


def line_parents(texts: DataFrame, key: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """(key, line, parent) for every line, numbered from 0: the first line of its innermost block, or -1. A
    null text has no lines; (key) must be unique."""
    every = texts.select(*key, F.posexplode(lines(F.col(text))).alias("line", "__x")).drop("__x")
    found = innermost(every, blocks(texts, key, text, path), key, "line", "first", "last", "head")
    return every.join(found, [*key, "line"], "left").select(*key, "line", F.coalesce("head", F.lit(-1)).alias("parent"))
