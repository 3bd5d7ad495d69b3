"""Text comparison measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

# What counts as an entity of each kind, and as a verb of action.
ENTITIES = {
    "names": "[A-Z][a-z]+(?: [A-Z][a-z]+)+", "numbers": "[0-9]+(?:\\.[0-9]+)?%?", "paths": "/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+",
    "urls": "https?://[^ \\t\\n\\r]+", "dotted": "[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+",
}
ACTIONS = "(?i)(?<![a-z])(?:add|create|delete|fix|implement|install|remove|run|update|use)(?:d|s|ing)?(?![a-z])"


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[ \\t\\n\\r]+", -1), lambda x: F.length(x) > 0)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of an array of tokens, which is worked out once."""

    def of(t: Column) -> Column:
        count = F.size(t) - n + 1
        some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(count >= 1, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def overlap(original: Column, kept: Column, n: int = 1) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of distinct n-grams; 0 where undefined."""
    a, b = ngrams(words(original), n), ngrams(words(kept), n)
    both = F.size(F.array_intersect(a, b))
    p = F.when(F.size(b) > 0, both / F.size(b)).otherwise(0.0)
    r = F.when(F.size(a) > 0, both / F.size(a)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def char_trigrams(c: Column) -> Column:
    """Distinct runs of three characters, by places in an array of them: a place in a string is a walk."""

    def of(t: Column) -> Column:
        at = lambda i, k: F.element_at(t, i + k)
        count = F.size(t) - 2
        some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(at(i, 0), at(i, 1), at(i, 2)))
        return F.when(count >= 1, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), of)


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = char_trigrams(a), char_trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def entities(c: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITIES[kind]), F.lit(0)))


def entity_recall(original: Column, kept: Column) -> Column:
    """Share of the original's distinct entities of all kinds that the kept text has; 1 without any."""
    total, found = F.lit(0), F.lit(0)
    for kind in ENTITIES:
        a = entities(original, kind)
        total, found = total + F.size(a), found + F.size(F.array_intersect(a, entities(kept, kind)))
    return F.when(total == 0, 1.0).otherwise(found / total)


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "[.!?]+", -1), lambda x: x.rlike("[^ \\t\\n\\r]"))).cast("long")


def action_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ACTIONS)).cast("long")


@F.pandas_udf(T.DoubleType())
def char_entropy(text: pd.Series) -> pd.Series:
    """Bits a character of each text's own distribution."""
    import math
    from collections import Counter

    def one(t: str) -> float:
        return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) + 0.0 if t else 0.0

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def lcs_ratio(original: pd.Series, kept: pd.Series) -> pd.Series:
    """Longest common subsequence of tokens over the original's tokens; 1 for an empty original. Rows of
    the table are bit vectors (Hyyro, 2004), so a pair costs tokens times words of bits."""

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        if not x:
            return 1.0
        places: dict[str, int] = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for t in y:
            u = v & places.get(t, 0)
            v = ((v + u) | (v - u)) & full
        return (len(x) - v.bit_count()) / len(x)

    return pd.Series([one(a, b) for a, b in zip(original, kept)])
