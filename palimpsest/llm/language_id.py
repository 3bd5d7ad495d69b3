"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent character n-grams in order of frequency. A document's own
profile is compared with each by the out-of-place distance: how far every n-gram stands from its
place in the language's order, or the worst distance where it is not there at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROFILE = 400
UNKNOWN = "und"
#: A text that scores less is in none of the languages: its n-grams are mostly absent from every profile.
LEAST_SCORE = 0.3
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: 0 unless a letter, else its lower-case form where that is one letter."""
    if not _LETTER:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of 1 to 3 characters in a text, words bounded by one blank.

    A code holds three code points of 21 bits, the first highest; n-grams never span two words and the
    lone blank is none. Both arrays are empty if the text has no letter.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points] if points.size else np.zeros(0, np.int64)
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate([[0], letters, [0]])
    keep = np.ones(x.size, bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)  # a run of other characters is one blank
    x = np.where(x[keep] == 0, 32, x[keep])
    a, b, c = x, np.append(x[1:], 32), np.append(x[2:], [32, 32])
    third = np.where(b == 32, 0, c)  # an n-gram ends at the blank behind a word
    codes = np.sort((a << 42) | (b << 21) | third)
    found, counts = [], []
    for shift in (0, 21, 42):
        code = codes >> shift << shift
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        kind = code[starts]
        n = np.diff(np.append(starts, code.size))
        if shift == 0:
            live = (kind & 0x1FFFFF) != 0
        elif shift == 21:
            live = ((kind >> 42) != 32) | ((kind >> 21 & 0x1FFFFF) != 32)
        else:
            live = (kind >> 42) != 32
        found.append(kind[live])
        counts.append(n[live])
    return np.concatenate(found), np.concatenate(counts)


def ranks(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes and their places from 0; codes of one count share the middle place, and
    ties at the end of the profile go to smaller codes."""
    if codes.size > 4 * size:
        part = counts >= np.partition(counts, codes.size - size)[codes.size - size]
        codes, counts = codes[part], counts[part]
    order = np.lexsort((codes, -counts))[:size]
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))
    ends = np.append(starts[1:], counts.size)
    place = np.repeat((starts + ends - 1) / 2.0, ends - starts)
    return codes, place


class Profiles:
    """Profiles of all languages, ready to be compared with a document at once."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.place = np.full((len(self.langs), self.codes.size + 1), -1.0)
        for k, lang in enumerate(self.langs):
            own = [(code, n) for at, code, n in rows if at == lang]
            code, place = ranks(np.array([c for c, _ in own], np.int64), np.array([n for _, n in own], np.int64), size)
            self.place[k, np.searchsorted(self.codes, code)] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not codes.size or not self.langs:
            return UNKNOWN, 0.0
        codes, place = ranks(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, codes), self.codes.size - 1)
        at = np.where(self.codes[at] == codes, at, self.codes.size)
        theirs = self.place[:, at]
        apart = np.where(theirs < 0, float(self.size), np.abs(theirs - place[None, :]))
        distance = apart.mean(axis=1) / self.size
        best = int(np.argmin(distance))  # of languages as near the first by name
        return self.langs[best], float(min(1.0, max(0.0, 1.0 - distance[best])))


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text leaves 2 when divided by 4; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from all rows of labelled(text, lang); rows without lang or letters teach nothing.

    Tasks add up their own counts first. What reaches the driver is `size` rows a language tag.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            code, n = merge(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * code.size, pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                code, n = ngrams(text.as_py())
                if code.size:
                    own = held.setdefault(lang, [])
                    own.append((code, n))
                    if len(own) >= 256:
                        held[lang] = [merge(own)]
                if len(held) > 1000:
                    yield from [emit(k) for k in list(held)]
        yield from [emit(k) for k in list(held)]

    ready = labelled.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = ready.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    top = sums.withColumn("place", place).where(F.col("place") <= size)
    return Profiles([(r.lang, r.code, r.n) for r in top.select("lang", "code", "n").collect()], size)


def accepted(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, wanted: frozenset[str] | None = None) -> DataFrame:
    """The rows of docs(text, lang, ...) whose text is of a wanted language, by default of any that has a
    profile, with all their columns; a null lang becomes the language found.

    The out-of-place distance decides: a row goes where even the nearest profile is so far that its
    score is below `least`, or where that language is not wanted. So do texts that are null or without a
    letter. Without any profile nothing can be told apart, and every text with a letter stays as it is.
    """
    at = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if profiles.langs:
                found = [profiles.predict(t.as_py()) for t in batch.column("text")]
                keep = [lang != UNKNOWN and score >= least and (wanted is None or lang in wanted) for lang, score in found]
                named = [own if own is not None else lang for own, (lang, _) in zip(batch.column("lang").to_pylist(), found)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(named, batch.schema.field(at).type))
            else:
                keep = [ngrams(t.as_py())[0].size > 0 for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(place, np.concatenate([p[1] for p in parts]), code.size).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (replacing such columns): und and 0 where the text is null or has
    no letter, else the language of least distance and 1 less that distance as a share of the worst."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(run, f"{schema}, lang_pred string, score double")
