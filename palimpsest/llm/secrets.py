"""Secret scan with corpus-wide ownership frequency.

Candidates are found in whole texts: assignments, access keys, long hexadecimal strings (the base
kinds) and, besides, bare random-looking tokens. Their values are hashed and the hashes counted by
distinct repository and owner over the whole corpus. A value that few owners and few repositories have
and that looks random is owner-specific, and so live-looking; one that many owners have, or that was
pasted into many repositories, is a widely copied example.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "bare")

BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
BARE_ENTROPY = 3.5
#: A value of more owners or more repositories than these is a widely copied one.
MAX_OWNERS, MAX_REPOSITORIES = 2, 8


def entropy(value: str) -> float:
    """Bits a character of a value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Letters and digits in no simple pattern."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= min(BARE_ENTROPY, 0.75 * math.log2(max(2, len(value))))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, by start and then kind."""
    found: list[tuple[int, int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Bare random-looking tokens that touch no base span."""
    found = [(m.start(), m.end(), 3, m[0]) for m in BARE.finditer(text) if looks_random(m[0])]
    starts, ends = [b[0] for b in base], [b[1] for b in base]
    furthest = list(accumulate(ends, max))  # base spans come by start, and those of several kinds may overlap

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or furthest[before - 1] <= start

    return [x for x in found if free(x[0], x[1])]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


_SPAN = "struct<start: int, end: int, kind: int, value_hash: string, random: boolean>"
_COLUMNS = f"n_assign long, n_access long, n_hex long, base_sha256 string, text_hash string, found array<{_SPAN}>"


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, owner, repository, text) without text and with the counts and spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                base = base_spans(text)
                every = sorted(base + bare_spans(text, base))
                kinds = Counter(b[2] for b in base)
                spans = [
                    {"start": s, "end": e, "kind": k, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)}
                    for s, e, k, v in every
                ]
                digest = hashlib.sha256(written([b[:3] for b in base]).encode()).hexdigest()
                of_text = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if spans else ""
                for column, value in zip(out, (kinds[0], kinds[1], kinds[2], digest, of_text, spans)):
                    column.append(value)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value_hash", pa.string()), ("random", pa.bool_())])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(span))
            kept = [batch.column(c) for c in ("doc_id", "owner", "repository")]
            names = ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "text_hash", "found"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(out, types))], names=names)

    return docs.mapInArrow(run, f"doc_id long, owner string, repository string, {_COLUMNS}")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners) over found(value_hash, owner, repository).

    Distinct pairs come first, with partial aggregation, so a value on every page of a hot source is a
    handful of rows before any task gathers it. A null owner or repository is one more of its kind.
    """
    pairs = found.select("value_hash", "owner", "repository").distinct()
    repositories = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return repositories.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of docs(doc_id, owner, repository, text): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_live (spans of owner-specific live-looking values), n_copied (spans of values
    of more than max_owners owners or max_repositories repositories), and n_owners and n_repositories,
    the most that one of the row's values has.

    spans holds every base span and the bare ones that are live-looking. A null text counts as empty.
    Every row counts in ownership, whatever doc_id or text it shares with others; a repository is one of
    its owner, and rows of equal text get equal spans.
    """
    ready = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("owner").cast("string").alias("owner"),
        F.col("repository").cast("string").alias("repository"), F.col("text").cast("string").alias("text"),
    )
    rows = materialize(candidates(ready), "secrets")
    bearing = rows.where("text_hash <> ''")
    # Owners and repositories of each text first: a text in many rows is exploded once.
    places = bearing.select("text_hash", "owner", "repository").distinct()
    texts = bearing.groupBy("text_hash").agg(F.first("found").alias("found"))
    each = texts.withColumn("s", F.explode("found")).select("text_hash", "s.*")
    counts = ownership(each.select("text_hash", "value_hash").distinct().join(places, "text_hash"))
    judged = each.join(counts, "value_hash").withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))
    live = F.col("random") & ~F.col("copied")
    kept = F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end"))
    summed = judged.groupBy("text_hash").agg(
        F.array_sort(F.collect_list(kept)).alias("kept"), F.count_if(live).alias("n_live"), F.count_if("copied").alias("n_copied"),
        F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform("kept", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    numbers = ("n_live", "n_copied", "n_owners", "n_repositories")
    summed = summed.select("text_hash", F.array_join(one, ",").alias("spans"), *numbers)
    own = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    # Rows without spans, most of a corpus, need no join.
    zero = [F.lit(0).cast("long").alias(c) for c in numbers]
    return bearing.join(summed, "text_hash").select(*own, "spans", *numbers).unionByName(rows.where("text_hash = ''").select(*own, F.lit("").alias("spans"), *zero))
