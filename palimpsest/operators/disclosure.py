"""Summaries of very large texts that can be expanded again, and their expansion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import size_label, utf8_head, utf8_tail

LEAST_BYTES, HEAD_BYTES, TAIL_BYTES = 32768, 2048, 1024
TAG = "fold-ref:v1"
REFERENCE = f"<{TAG}:([a-f0-9]{{64}}):([0-9]+)>"


def _ends(head: int, tail: int):
    @F.pandas_udf("struct<head: string, tail: string>")
    def run(text: pd.Series) -> pd.DataFrame:
        data = [(t or "").encode() for t in text]
        return pd.DataFrame({"head": [utf8_head(d, head).decode() for d in data], "tail": [utf8_tail(d, tail).decode() for d in data]})

    return run


def summarize(df: DataFrame, text: str = "text", least: int = LEAST_BYTES, head: int = HEAD_BYTES, tail: int = TAIL_BYTES, label: Callable[[Column], Column] = size_label) -> DataFrame:
    """Rows of df with at least `least` bytes, with hash, original_bytes, summary and summary_bytes; label
    says how sizes are put."""
    size = F.octet_length(text).cast("long")
    held = df.where(size >= least).withColumn("hash", F.sha2(F.col(text), 256)).withColumn("original_bytes", size)
    held = held.withColumn("__ends", _ends(head, tail)(F.col(text)))
    omitted = F.greatest(F.lit(0).cast("long"), F.col("original_bytes") - F.octet_length("__ends.head") - F.octet_length("__ends.tail"))
    mark = F.concat(F.lit(f"<{TAG}:"), F.col("hash"), F.lit(":"), F.col("original_bytes").cast("string"), F.lit(">"))
    line = F.concat(F.lit("[folded v1] "), label(F.col("original_bytes")), F.lit(", sha256:"), F.substring("hash", 1, 12), F.lit("... - quote "), mark, F.lit(" to expand"))
    body = F.concat(line, F.lit("\n"), F.col("__ends.head"), F.lit("\n[... "), label(omitted), F.lit(" omitted ...]\n"), F.col("__ends.tail"), F.lit("\n"), mark)
    return held.withColumn("summary", body).withColumn("summary_bytes", F.octet_length("summary").cast("long")).drop("__ends")


def references(text: Column) -> Column:
    """Hashes that a text refers to, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))


@F.pandas_udf(T.StringType())
def _expand(text: pd.Series, bodies: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, bodies):
        whole = t
        for b in found if found is not None else ():
            if t is None or f"<{TAG}:{b['hash']} expanded -" in t:
                continue
            data = b["body"]
            whole = whole.replace(f"<{TAG}:{b['hash']}:{len(data.encode())}>", f"<{TAG}:{b['hash']} expanded - {len(data.encode())} bytes follow>\n{data}\n</{TAG} expanded>")
        out.append(whole)
    return pd.Series(out)


def rehydrate(df: DataFrame, store: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, expanded, rehydrated, missed): references in df(key, text) replaced by the texts of
    store(hash, text). A reference already expanded in the same text stays; key must be unique."""
    refs = df.withColumn("hash", F.explode(references(F.col(text)))).select(key, "hash")
    hits = held(refs, store)
    found = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("hash", "body")))).alias("bodies"),
        F.count("body").alias("rehydrated"), F.count_if(F.col("body").isNull()).alias("missed"),
    )
    joined = df.join(found, key, "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        key, F.when(F.size("bodies") > 0, _expand(F.col(text), F.col("bodies"))).otherwise(F.col(text)).alias("expanded"),
        F.coalesce("rehydrated", zero).alias("rehydrated"), F.coalesce("missed", zero).alias("missed"),
    )


def save_store(entries: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """entries(hash, text, ...) as a table of that name, dealt into buckets by hash and sorted within each,
    replacing one of that name. Look-ups in it move the hashes asked for and never the texts held: see
    rehydrate. More buckets suit larger stores; a bucket should be some hundred MB."""
    entries.repartition(buckets, "hash").write.format("parquet").bucketBy(buckets, "hash").sortBy("hash").mode("overwrite").saveAsTable(table)
    return entries.sparkSession.table(table)


def held(references: DataFrame, store: DataFrame) -> DataFrame:
    """references(hash, ...) with body, the text of store(hash, text) or null. Where the store is a table of
    save_store only the references are exchanged, into its buckets."""
    return references.hint("shuffle_merge").join(store.select("hash", F.col("text").alias("body")).hint("shuffle_merge"), "hash", "left")
