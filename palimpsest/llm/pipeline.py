"""Corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, mixing, sharding, simhash
from .common import materialize, remove, scan, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages, by the distance of their n-grams from its profile; a
    null lang is filled in. Profiles come from the labelled documents that are not held out. Without a
    label in the table, documents with a letter stay."""
    training = docs.where(~language_id.held_out(F.col("doc_id")))
    return language_id.accepted(docs, language_id.learn(training))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest doc_id: shingles of five
    words, a similarity of 0.8 or more. Different texts of one doc_id, or of none, are documents of their
    own; of rows that repeat a doc_id and its text one stays."""
    found = simhash.similar_texts(docs, 0.8, 5).where("stays")
    stays = found.groupBy(F.col("doc_id").alias("__d"), F.col("t1").alias("__1"), F.col("t2").alias("__2")).agg((F.count("*") > 1).alias("__often"))
    stays = materialize(stays, "stays")
    t1, t2 = simhash.text_hashes(F.col("text"))
    same = (t1 == F.col("__1")) & (t2 == F.col("__2")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__d"))
    once, often = stays.where("not __often"), stays.where("__often")
    kept = docs.join(once, same, "left_semi")
    if often.isEmpty():
        return kept
    # Only documents listed more than once need their rows counted: one of each stays.
    rows = docs.join(often, same).groupBy("__d", "__1", "__2").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return kept.unionByName(rows.select("__row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, nor an edited copy of one. Null and empty texts hold none and stay;
    each row is judged by itself, so rows that repeat stay or go together; without items all rows stay."""
    return decontaminate.clean(docs, scan(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a document is repeated as often as the mix takes it. A null source is one
    more source; texts without a word, null ones among them, are never taken; documents of equal odds and
    number, such as repeated rows, come in or stay out together; no documents give no rows."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, law, shard, slot and grown_shard, which replace columns of these
    names. A null doc_id is one more key, and a null text of one byte; repeated rows share a shard and get
    neighbouring slots; no rows give none."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("mix_to_weights", mixed),
    ("shard", sharded),
]

#: The first three stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = scan(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
