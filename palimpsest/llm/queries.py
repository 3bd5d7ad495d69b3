"""The opN queries over the whole tables, their SQL, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, exact_dedup, html_text, language_id, mixing, periodic_runs, secrets, sharding, simhash, suffix_dedup, url_filter
from . import pipeline as stages
from ..functions.text import let
from .common import scan

# The rules of op8.
BLOCK = ["com/en/", "example.net/de/8", "org/es/"]
ALLOW = ["example.com/en/7", "net/de/"]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: the documents of one language within it."""
    docs = scan(spark, sf_dir, "documents")
    repository = F.concat_ws("/", "source", "lang")
    return secrets.scan_secrets(docs.select("doc_id", F.col("source").alias("owner"), repository.alias("repository"), "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs.select("doc_id", "text")).drop("spans")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, scan(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(scan(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn(docs.where(~out).select("text", "lang"))
    named = language_id.identify(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(scan(spark, sf_dir, "pages").select("page_id", "url"), BLOCK, ALLOW)


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(scan(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(scan(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    words = byte_bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = byte_bpe.encode(docs, words).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"
    )
    return byte_bpe.decode(coded, words).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(scan(spark, sf_dir, "documents").select("lang", "source", "text"))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten (by its doc_id) its words with the end said over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def said(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = F.when(n > 0, g % n).otherwise(0)
        plan = F.struct(start.alias("a"), (1 + F.floor((n - start) / (3 + g % 8))).alias("p"))
        return let(plan, lambda at: F.array_join(F.transform(words, lambda w, i: F.when(i < at.a, w).otherwise(F.get(words, (at.a + (i - at.a) % at.p).cast("int")))), " "))

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), said)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.collapse(docs)
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_jump_shards": op9_jump_shards,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_pareto_mix": """
WITH i AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS who FROM documents),
d AS (SELECT *, (('0x' || substr(md5('mix:' || who), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM i),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS open
  FROM c WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, cap, w, (min(CASE WHEN rest / open * w <= cap THEN {'room': cap / w, 'level': rest / open} END) OVER ()).level AS level FROM l),
g AS (
  SELECT source, source_size, round(least(coalesce(level * w, cap::DOUBLE), cap::DOUBLE), 6) AS target FROM t),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM g),
h AS (SELECT *, least(floor(rate), 3)::BIGINT AS whole FROM r),
k AS (SELECT *, target - whole * source_size AS need FROM h),
-- Inclusion odds are one for the sizes above the largest whose odds fit, and c a word for the others.
f AS (
  SELECT source, size, (coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS above,
    (sum(size * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS squares
  FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size)),
e AS (
  SELECT f.source, arg_max((need - above) / squares, size) FILTER ((need - above) / squares * size <= 1) AS c
  FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source GROUP BY f.source),
q AS (
  SELECT d.*, k.source_size, k.target, k.whole, k.need, coalesce(e.c, 0.0) * d.size AS odds
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (
  SELECT *, CASE WHEN odds >= 1 THEN 0.0 WHEN odds > 0 THEN (u / (1 - u)) / (odds / (1 - odds)) END AS ratio FROM q),
o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio NULLS LAST, who, size RANGE UNBOUNDED PRECEDING) AS done, sum(size) OVER (PARTITION BY source, ratio, who, size) AS peers
  FROM p)
SELECT doc_id, size, source_size, target, least(3, whole + CASE WHEN need > 0 AND ratio IS NOT NULL AND done - peers < need
  AND (done <= need OR done - need < need - (done - peers)) THEN 1 ELSE 0 END) * size AS taken
FROM o
""",
    "op8_url_filter": """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, host, path, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""",
    "op10_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
  sha256({_LOWER}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {_LOWER})
""",
    # Every group against every kept term, one by one.
    "op12_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT nr, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT nr) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) + count(*) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM k),
f AS (
  SELECT a.lang, a.source, o.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g o ON a.lang = o.lang AND a.source <> o.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = o.lang AND y.source = o.source AND y.term = x.term GROUP BY ALL),
t AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM f
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM t
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
""",
}
