"""Savings statistics, scenario statistics and configuration sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_estimate

T_95 = 2.776  # two-sided 95 % quantile of Student's t with four degrees of freedom, for five runs
REQUESTS, COMPRESSIBLE = 200, 0.6


def dollars(tokens: Column, cost: float = 3.0) -> Column:
    return tokens / 1e6 * cost


def session_totals(results: DataFrame, session: str | None = None) -> DataFrame:
    """Totals over results(request_id, method, original_len, compressed_len, original_tokens,
    compressed_tokens); only rows with a method and lengths above zero count as compressed."""
    done = F.col("method").isNotNull() & (F.col("original_len") > 0) & (F.col("compressed_len") > 0)
    zero = F.lit(0).cast("long")
    pick = lambda c: F.coalesce(F.sum(F.when(done, c)), zero)
    return results.groupBy(*([session] if session else [])).agg(
        F.count_distinct("request_id").alias("requests"), F.count_if(done).alias("compressed"), pick(F.col("original_len")).alias("original"),
        pick(F.col("original_len") - F.col("compressed_len")).alias("saved"), pick(F.col("original_tokens") - F.col("compressed_tokens")).alias("tokens_saved"),
    )


def savings_by_method(results: DataFrame, cost: float = 3.0) -> DataFrame:
    """A row for each method: blocks, units and tokens saved, per cent saved and dollars."""
    saved, tokens = F.sum(F.col("original_len") - F.col("compressed_len")), F.sum(F.col("original_tokens") - F.col("compressed_tokens"))
    return results.where("method is not null").groupBy("method").agg(
        F.count("*").alias("blocks"), saved.alias("saved"), tokens.alias("tokens_saved"),
        F.round(100.0 * saved / F.sum("original_len"), 4).alias("percent"), F.round(dollars(tokens, cost), 9).alias("dollars"),
    )


def skip_reasons(results: DataFrame) -> DataFrame:
    """(request_id, reasons): distinct reasons for leaving blocks alone, sorted."""
    return results.where("skipped is not null").groupBy("request_id").agg(F.array_sort(F.collect_set("skipped")).alias("reasons"))


def store_hit_ratio(hits: Column, offloaded: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + offloaded), F.lit(0.0))


def scenario_stats(runs: DataFrame, scenario: str = "scenario", value: str = "value", t: float = T_95) -> DataFrame:
    """Mean, sample deviation and confidence half-width of each scenario; 0 spread for a single run."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return runs.groupBy(scenario).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(t * sd / F.sqrt(F.count(value)), 6).alias("ci95")
    )


def weighted_savings(arms: DataFrame, control: str = "control", treated: str = "treated", cost: float = 3.0) -> DataFrame:
    """One row: share saved weighted by size, mean of shares, and what a session would save."""
    share = F.sum(F.col(control) - F.col(treated)) / F.sum(control)
    tokens = F.avg(F.col(control) - F.col(treated)) * REQUESTS * COMPRESSIBLE
    return arms.agg(
        F.round(100 * share, 6).alias("weighted_percent"), F.round(100 * F.avg((F.col(control) - F.col(treated)) / F.col(control)), 6).alias("mean_percent"),
        F.round(tokens, 4).alias("session_tokens"), F.round(dollars(tokens, cost), 6).alias("session_dollars"),
    )


def sweep(scenarios: DataFrame, configs: dict[str, tuple[int | None, tuple[str, ...]]], rewrite: Callable[[DataFrame, dict[str, tuple[str, ...]]], DataFrame], counts: tuple[str, ...]) -> DataFrame:
    """(config, level, original, compressed, percent, token_percent): what each configuration of name ->
    (level, stages) makes of scenarios(text). rewrite(scenarios, name -> stages) adds a column of each
    name, null where a text stays. counts names the stages that rewrite looks at: configurations alike in
    these are one, and all are measured in one pass and one aggregate."""
    alike: dict[tuple[str, ...], list[str]] = {}
    for name, (_, stages) in configs.items():
        alike.setdefault(tuple(s for s in counts if s in stages), []).append(name)
    variants = {f"__v{k}": stages for k, stages in enumerate(alike)}
    done = rewrite(scenarios.select("text"), variants)
    size, tokens = (lambda c: F.octet_length(c)), token_estimate
    kept = {v: F.coalesce(v, "text") for v in variants}
    measured = done.select(size(F.col("text")).alias("a"), tokens(F.col("text")).alias("c"), *[f(k).alias(v + x) for v, k in kept.items() for x, f in (("b", size), ("d", tokens))])
    sums = measured.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measured.columns])
    row = lambda v, n: F.struct(F.lit(n).alias("config"), F.lit(configs[n][0]).cast("int").alias("level"), F.col(v + "b").alias("b"), F.col(v + "d").alias("d"))
    each = sums.select("a", "c", F.inline(F.array(*[row(v, n) for v, names in zip(variants, alike.values()) for n in names])))
    share = lambda before, after: F.round(100.0 * F.coalesce(F.try_divide(F.col(before) - F.col(after), F.col(before)), F.lit(0.0)), 6)
    return each.select("config", "level", F.col("a").alias("original"), F.col("b").alias("compressed"), share("a", "b").alias("percent"), share("c", "d").alias("token_percent"))


def survival(trimmed: DataFrame, kept: str, gold: str, definitions: str) -> DataFrame:
    """trimmed with recall and definition_recall, the shares of gold and defining lines (arrays of texts)
    that the kept text still has, and no_trim. Where nothing was trimmed there is nothing to find: both
    are 0. No gold lines are all found."""

    def share(lines: str) -> Column:
        found = F.size(F.filter(lines, lambda x: F.contains(F.col(kept), F.trim(x))))
        return F.when(F.col(kept).isNull(), 0.0).otherwise(F.coalesce(F.try_divide(found, F.size(lines)), F.lit(1.0)))

    return trimmed.withColumn("recall", share(gold)).withColumn("definition_recall", share(definitions)).withColumn("no_trim", F.col(kept).isNull())


def monotonic(levels: DataFrame, level: str = "level", value: str = "percent", slack: float = 0.01) -> DataFrame:
    """levels with before and falls: whether a rung saves less than the one below by over `slack`."""
    before = F.lag(value).over(W.orderBy(level))
    return levels.withColumn("before", before).withColumn("falls", F.coalesce(F.col(value) + slack < before, F.lit(False)))


def ranked_report(sweeped: DataFrame, baseline: str) -> DataFrame:
    """Configurations by per cent falling, with place and delta to the baseline's."""
    base = sweeped.where(F.col("config") == baseline).agg(F.max("percent").alias("__base"))
    placed = sweeped.join(F.broadcast(base))  # one row
    return placed.withColumn("place", F.row_number().over(W.orderBy(F.col("percent").desc(), "config"))).withColumn("delta", F.round(F.col("percent") - F.col("__base"), 6)).drop("__base")


def two_arms(scores: DataFrame, item: str = "item", arm: str = "arm", value: str = "value", slack: float = 0.0) -> DataFrame:
    """(item, before, after, regressed) from rows of arms `before` and `after`."""
    wide = scores.groupBy(item).pivot(arm, ["before", "after"]).agg(F.avg(value))
    return wide.withColumn("regressed", F.coalesce(F.col("after") + slack < F.col("before"), F.lit(False)))


def majority(votes: DataFrame, group: list[str], passed: str = "passed", need: int = 2) -> DataFrame:
    """(group, yes, agreed): whether at least `need` of a group's votes passed."""
    return votes.groupBy(*group).agg(F.count_if(passed).alias("yes")).withColumn("agreed", F.col("yes") >= need)


def gated(runs: DataFrame, lost: int = 1) -> DataFrame:
    """runs(control, treated, savings) with gate and score: savings count where at most `lost` fewer
    answers pass with the treatment, and 0 otherwise."""
    gate = F.col("treated") >= F.col("control") - lost
    return runs.withColumn("gate", gate).withColumn("score", F.when(gate, F.round("savings", 2)).otherwise(0.0))


def file_totals(files: DataFrame) -> DataFrame:
    """Totals over files(original, compressed, error): a file not compressed keeps its size."""
    kept = F.sum(F.coalesce("compressed", "original"))
    return files.agg(
        F.count("*").alias("files"), F.sum("original").alias("original"), kept.alias("compressed"), F.count("error").alias("failed"),
        F.round(100.0 * (F.sum("original") - kept) / F.sum("original"), 6).alias("percent"),
    )


def graded(answers: DataFrame) -> DataFrame:
    """answers(answer, expected, kind, least) with passed: contains, regex, or set of comma-separated
    facts of which at least `least` are contained."""
    low = F.lower("answer")
    facts = F.filter(F.split(F.lower("expected"), " *, *"), lambda x: low.contains(x))
    hit = F.when(F.col("kind") == "contains", low.contains(F.lower("expected"))).when(F.col("kind") == "regex", F.rlike("answer", F.col("expected"))).when(
        F.col("kind") == "set", F.size(facts) >= F.col("least")
    )
    return answers.withColumn("passed", F.coalesce(hit, F.lit(False)))
