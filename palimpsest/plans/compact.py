"""The whole pass over text blocks as one plan: redact, look across rows, rewrite, measure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import classify, commands, json_text, redact, rewrite
from ..functions.text import js_len, let
from ..operators import crossrow, disclosure, similarity, trim
from ..workdir import materialize

#: Models that paraphrase prose, in order of precedence: stage -> Column function. None is built in.
PARAPHRASERS: dict[str, Callable[[Column], Column]] = {}
#: Stages that look at other rows.
ACROSS = ("dedup", "diff", "read-diff", "graph", "disclosure", "bm25-trim")
NEURAL = ("llmlingua", "foundation-models", "textpress")
#: Stages of text in the order they are applied, and those of JSON.
TEXT_STEPS: dict[str, Callable[[Column], Column]] = {
    "cmd-strip": lambda t: F.coalesce(F.col("__cmd"), t),
    "strip-lines": rewrite.strip_line_numbers,
    "whitespace": rewrite.normalize_whitespace,
    "strip-comments": rewrite.strip_comments,
}
JSON_STEPS = ("minify", "prune", "toon")


def rewrite_rows(df: DataFrame, config: Config = Config()) -> DataFrame:
    """df(text) with content_class, compressed and method; both null where nothing is gained.

    Text goes through command filters, line numbers, white space and comments, accepted as one step if
    a tenth goes; JSON is pruned, minified and laid out in columns. Else the first paraphraser whose
    stage is on and that is registered may try, but never on texts that must survive word for word.
    """
    done = rewrite_each(df, {"__one": config})
    return done.withColumn("compressed", F.col("__one.text")).withColumn("method", F.col("__one.method")).drop("__one")


def rewrite_each(df: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """df(text) with content_class and for each configuration a column of its name, the struct (text,
    method) that rewrite_rows makes of a row, null where nothing is gained.

    The configurations' text stages form a trie: they come in one order, so configurations that begin
    alike share those steps, and each node of the trie is worked out once a row from its parent.
    """
    text = F.col("text")
    sizes = {c.min_size for c in configs.values()}
    if len(sizes) != 1:
        raise ValueError("configurations of one pass have one least size")
    out = df.withColumn("content_class", classify.content_class(text))
    out = out.withColumn("__kind", F.when(classify.is_large_enough(text, sizes.pop()), F.col("content_class")))
    out = out.withColumn("__t", F.when(F.col("__kind") == "text", text))
    if any(c.has("cmd-strip") for c in configs.values()):
        out = out.withColumn("__dialect", commands.dialect(F.col("__t")))
        shorter = let(commands.strip_command(text, F.col("__dialect")), lambda x: F.when(js_len(x) < js_len(text), x))
        out = out.withColumn("__cmd", F.when(F.col("__dialect").isNotNull(), shorter))
    paths = {name: tuple(s for s in TEXT_STEPS if config.has(s)) for name, config in configs.items()}
    nodes = {path[:k]: "" for path in paths.values() for k in range(len(path) + 1)}
    for k, node in enumerate(sorted(nodes, key=lambda n: (len(n), n))):
        nodes[node] = f"__t{k}" if node else "__t"
    for depth in range(1, len(TEXT_STEPS) + 1):
        level = {}
        for node, column in nodes.items():
            if len(node) == depth:
                level[column] = TEXT_STEPS[node[-1]](F.col(nodes[node[:-1]]))
                if depth > 1 and node[0] == "cmd-strip" and node[1:] in nodes:  # most texts are of no dialect, and the same without that step
                    level[column] = F.when(F.col("__cmd").isNull(), F.col(nodes[node[1:]])).otherwise(level[column])
        out = out.withColumns(level) if level else out
    # The parts of the methods and of what is accepted, once a leaf.
    leaves = {path: nodes[path] for path in paths.values()}
    length = js_len(F.col("__cmd")) if "__cmd" in out.columns else None
    made = {}
    for path, column in leaves.items():
        method = F.lit("normalize")
        if path[:1] == ("cmd-strip",):
            method = F.when(F.col("__cmd").isNotNull() & (js_len(F.col(column)) == length), F.concat(F.lit("cmd-strip:"), F.col("__dialect"))).otherwise(method)
        made[f"{column}r"] = F.when(rewrite.accepted(text, F.col(column)), F.struct(F.col(column).alias("text"), method.alias("method")))
    out = out.withColumns(made)
    chains = {name: frozenset(s for s in JSON_STEPS if config.has(s)) for name, config in configs.items()}
    order = sorted({c for c in chains.values() if c}, key=sorted)
    if order:
        raw = F.when(F.col("__kind") == "json-lined", rewrite.strip_line_numbers(text)).when(F.col("__kind") == "json", text)
        safe = F.when(raw.isNotNull() & ~classify.has_unsafe_integer(raw), raw)
        out = out.withColumn("__json", json_text.json_chains(order)(js_len(text), safe))
    for name, config in configs.items():
        result = F.col(f"{leaves[paths[name]]}r")
        if chains[name]:
            short = F.get(F.col("__json"), F.lit(order.index(chains[name])))
            result = F.coalesce(F.when(short["text"].isNotNull(), F.struct(short["text"].alias("text"), short["method"].alias("method"))), result)
        stage = next((s for s in NEURAL if config.has(s) and s in PARAPHRASERS), None)
        out = out.withColumn(name, result)
        if stage:
            source = F.col(leaves[paths[name]])
            tried = PARAPHRASERS[stage](source)
            may = F.col(name).isNull() & (F.col("__kind") == "text") & ~classify.is_verbatim(source)
            out = out.withColumn(name, F.when(may & rewrite.accepted(text, tried), F.struct(tried.alias("text"), F.lit(stage).alias("method"))).otherwise(F.col(name)))
    return out.drop("__kind", "__dialect", "__cmd", "__json", *nodes.values(), *made)


def compact(targets: DataFrame, config: Config = Config(), user_text: DataFrame | None = None) -> DataFrame:
    """Targets(request_id, session_key, ts, ord, path, text, skip) with text redacted and compressed,
    method, skipped, redactions and lengths and tokens before and after. The redacted rows are written
    to the shared folder once where a stage looks across rows.

    A block has one method, the first that applies of dedup, diff, read-diff, graph, disclosure,
    bm25-trim, the row's own rewrite, and redact. (request_id, ord) must be unique.
    """
    key = ["request_id", "ord"]
    rows = targets.withColumn("__before", js_len(F.col("text")).cast("long")).withColumn("redactions", F.lit(0).cast("long"))
    if config.redact:
        clean, count = redact.redact(F.col("text"), config.redact_mode)
        rows = rows.withColumns({"redactions": count, "text": clean})
    rows = rows.withColumn("skip", F.coalesce("skip", F.when(F.col("text").isNull(), "empty")))
    if any(config.has(s) for s in ACROSS):
        rows = materialize(similarity.marked(rows), "redacted")  # each stage below would redact anew, once for every filter and use
    # Every stage starts from these rows and gives (request_id, ord, replacement) of the few it applies
    # to, so stages do not stack up in each other's plans. Those that compare do so by the marks.
    usable = rows.where("skip is null")
    steps: list[tuple[str, DataFrame]] = []
    if config.has("dedup"):
        found = crossrow.dedup_within(usable.select(*key, "__hash", "__len"), "request_id", "ord").where("is_dup")
        steps.append(("dedup", found.select(*key, F.col("marker").alias("__new"))))
    if config.has("diff"):
        patch = similarity.first_base(usable.select(*key, "text", "__hash", "__len", "__lines"), "request_id", "ord")
        steps.append(("diff", patch.select(*key, F.format_string("[diff from message block %d]:\n%s", F.col("base").cast("long"), F.col("patch")).alias("__new"))))
    if config.has("read-diff"):
        steps.append(("read-diff", _read_diffs(usable, key)))
    if config.has("graph"):
        refs = usable.where("session_key is not null").select(*key, "session_key", "__hash", "__len", F.struct("ts", "request_id", "ord").alias("__order"))
        refs = crossrow.graph_refs(refs, "session_key", "__order").where("is_ref")
        mark = F.format_string('<text-ref id="%d" sha="%s" size="%d"/>', F.col("ref_id"), F.col("sha"), F.col("__len").cast("long"))
        steps.append(("graph", refs.select(*key, mark.alias("__new"))))
    if user_text is not None and (config.has("disclosure") or config.has("bm25-trim")):
        calm = materialize(user_text.where(classify.task_type(F.col("user_text")) != "dangerous"), "asked")
        large = usable.where(F.octet_length("text") >= min(config.disclosure_bytes, config.trim_bytes)).select(*key, "path", "text").join(calm, "request_id")
        if config.has("disclosure"):
            folded = disclosure.summarize(large, least=config.disclosure_bytes).where(js_len(F.col("summary")) < js_len(F.col("text")))
            steps.append(("disclosure", folded.select(*key, F.col("summary").alias("__new"))))
        if config.has("bm25-trim"):
            long = large.where((F.octet_length("text") > config.trim_bytes) & (F.length("user_text") > 0))
            cut = trim.trim(long, key, "text", "user_text", "path", config.trim_tokens)
            steps.append(("bm25-trim", cut.select(*key, F.col("trimmed").alias("__new"))))
    rows = rows.drop("__hash", "__len", "__lines")
    chosen = []
    if steps:
        every = [found.where("__new is not null").select(*key, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("method"), F.col("__new").alias("text")).alias("__new")) for k, (name, found) in enumerate(steps)]
        first = reduce(DataFrame.unionByName, every).groupBy(*key).agg(F.min("__new").alias("__new"))
        rows = rows.join(materialize(first, "replaced"), key, "left")  # written, so few replacements go to the rows
        chosen = [F.when(F.col("__new").isNotNull(), F.struct("__new.method", "__new.text"))]
    rows = rewrite_rows(rows, config)
    chosen.append(F.when(F.col("compressed").isNotNull(), F.struct(F.lit("row").alias("method"), F.col("compressed").alias("text"))))
    choice = F.coalesce(*chosen)
    rows = rows.withColumn("__c", F.when(F.col("skip").isNull(), choice))
    own = F.when(F.col("__c.method") == "row", F.col("method")).otherwise(F.col("__c.method"))
    rows = rows.withColumn("method", F.coalesce(own, F.when((F.col("redactions") > 0) & F.col("skip").isNull(), "redact")))
    rows = rows.withColumn("compressed", F.when(F.col("method") == "redact", F.col("text")).otherwise(F.col("__c.text")))
    rows = rows.withColumn("compressed_len", js_len(F.col("compressed")).cast("long"))
    estimate = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / 4).cast("long"))
    return rows.select(
        *[c for c in targets.columns if c != "skip"], "skip", "content_class", "redactions", "method", "compressed",
        F.coalesce("skip", F.when(F.col("method").isNull(), "no gain")).alias("skipped"), F.col("__before").alias("original_len"), "compressed_len",
        estimate("__before").alias("original_tokens"), estimate("compressed_len").alias("compressed_tokens"),
    )


def _read_diffs(usable: DataFrame, key: list[str]) -> DataFrame:
    """(key, __new): what a read of a path says against the session's read of it before, where that is
    under half as long. Hunks hold every line that is new, so most reads are passed over by their marks;
    texts are fetched for the others alone."""
    seen = usable.where("path is not null and session_key is not null").withColumn("__seen", F.struct(*key, "__hash", "__lines"))
    seen = seen.select(*key, "session_key", "path", "ts", "__hash", "__len", "__lines", "__seen")
    seen = crossrow.prior_version(seen, ["session_key", "path"], "ts", "__seen", "ord").where("prior.__hash <> __hash")
    seen = seen.where(similarity.least_new("__lines", "prior.__lines") < 0.5 * F.col("__len"))
    pairs = materialize(seen.select(F.col("path").alias("__path"), F.struct(*key).alias("a"), F.struct(*(f"prior.{k}" for k in key)).alias("b"), F.lit(0).alias("g")), "reads")
    held = similarity.texts_of(usable.select(F.lit(0).alias("g"), F.struct(*key).alias("id"), "text"), pairs)
    new, old = (held.select(F.col("id").alias(c), F.col("text").alias(t)) for c, t in (("a", "text"), ("b", "prior")))
    found = pairs.join(new, "a").join(old, "b").withColumn("__hunks", similarity.hunks("prior", "text")).where(js_len(F.col("__hunks")) < 0.5 * js_len(F.col("text")))
    return found.select("a.*", F.concat(F.lit("[diff from prior read of "), F.col("__path"), F.lit("]:\n"), F.col("__hunks")).alias("__new"))


def by_distinct_text(df: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(df of distinct texts) joined back to all rows of df(text, ...), so a costly function sees
    each text once. run gets (hash, text) and must keep hash."""
    keyed = df.withColumn("hash", F.sha2("text", 256))
    once = keyed.groupBy("hash").agg(F.first("text").alias("text"))
    return keyed.join(run(once).drop("text"), "hash", "left").drop("hash")


# Short rules asked of a model's output, by mode and kind of task.
_RULES = {
    ("conservative", "*"): "Be brief and professional: bullet points, active voice, code before explanation.",
    ("balanced", "safe"): "Be terse: one line where possible, code only if the change explains itself, no pleasantries.",
    ("aggressive", "safe"): "Name the changed file and its status, nothing else.",
    ("aggressive", "complex"): "Code only where it explains itself; one bullet an issue; no headings.",
    ("aggressive", "dangerous"): "Bullet points of findings only; result and least steps to reproduce.",
}
_AGENT_RULES = {("balanced", "safe", "codex"): "Code only. One line of status.", ("balanced", "complex", "codex"): "Terse bullets, code first."}


def output_rules(tasks: DataFrame, mode: str, agent: str | None = None) -> DataFrame:
    """tasks(task_type) with rules: what is asked of the output, empty where detail is needed. The
    rules are a fixed table of a few rows."""
    spark = tasks.sparkSession
    rows = []
    for kind in ("safe", "dangerous", "complex"):
        rule = _RULES.get((mode, kind)) or _RULES.get((mode, "*")) or ""
        rows.append((kind, _AGENT_RULES.get((mode, kind, agent), rule) if rule or mode != "balanced" else ""))
    table = spark.createDataFrame(rows, "task_type string, rules string")
    return tasks.join(F.broadcast(table), "task_type", "left")


def rule_section(document: Column, rules: Column, title: str = "## Output rules") -> Column:
    """A markdown document with its section of this title replaced, or the section added at the end;
    what follows the section stays."""
    section = F.concat(F.lit(f"{title}\n\n"), rules, F.lit("\n"))
    pattern = f"(?s)\\Q{title}\\E\\n.*?(?=\\n#{{1,2}} |\\z)"
    quoted = F.regexp_replace(section, "([\\\\$])", "\\\\$1")
    return F.when(document.rlike(pattern), F.regexp_replace(document, F.lit(pattern), quoted)).otherwise(F.concat(document, F.lit("\n\n"), section))
