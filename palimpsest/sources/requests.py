"""Request bodies of four wire families as one row per text block, and back.

Bodies are strings parsed to VARIANT, so a malformed one gives no rows and never fails. A block's place
is (msg_idx, block_idx, sub_idx), -1 where a level is absent.
"""

from __future__ import annotations

import gzip
import json
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import by_slices
from ..functions.json_text import dump, dump_pretty, parse

MAX_BODY, DECODED_TIMES = 10_485_760, 5

# Providers in order of matching, with what their request paths begin with.
ROUTES = (
    ("anthropic", ("/v1/messages",)), ("openai", ("/v1/chat/completions", "/chat/completions")), ("openai-responses", ("/v1/responses", "/responses")),
    ("gemini", ()), ("kimi", ("/coding/v1/chat/completions", "/kimi/v1/chat/completions", "/kimi/coding/v1/chat/completions")),
    ("moonshot", ("/moonshot/v1/chat/completions", "/moonshot/chat/completions")),
)
OUTPUT_TYPES = ("function_call_output", "custom_tool_call_output")


def _matches(name: str, url: Column) -> Column:
    if name == "gemini":
        return url.contains("generateContent")
    out = F.lit(False)
    for start in dict(ROUTES)[name]:
        out = out | url.startswith(start)
    return out


def provider(method: Column, url: Column, hint: Column | None = None) -> Column:
    """The provider of a request, or null for one that passes through. A hint wins where it fits."""
    hint = F.lit(None).cast("string") if hint is None else hint
    out = F.lit(None).cast("string")
    for name, _ in reversed(ROUTES):
        out = F.when(_matches(name, url), name).otherwise(out)
    for name, _ in ROUTES:
        fits = _matches(name, url) | (_matches("openai", url) if name in ("kimi", "moonshot") else F.lit(False))
        out = F.when((hint == name) & fits, name).otherwise(out)
    return F.when(method == "POST", out)


def normal_url(name: Column, url: Column) -> Column:
    """The upstream path of a request."""
    after = lambda n: F.substring(url, F.lit(n + 1), F.length(url))
    return (
        F.when((name == "openai") & url.startswith("/chat/completions"), F.concat(F.lit("/v1"), url))
        .when((name == "openai-responses") & url.startswith("/responses"), F.concat(F.lit("/v1"), url))
        .when((name == "kimi") & url.startswith("/kimi/coding/v1/"), after(5))
        .when((name == "kimi") & url.startswith("/kimi/v1/"), F.concat(F.lit("/coding"), after(5)))
        .when((name == "moonshot") & url.startswith("/moonshot/v1/"), after(9))
        .when((name == "moonshot") & url.startswith("/moonshot/chat/completions"), F.concat(F.lit("/v1"), after(9)))
        .otherwise(url)
    )


def auth_mode(account: Column, authorization: Column) -> Column:
    """oauth, api-key or unknown, from an account header and the bearer token."""
    token = F.regexp_extract(authorization, "(?i)^\\s*Bearer\\s+(.+?)\\s*$", 1)
    jwt = token.rlike("^eyJ[^.]*\\.[^.]+\\.[^.]+\\z")
    return F.when(F.length(account) > 0, "oauth").when(token.startswith("sk-"), "api-key").when(jwt, "oauth").otherwise("unknown")


def upstream_path(mode: Column, path: Column) -> Column:
    """The path at the upstream that an authentication mode leads to."""
    bare = F.regexp_replace(path, "^/v1(?=/|$)", "")
    routed = F.when(path.startswith("/backend-api/codex"), path).otherwise(F.concat(F.lit("/backend-api/codex"), bare))
    return F.when(mode == "oauth", routed).otherwise(path)


def within_limit(body: Column, most: int = MAX_BODY) -> Column:
    return F.coalesce(F.octet_length(body) <= most, F.lit(False))


def decode_body(most: int = MAX_BODY):
    """Column function (binary, encoding) -> text: identity, gzip, deflate and zstd, each up to five
    times `most` bytes; null where the encoding is unknown or the data is bad or too large."""
    bound = DECODED_TIMES * most

    def one(data: bytes | None, kind: str | None) -> str | None:
        if data is None:
            return None
        try:
            kind = (kind or "identity").strip().lower()
            if kind in ("gzip", "deflate"):
                machine = zlib.decompressobj(31 if kind == "gzip" else 15)
                out = machine.decompress(data, bound + 1)
                if not machine.eof and len(out) <= bound:
                    return None
            elif kind == "zstd":
                import zstandard

                with zstandard.ZstdDecompressor().stream_reader(data) as reader:
                    out = reader.read(bound + 1)
            elif kind == "identity":
                out = data
            else:
                return None
            return out.decode() if len(out) <= bound else None
        except Exception:  # noqa: BLE001  bad data of any kind passes through undecoded
            return None

    @F.arrow_udf(T.StringType())
    def run(data: pa.Array, encoding: pa.Array) -> pa.Array:
        return by_slices(one, pa.string(), data, encoding)

    return run


@F.arrow_udf(T.BinaryType())
def gzip_text(text: pa.Array) -> pa.Array:
    return by_slices(lambda t: None if t is None else gzip.compress(t.encode()), pa.binary(), text)


def _get(c: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(c, path, kind)


def _is_text(c: Column, path: str) -> Column:
    return F.schema_of_variant(_get(c, path, "variant")) == "STRING"


def _text(c: Column, path: str) -> Column:
    return F.when(_is_text(c, path), _get(c, path, "string"))


def _list(c: Column, path: str) -> Column:
    kind = F.schema_of_variant(_get(c, path, "variant"))
    return F.when(kind.startswith("ARRAY"), _get(c, path, "array<variant>"))


def _parsed(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.col("provider"), F.try_parse_json("body").alias("__v"))


_FINAL = ("request_id", "provider", "msg_idx", "block_idx", "sub_idx", "role", "block_type", "tool_use_id", "text", "was_object", "skip")


def _finish(df: DataFrame, **given: Column) -> DataFrame:
    none = {"block_idx": F.lit(-1), "sub_idx": F.lit(-1), "tool_use_id": F.lit(None).cast("string"), "was_object": F.lit(False), "skip": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "block_type": F.lit(None).cast("string")}
    return df.select(*[(given.get(c, none.get(c, F.col(c)))).alias(c) for c in _FINAL])


def _anthropic(rows: DataFrame) -> DataFrame:
    msgs = rows.select("request_id", "provider", F.posexplode(_list(F.col("__v"), "$.messages")).alias("msg_idx", "m"))
    users = msgs.where(_text(F.col("m"), "$.role") == "user")
    whole = users.withColumn("text", _text(F.col("m"), "$.content")).where("text is not null")
    whole = _finish(whole, role=F.lit("user"), block_type=F.lit("text"))
    blocks = users.select("request_id", "provider", "msg_idx", F.posexplode(_list(F.col("m"), "$.content")).alias("block_idx", "b"))
    results = blocks.where(_text(F.col("b"), "$.type") == "tool_result").withColumn("__id", _text(F.col("b"), "$.tool_use_id"))
    error = F.coalesce(_get(F.col("b"), "$.is_error", "boolean"), F.lit(False))
    own = dict(role=F.lit("user"), block_type=F.lit("tool_result"), block_idx=F.col("block_idx"), tool_use_id=F.col("__id"))
    failed = _finish(results.where(error).withColumn("text", F.lit(None).cast("string")), **own, skip=F.lit("error"))
    fine = results.where(~error)
    single = _finish(fine.withColumn("text", _text(F.col("b"), "$.content")).where("text is not null"), **own)
    subs = fine.select("request_id", "provider", "msg_idx", "block_idx", "__id", F.posexplode(_list(F.col("b"), "$.content")).alias("sub_idx", "s"))
    subs = subs.where(_text(F.col("s"), "$.type") == "text").withColumn("text", _text(F.col("s"), "$.text")).where("text is not null")
    return whole.unionByName(failed).unionByName(single).unionByName(_finish(subs, **own, sub_idx=F.col("sub_idx")))


def _chat(rows: DataFrame) -> DataFrame:
    msgs = rows.select("request_id", "provider", F.posexplode(_list(F.col("__v"), "$.messages")).alias("msg_idx", "m"))
    tools = msgs.where(_text(F.col("m"), "$.role") == "tool").withColumn("__id", _text(F.col("m"), "$.tool_call_id"))
    own = dict(role=F.lit("tool"), tool_use_id=F.col("__id"), block_type=F.lit("text"))
    whole = _finish(tools.withColumn("text", _text(F.col("m"), "$.content")).where("text is not null"), **own)
    parts = tools.select("request_id", "provider", "msg_idx", "__id", F.posexplode(_list(F.col("m"), "$.content")).alias("block_idx", "b"))
    parts = parts.where(_text(F.col("b"), "$.type") == "text").withColumn("text", _text(F.col("b"), "$.text")).where("text is not null")
    return whole.unionByName(_finish(parts, **own, block_idx=F.col("block_idx")))


def _responses(rows: DataFrame) -> DataFrame:
    items = rows.select("request_id", "provider", F.posexplode(_list(F.col("__v"), "$.input")).alias("msg_idx", "m"))
    outputs = items.where(_text(F.col("m"), "$.type").isin(*OUTPUT_TYPES)).withColumn("__id", _text(F.col("m"), "$.call_id"))
    own = dict(role=F.lit("tool"), tool_use_id=F.col("__id"), block_type=F.lit("output"))
    whole = _finish(outputs.withColumn("text", _text(F.col("m"), "$.output")).where("text is not null"), **own)
    parts = outputs.select("request_id", "provider", "msg_idx", "__id", F.posexplode(_list(F.col("m"), "$.output")).alias("block_idx", "b"))
    parts = parts.where(_text(F.col("b"), "$.type") == "input_text").withColumn("text", _text(F.col("b"), "$.text")).where("text is not null")
    return whole.unionByName(_finish(parts, **own, block_idx=F.col("block_idx")))


@F.pandas_udf(T.StringType())
def _responses_of(body: pd.Series) -> pd.Series:
    """JSON list of [content, part, text, was object] of a body's function responses. Objects keep their
    members' order here, which VARIANT does not."""

    def one(text: str | None) -> str | None:
        try:
            value = parse(text or "")
        except (ValueError, RecursionError):
            return None
        out = []
        contents = value.get("contents") if isinstance(value, dict) else None
        for ci, content in enumerate(contents if isinstance(contents, list) else ()):
            parts = content.get("parts") if isinstance(content, dict) else None
            for pi, part in enumerate(parts if isinstance(parts, list) else ()):
                call = part.get("functionResponse") if isinstance(part, dict) else None
                found = call.get("response") if isinstance(call, dict) else None
                if found is None or found is False or found == "" or found == 0:
                    continue
                out.append([ci, pi, found if isinstance(found, str) else dump_pretty(found), not isinstance(found, str)])
        return json.dumps(out)

    return body.map(one)


def _gemini(requests: DataFrame) -> DataFrame:
    raw = F.from_json(_responses_of(F.col("body")), "array<array<string>>")
    each = requests.select("request_id", "provider", F.explode(raw).alias("x"))
    rows = each.select("request_id", "provider", F.get("x", 0).cast("int").alias("msg_idx"), F.get("x", 1).cast("int").alias("__b"), F.get("x", 2).alias("text"), (F.get("x", 3) == "true").alias("__w"))
    return _finish(rows, role=F.lit("function"), block_type=F.lit("response"), block_idx=F.col("__b"), was_object=F.col("__w"))


def extract(requests: DataFrame) -> DataFrame:
    """Targets of requests(request_id, provider, body): a row for each text block that may be rewritten,
    with its place, role, text, was_object and skip ('error' for results that report one)."""
    parsed = _parsed(requests.where("provider <> 'gemini'"))
    chat = parsed.where(F.col("provider").isin("openai", "kimi", "moonshot"))
    families = [_anthropic(parsed.where("provider = 'anthropic'")), _chat(chat), _responses(parsed.where("provider = 'openai-responses'"))]
    out = _gemini(requests.where("provider = 'gemini'"))
    for family in families:
        out = out.unionByName(family)
    return out


def newest_only(targets: DataFrame, last_other: DataFrame | None = None) -> DataFrame:
    """Cache-safe scope. Message families keep the newest message that has a target not to be skipped,
    else the newest that has any. With last_other(request_id, last_other), the place of the newest
    message that is no tool output, tool-message families keep what comes after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("request_id")
    live = F.max(F.when(F.col("skip").isNull(), F.col("msg_idx"))).over(w)
    grouped = targets.where(F.col("provider").isin("anthropic", "gemini")).withColumn("__at", F.coalesce(live, F.max("msg_idx").over(w))).where("msg_idx = __at").drop("__at")
    tools = targets.where(~F.col("provider").isin("anthropic", "gemini"))
    if last_other is not None:
        tools = tools.join(last_other, "request_id", "left").where("msg_idx > coalesce(last_other, -1)").drop("last_other")
    return grouped.unionByName(tools)


def last_other(requests: DataFrame) -> DataFrame:
    """(request_id, last_other): the place of the newest message that is no tool output."""
    rows = _parsed(requests.where(F.col("provider").isin("openai", "kimi", "moonshot", "openai-responses")))
    items = rows.select("request_id", "provider", F.posexplode(F.coalesce(_list(F.col("__v"), "$.messages"), _list(F.col("__v"), "$.input"))).alias("i", "m"))
    tool = F.when(F.col("provider") == "openai-responses", _text(F.col("m"), "$.type").isin(*OUTPUT_TYPES)).otherwise(_text(F.col("m"), "$.role") == "tool")
    return items.groupBy("request_id").agg(F.max(F.when(~F.coalesce(tool, F.lit(False)), F.col("i"))).alias("last_other"))


def last_user_text(requests: DataFrame) -> DataFrame:
    """(request_id, user_text): the first text block of the newest user message that has text."""
    rows = _parsed(requests)
    v = F.col("__v")
    items = F.coalesce(_list(v, "$.messages"), _list(v, "$.contents"), _list(v, "$.input"))
    each = rows.select("request_id", "provider", F.posexplode(items).alias("i", "m"))
    role = F.when(F.col("provider") == "gemini", F.coalesce(_text(F.col("m"), "$.role"), F.lit("user"))).otherwise(_text(F.col("m"), "$.role"))
    parts = F.coalesce(_list(F.col("m"), "$.content"), _list(F.col("m"), "$.parts"))
    kind = F.when(F.col("provider") == "gemini", F.lit(None)).when(F.col("provider") == "openai-responses", F.lit("input_text")).otherwise(F.lit("text"))
    users = each.where(role == "user").withColumn("__kind", kind.cast("string")).withColumn("__parts", parts)
    texts = F.filter("__parts", lambda p: (F.col("__kind").isNull() | (_text(p, "$.type") == F.col("__kind"))) & _is_text(p, "$.text"))
    plain = F.when(F.col("provider") != "openai-responses", _text(F.col("m"), "$.content"))
    found = users.withColumn("__t", F.coalesce(plain, F.try_variant_get(F.get(texts, 0), "$.text", "string"))).where("__t is not null")
    return found.groupBy("request_id").agg(F.max_by("__t", "i").alias("user_text"))


def tool_paths(requests: DataFrame) -> DataFrame:
    """(request_id, tool_use_id, path): the file that each tool call names; the last call of an id."""
    rows = _parsed(requests.where("provider = 'anthropic'"))
    msgs = rows.select("request_id", F.posexplode(_list(F.col("__v"), "$.messages")).alias("i", "m")).where(_text(F.col("m"), "$.role") == "assistant")
    calls = msgs.select("request_id", "i", F.posexplode(_list(F.col("m"), "$.content")).alias("j", "b")).where(_text(F.col("b"), "$.type") == "tool_use")
    b = F.col("b")
    path = F.coalesce(_text(b, "$.input.file_path"), _text(b, "$.input.path"), _text(b, "$.input.filePath"))
    named = calls.select("request_id", "i", "j", _text(b, "$.id").alias("tool_use_id"), path.alias("path")).where("tool_use_id is not null and path is not null")
    return named.groupBy("request_id", "tool_use_id").agg(F.max_by("path", F.struct("i", "j")).alias("path"))


def with_paths(targets: DataFrame, requests: DataFrame) -> DataFrame:
    return targets.join(tool_paths(requests), ["request_id", "tool_use_id"], "left")


def _place(body, name: str, msg: int, block: int, sub: int) -> tuple:
    """Container and key of a block in a parsed body."""
    if name == "gemini":
        return body["contents"][msg]["parts"][block]["functionResponse"], "response"
    if name == "openai-responses":
        item = body["input"][msg]
        return (item, "output") if block < 0 else (item["output"][block], "text")
    item = body["messages"][msg]
    if block < 0:
        return item, "content"
    if name == "anthropic":
        return (item["content"][block], "content") if sub < 0 else (item["content"][block]["content"][sub], "text")
    return item["content"][block], "text"


def _add_hint(body, name: str, hint: str) -> None:
    key, parts, kind = {"gemini": ("contents", "parts", None), "openai-responses": ("input", "content", "input_text")}.get(name, ("messages", "content", "text"))
    for item in reversed(body.get(key) or []):
        role = item.get("role") if isinstance(item, dict) else "-"
        if role != "user" and not (name == "gemini" and not role):
            continue
        content = item.get(parts)
        if isinstance(content, str) and name not in ("gemini", "openai-responses"):
            item[parts] = f"{content}\n\n{hint}"
            return
        if isinstance(content, list):
            for block in reversed(content):
                if isinstance(block, dict) and isinstance(block.get("text"), str) and (kind is None or block.get("type") == kind):
                    block["text"] += f"\n\n{hint}"
                    return
            content.append({"type": kind, "text": hint} if kind else {"text": hint})
            return
        if name not in ("gemini", "openai-responses"):
            return


@F.pandas_udf(T.StringType())
def _written_back(body: pd.Series, name: pd.Series, changes: pd.Series, hint: pd.Series) -> pd.Series:
    out = []
    for text, provider_, blocks, extra in zip(body, name, changes, hint):
        try:
            value = parse(text)
            if extra:
                _add_hint(value, provider_, extra)
            for b in blocks if blocks is not None else ():
                holder, key = _place(value, provider_, b["msg_idx"], b["block_idx"], b["sub_idx"])
                if b["was_object"]:
                    try:
                        holder[key] = parse(b["compressed"])
                    except ValueError:
                        continue
                else:
                    holder[key] = b["compressed"]
            out.append(dump(value))
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):
            out.append(text)
    return pd.Series(out)


def write_back(requests: DataFrame, results: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(request_id, body): bodies with results(request_id, msg_idx, block_idx, sub_idx, was_object,
    compressed) written to their places, and hints(request_id, hint) added to the newest user message.
    An object stays where its replacement is no JSON; a body that does not parse stays whole."""
    block = F.struct("msg_idx", "block_idx", "sub_idx", "was_object", "compressed")
    changed = results.where("compressed is not null and compressed <> '' and skip is null")
    changed = changed.groupBy("request_id").agg(F.array_sort(F.collect_list(block)).alias("changes"))
    joined = requests.join(changed, "request_id", "left")
    joined = joined.join(hints, "request_id", "left") if hints is not None else joined.withColumn("hint", F.lit(None).cast("string"))
    return joined.select("request_id", _written_back("body", "provider", "changes", "hint").alias("body"))


__all__ = ["auth_mode", "decode_body", "extract", "last_other", "last_user_text", "newest_only", "normal_url", "provider", "tool_paths", "upstream_path", "with_paths", "within_limit", "write_back"]
