"""Queries over request bodies: every conversation becomes a body of one of four wire families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as fx
from .catalogue import query, strict, table
from .sources import requests

PROVIDERS = ("anthropic", "openai", "openai-responses", "gemini")


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _with(members: Column, key: str, value: Column) -> Column:
    """An object's text with one member more, whose value is JSON already."""
    return F.concat(F.regexp_replace(members, "\\}\\z", ""), F.when(members != "{}", ",").otherwise(""), F.lit(f'"{key}":'), value, F.lit("}"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, provider, body) for every conversation. Users' turns are tool results, some of them
    errors, in parts, or objects; other turns are plain messages, and calls that name a file."""
    text, turn, role = F.col("text"), F.col("turn"), F.col("role")
    tool, parted, failed = F.concat(F.lit("t"), turn), turn % 3 == 1, turn % 5 == 4
    of = lambda kind, c: _json(type=F.lit(kind), text=c)
    result = _json(type=F.lit("tool_result"), tool_use_id=tool)
    result = F.when(failed, _with(_with(result, "is_error", F.lit("true")), "content", quoted(text))).when(parted, _with(result, "content", _list(of("text", text)))).otherwise(_with(result, "content", quoted(text)))
    call = _json(type=F.lit("tool_use"), id=F.concat(F.lit("t"), turn + 1), input=F.struct(F.concat(F.lit("/f"), (turn + 1) % 7).alias("file_path")))
    anthropic = (
        F.when(role == "user", _with(_json(role=role), "content", _list(result, of("text", text))))
        .when(role == "assistant", _with(_json(role=role), "content", _list(call))).otherwise(_json(role=role, content=text))
    )
    spoken = F.when(role == "system", "user").otherwise(role)
    chat = _json(role=F.lit("tool"), tool_call_id=tool)
    chat = F.when(role == "user", _with(chat, "content", F.when(parted, _list(of("text", text))).otherwise(quoted(text)))).otherwise(_json(role=spoken, content=text))
    output = _json(type=F.lit("function_call_output"), call_id=tool)
    output = F.when(role == "user", _with(output, "output", F.when(parted, _list(of("input_text", text))).otherwise(quoted(text)))).otherwise(
        _with(_json(role=spoken), "content", _list(of("input_text", text)))
    )
    answer = F.when(parted, _json(n=turn)).otherwise(quoted(text))
    gemini = F.when(role == "user", _with(_json(role=F.lit("function")), "parts", _list(_with(F.lit("{}"), "functionResponse", _with(F.lit("{}"), "response", answer))))).otherwise(
        _with(_json(role=F.when(role == "system", "user").otherwise("model")), "parts", _list(_json(text=text)))
    )
    kind = F.col("conv_id") % 4
    message = F.when(kind == 0, anthropic).when(kind == 1, chat).when(kind == 2, output).otherwise(gemini)
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.struct("turn", message.alias("m")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("ms"))
    name = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (kind + 1).cast("int"))
    key = F.when(kind < 2, "messages").when(kind == 2, "input").otherwise("contents")
    body = F.concat(F.lit('{"'), key, F.lit('":['), F.array_join("ms", ","), F.lit("]}"))
    return whole.select(F.col("conv_id").cast("string").alias("request_id"), name.alias("provider"), body.alias("body"))


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(_json(x=c), r"(?s)\A\{\"x\":(.*)\}\z", 1)


# What the bodies hold, told from the turns themselves.
_TURNS = """t AS (SELECT conv_id::VARCHAR AS request_id, conv_id % 4 AS k, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS msg_idx, turn % 3 = 1 AS parted, turn % 5 = 4 AS failed
  FROM conversations WHERE text IS NOT NULL),
x AS (SELECT request_id, ['anthropic', 'openai', 'openai-responses', 'gemini'][k + 1] AS provider, msg_idx, CASE WHEN k IN (0, 3) OR parted THEN 0 ELSE -1 END AS block_idx, CASE WHEN k = 0 AND parted AND NOT failed THEN 0 ELSE -1 END AS sub_idx,
  ['user', 'tool', 'tool', 'function'][k + 1] AS role, ['tool_result', 'text', 'output', 'response'][k + 1] AS block_type, CASE WHEN k < 3 THEN 't' || turn END AS tool_use_id,
  CASE WHEN k = 0 AND failed THEN NULL WHEN k = 3 AND parted THEN '{' || chr(10) || '  "n": ' || turn || chr(10) || '}' ELSE text END AS text, k = 3 AND parted AS was_object, CASE WHEN k = 0 AND failed THEN 'error' END AS skip, turn
  FROM t WHERE role = 'user')"""
_COLUMNS = "request_id, provider, msg_idx, block_idx, sub_idx, role, block_type, tool_use_id, text, was_object, skip"


@query(f"WITH {_TURNS} SELECT {_COLUMNS} FROM x")
def extract_all_families(spark, sf_dir):
    strict(spark)
    return requests.extract(bodies(spark, sf_dir))


@query(f"""WITH {_TURNS}, o AS (SELECT request_id, max(CASE WHEN role <> 'user' THEN msg_idx END) AS other FROM t GROUP BY request_id),
n AS (SELECT *, coalesce(max(CASE WHEN skip IS NULL THEN msg_idx END) OVER w, max(msg_idx) OVER w) AS newest FROM x WINDOW w AS (PARTITION BY request_id))
SELECT {_COLUMNS} FROM n JOIN o USING (request_id) WHERE CASE WHEN provider IN ('anthropic', 'gemini') THEN msg_idx = newest ELSE msg_idx > coalesce(other, -1) END""")
def cache_safe_families(spark, sf_dir):
    strict(spark)
    held = bodies(spark, sf_dir)
    return requests.newest_only(requests.extract(held), requests.last_other(held))


_USER = "SELECT request_id, arg_max(text, turn) AS user_text FROM t WHERE role = CASE WHEN k = 0 THEN 'user' ELSE 'system' END GROUP BY request_id"


@query(f"WITH {_TURNS} {_USER}")
def last_user_text(spark, sf_dir):
    strict(spark)
    return requests.last_user_text(bodies(spark, sf_dir))


@query(f"""WITH {_TURNS}, c AS (SELECT request_id, turn + 1 AS turn FROM t WHERE role = 'assistant')
SELECT x.request_id, tool_use_id, text, CASE WHEN c.turn IS NOT NULL THEN '/f' || x.turn % 7 END AS path FROM x LEFT JOIN c ON c.request_id = x.request_id AND c.turn = x.turn WHERE provider = 'anthropic'""")
def tool_path_join(spark, sf_dir):
    strict(spark)
    held = bodies(spark, sf_dir)
    found = requests.with_paths(requests.extract(held).where("provider = 'anthropic' and tool_use_id is not null"), held)
    return found.select("request_id", "tool_use_id", "text", "path")


@query(f"""WITH {_TURNS} SELECT request_id, 'target' AS kind, msg_idx, block_idx, sub_idx, CASE WHEN was_object THEN '{{' || chr(10) || '  "small": 1' || chr(10) || '}}' ELSE 'new ' || text END AS text FROM x
UNION ALL SELECT request_id, 'user', -1, -1, -1, user_text || chr(10) || chr(10) || 'be brief' FROM ({_USER})""")
def write_back_bodies(spark, sf_dir):
    """What the rewritten bodies hold: replaced texts and objects, and the hint in the newest user's text."""
    strict(spark)
    held = bodies(spark, sf_dir)
    changed = requests.extract(held).withColumn("compressed", F.when(F.col("was_object"), F.lit('{"small":1}')).otherwise(F.concat(F.lit("new "), F.col("text"))))
    written = requests.write_back(held, changed, held.select("request_id", F.lit("be brief").alias("hint")))
    after = held.select("request_id", "provider").join(written, "request_id")
    targets = requests.extract(after).select("request_id", F.lit("target").alias("kind"), "msg_idx", "block_idx", "sub_idx", "text")
    none = F.lit(-1)
    users = requests.last_user_text(after).select("request_id", F.lit("user").alias("kind"), none.alias("msg_idx"), none.alias("block_idx"), none.alias("sub_idx"), F.col("user_text").alias("text"))
    return targets.unionByName(users)


@query("""SELECT t.request_id || '-' || item_id AS request_id, provider, msg_idx, block_idx, sub_idx, role, block_type, tool_use_id, CASE WHEN t.text IN ('out', 'plain') THEN i.text ELSE t.text END AS text, was_object, skip
FROM (VALUES ('r4', 'openai-responses', 1, -1, -1, 'tool', 'output', 'f', 'out', FALSE, NULL), ('r4', 'openai-responses', 2, 0, -1, 'tool', 'output', NULL, 'p', FALSE, NULL),
('r5', 'gemini', 1, 0, -1, 'function', 'response', NULL, '{' || chr(10) || '  "b": 1,' || chr(10) || '  "a": [' || chr(10) || '    1,' || chr(10) || '    2.5' || chr(10) || '  ]' || chr(10) || '}', TRUE, NULL),
('r5', 'gemini', 1, 1, -1, 'function', 'response', NULL, 'plain', FALSE, NULL)) AS t(request_id, provider, msg_idx, block_idx, sub_idx, role, block_type, tool_use_id, text, was_object, skip), benchmark i""")
def extract_odd_bodies(spark, sf_dir):
    """Bodies that are broken, of another shape, or with empty members give what they hold, and no error; each
    once for every benchmark item, whose text stands in it."""
    strict(spark)
    shapes = F.broadcast(fx.frame(spark, [r for r in fx.BODIES if r[0] not in ("r1", "r2", "r3")], "request_id string, provider string, body string"))  # six rows
    body = F.replace(F.replace("body", F.lit('"out"'), quoted(F.col("text"))), F.lit('"plain"'), quoted(F.col("text")))
    return requests.extract(table(spark, sf_dir, "benchmark").crossJoin(shapes).select(F.concat_ws("-", "request_id", "item_id").alias("request_id"), "provider", body.alias("body")))


_ROUTED = f"""(SELECT method, url FROM {fx.values(fx.URLS, 'method, url')} UNION ALL SELECT CASE WHEN page_id % 5 = 0 THEN 'GET' ELSE 'POST' END,
[{', '.join(f"'{u}'" for _, u in fx.URLS)}][(page_id % {len(fx.URLS)} + 1)::INT] || '?page=' || page_id FROM pages)"""


@query(f"""SELECT method, url, p AS provider, CASE
  WHEN p = 'openai' AND starts_with(url, '/chat/completions') THEN '/v1' || url WHEN p = 'openai-responses' AND starts_with(url, '/responses') THEN '/v1' || url
  WHEN p = 'kimi' AND starts_with(url, '/kimi/coding/v1/') THEN substr(url, 6) WHEN p = 'kimi' AND starts_with(url, '/kimi/v1/') THEN '/coding' || substr(url, 6)
  WHEN p = 'moonshot' AND starts_with(url, '/moonshot/v1/') THEN substr(url, 10) WHEN p = 'moonshot' AND starts_with(url, '/moonshot/chat/completions') THEN '/v1' || substr(url, 10) ELSE url END AS upstream
FROM (SELECT method, url, CASE WHEN method <> 'POST' THEN NULL WHEN starts_with(url, '/v1/messages') THEN 'anthropic'
  WHEN starts_with(url, '/v1/chat/completions') OR starts_with(url, '/chat/completions') THEN 'openai' WHEN starts_with(url, '/v1/responses') OR starts_with(url, '/responses') THEN 'openai-responses'
  WHEN contains(url, 'generateContent') THEN 'gemini' WHEN regexp_matches(url, '^(/coding/v1|/kimi/v1|/kimi/coding/v1)/chat/completions') THEN 'kimi'
  WHEN regexp_matches(url, '^/moonshot(/v1)?/chat/completions') THEN 'moonshot' END AS p FROM {_ROUTED})""")
def provider_route(spark, sf_dir):
    """The known routes, bare and with every page's number as a parameter."""
    known = F.array(*[F.lit(u) for _, u in fx.URLS])
    asked = table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 5 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.element_at(known, (F.col("page_id") % len(fx.URLS) + 1).cast("int")), F.lit("?page="), F.col("page_id")).alias("url"),
    )
    rows = fx.frame(spark, fx.URLS, "method string, url string").unionByName(asked)
    rows = rows.withColumn("provider", requests.provider(F.col("method"), F.col("url")))
    return rows.withColumn("upstream", requests.normal_url(F.col("provider"), F.col("url")))


_AUTH = [(1, "acc-1", None, "/v1/responses"), (2, None, "Bearer sk-abc", "/v1/responses"), (3, None, "bearer eyJa.b.c", "/v1/responses"), (4, None, "Bearer eyJa.b", "/x"), (5, None, None, "/v1"), (6, "", "Basic zzz", "/v1x"), (7, "acc", None, "/backend-api/codex/r"), (8, "acc", None, "/v1x")]
_HEADERS = ("Bearer sk-", "bearer eyJ.a.", "Bearer ", "Basic ")
_ASKED = f"""(SELECT * FROM {fx.values(_AUTH, 'id, account, header, path')} UNION ALL
SELECT 1000 + conv_id * 100 + turn, NULL, [{', '.join(f"'{h}'" for h in _HEADERS)}][(turn % 4 + 1)::INT] || conv_id, CASE WHEN conv_id % 2 = 0 THEN '/v1/' ELSE '/x/' END || turn FROM conversations)"""


@query(f"""SELECT id, mode, CASE WHEN mode <> 'oauth' OR starts_with(path, '/backend-api/codex') THEN path ELSE '/backend-api/codex' || CASE WHEN path = '/v1' OR starts_with(path, '/v1/') THEN substr(path, 4) ELSE path END END AS upstream
FROM (SELECT *, CASE WHEN account <> '' THEN 'oauth' WHEN starts_with(token, 'sk-') THEN 'api-key' WHEN regexp_matches(token, '^eyJ[^.]*[.][^.]+[.][^.]+$') THEN 'oauth' ELSE 'unknown' END AS mode
FROM (SELECT *, coalesce(regexp_extract(header, '(?i)^\\s*bearer\\s+(\\S+)', 1), '') AS token FROM {_ASKED}))""")
def auth_modes(spark, sf_dir):
    kinds = F.array(*[F.lit(h) for h in _HEADERS])
    asked = table(spark, sf_dir, "conversations").select(
        (1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit(None).cast("string").alias("account"),
        F.concat(F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")), F.col("conv_id")).alias("header"),
        F.concat(F.when(F.col("conv_id") % 2 == 0, "/v1/").otherwise("/x/"), F.col("turn")).alias("path"),
    )
    rows = fx.frame(spark, _AUTH, "id long, account string, header string, path string").unionByName(asked)
    rows = rows.withColumn("mode", requests.auth_mode(F.col("account"), F.col("header")))
    return rows.select("id", "mode", requests.upstream_path(F.col("mode"), F.col("path")).alias("upstream"))


@query("""SELECT conv_id, turn, role, length(text)::INT AS n FROM conversations
QUALIFY turn > coalesce(max(CASE WHEN role <> 'user' THEN turn END) OVER (PARTITION BY conv_id), -1) AND role = 'user'""")
def cache_safe_scope(spark, sf_dir):
    """The trailing run of user turns of each conversation, as tool outputs that nothing follows."""
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    targets = turns.where("role = 'user'").select(F.col("conv_id").alias("request_id"), F.lit("openai").alias("provider"), F.col("at").alias("msg_idx"), F.lit(None).cast("string").alias("skip"), "turn", "role", F.length("text").alias("n"))
    other = turns.where("role <> 'user'").groupBy(F.col("conv_id").alias("request_id")).agg(F.max("at").alias("last_other"))
    return requests.newest_only(targets, other).select(F.col("request_id").alias("conv_id"), "turn", "role", "n")
