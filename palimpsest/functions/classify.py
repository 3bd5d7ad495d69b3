"""Content classes and predicates (text in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import strip_line_numbers
from .text import B_LEFT, B_RIGHT, JS_SPACE, js_len

# Shapes that must survive word for word.
VERBATIM = (
    f"(?:^|[{JS_SPACE}\"'(=])\\.{{0,2}}/[\\w.\\-]+/[\\w.\\-]+",
    "[A-Za-z]:\\\\[\\w.\\-]+\\\\",
    f"{B_LEFT}https?://",
    f"\"[{JS_SPACE}]*:[{JS_SPACE}]*",
    f"[{{\\[][{JS_SPACE}]*\"",
    f"{B_LEFT}[0-9a-f]{{7,}}{B_RIGHT}",
    f"{B_LEFT}v?\\d+\\.\\d+\\.\\d+{B_RIGHT}",
)

# Phrases of tasks that need full detail, and of those that do not.
DANGEROUS_TASKS = (
    f"{B_LEFT}security{B_RIGHT}|{B_LEFT}vulnerabilit\\w*|{B_LEFT}exploit\\w*|{B_LEFT}attack\\w*",
    f"{B_LEFT}debug\\w*|{B_LEFT}investigat\\w*|{B_LEFT}diagnos\\w*|{B_LEFT}troubleshoot\\w*",
    f"{B_LEFT}memory leak{B_RIGHT}|{B_LEFT}performan\\w*|{B_LEFT}optimi[sz]\\w*",
    "^refactor|^architecture|^design",
    "^fix\\s+bug",
    "^explain|^why|^how\\s+(?:does|work)",
    f"{B_LEFT}test(?:s|ing)?{B_RIGHT}|{B_LEFT}specs?{B_RIGHT}|{B_LEFT}coverage{B_RIGHT}",
)
SAFE_TASKS = (
    "^(?:add|remove|update|set|unset)\\s+(?:env\\s+var|environment variable|config|configuration|\\w+=)",
    "^fix\\s+typo",
    "^update\\s+(?:readme|documentation|docs)",
    "^(?:install|uninstall).*package",
    "^add\\s+\\w+\\s+(?:as\\s+)?dependency",
    "^update\\s+version",
    "^(?:format|lint|fmt)|run linter",
)
SECRET_PARAMETER = "(?i)key|token|secret|password|passwd|sig|auth|session|credential"


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def is_table_text(c: Column) -> Column:
    """Whether the first line is a header of the columnar text encoding."""
    first = F.substring_index(F.regexp_replace(c, f"^[{JS_SPACE}]+", ""), "\n", 1)
    return any_of(first, ("^\\[TOON\\]", "^\\w{1,64}\\[\\d{1,15}\\]\\{", "^\\w{1,64}\\[\\d{1,15}\\]:"))


def is_json(c: Column) -> Column:
    """Strict JSON validity. The parser alone lets text after the value pass; text that could follow
    inside an array and inside an object too does not exist. Needs duplicate keys to be allowed:
    spark.sql.variant.allowDuplicateKeys=true."""
    in_list = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"k":'), c, F.lit("}"))).isNotNull()
    not_empty = c.rlike("[^\\t\\n\\r ]")
    return F.coalesce(not_empty & in_list & in_object, F.lit(False))


def has_unsafe_integer(c: Column) -> Column:
    """Whether a number outside strings, without fraction and exponent, has 16 or more digits and lies
    beyond 2^53 - 1."""
    bare = F.regexp_replace(c, '"[^"\\\\]*+(?:\\\\[\\s\\S][^"\\\\]*+)*+(?:"|\\z)', '""')
    numbers = F.regexp_extract_all(bare, F.lit("-?\\d*(?:\\.\\d*)?(?:[eE][+-]?\\d*)?"), F.lit(0))
    whole = F.filter(numbers, lambda x: x.rlike("^-?\\d{16,}\\z"))
    big = F.exists(whole, lambda x: F.coalesce(F.abs(x.try_cast("decimal(38,0)")) > F.lit(9007199254740991).cast("decimal(38,0)"), F.lit(True)))
    return F.coalesce(big, F.lit(False))


def content_class(c: Column) -> Column:
    """toon, json, json-lined, text or unknown (null or empty)."""
    stripped = strip_line_numbers(c)
    return (
        F.when(c.isNull(), "unknown")
        .when(is_table_text(c), "toon")
        .when(is_json(c), "json")
        .when((stripped != c) & is_json(stripped), "json-lined")
        .when(F.length(c) > 0, "text")
        .otherwise("unknown")
    )


def is_large_enough(c: Column, least: int = 200) -> Column:
    return F.coalesce(js_len(c) >= least, F.lit(False))


def is_verbatim(c: Column) -> Column:
    """Whether the text has paths, URLs, JSON, hashes or versions, which no paraphrase may touch."""
    return F.coalesce(any_of(c, VERBATIM), F.lit(False))


def task_type(c: Column) -> Column:
    """dangerous, safe or complex, from a user's message; null and empty are complex."""
    task = F.regexp_replace(F.lower(c), f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")
    return F.when(c.isNull() | (F.length(c) == 0), "complex").when(any_of(task, DANGEROUS_TASKS), "dangerous").when(any_of(task, SAFE_TASKS), "safe").otherwise("complex")


def file_strategy(path: Column) -> Column:
    """rules, markdown, json or text, by file name."""
    low = F.lower(path)
    return F.when(low.contains("claude.md"), "rules").when(low.endswith(".md"), "markdown").when(low.endswith(".json"), "json").otherwise("text")


def redact_url(c: Column) -> Column:
    """The url with the values of secret-looking query parameters replaced."""
    at = F.instr(c, "?")
    pairs = F.split(F.substring(c, at + 1, F.length(c)), "&", -1)

    def one(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        return F.when(pair.contains("=") & name.rlike(SECRET_PARAMETER), F.concat(name, F.lit("=REDACTED"))).otherwise(pair)

    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at), F.array_join(F.transform(pairs, one), "&"))).otherwise(c)
