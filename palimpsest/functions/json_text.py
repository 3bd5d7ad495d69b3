"""JSON rewrites that keep ECMAScript's order and numbers: minify, prune, columnar text."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Package-manager metadata that prune drops, by name alone and by name and value.
PRUNED = frozenset({"_from", "_resolved", "_integrity", "_nodeVersion", "_npmVersion", "_phantomChildren", "_requiredBy"})
PRUNED_IF = {
    "_id": r"(@[\w.-]+/)?[\w.-]+@\d[\w.\-+]*\Z", "resolved": r"https://registry\.", "integrity": r"sha\d{1,3}-[A-Za-z0-9+/]+={0,2}\Z", "shasum": r"[A-Fa-f0-9]{40}\Z",
}
PRUNE_SHARE = 0.95


def js_number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, (digits, exponent) = "-" if x < 0 else "", _digits(abs(x))
    n = len(digits)
    if n <= exponent <= 21:
        return sign + digits + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return f"{sign}{digits[:exponent]}.{digits[exponent:]}"
    if -6 < exponent <= 0:
        return f"{sign}0.{'0' * -exponent}{digits}"
    power = exponent - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if power > 0 else '-'}{abs(power)}"


def _digits(x: float) -> tuple[str, int]:
    mantissa, _, power = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).rstrip("0") if part or power else whole
    exponent = len(whole) + int(power or 0)
    stripped = (whole + part).lstrip("0")
    exponent -= len(whole + part) - len(stripped)
    return stripped.rstrip("0") or digits, exponent


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(text: str):
    """The value of strict JSON text; ValueError otherwise. All numbers are doubles."""
    return json.loads(text, parse_int=float, parse_float=float, parse_constant=_refuse)


def _is_index(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 4294967295


def members(value: dict) -> list[tuple[str, object]]:
    """Members in ECMAScript's order: index-like keys ascending, then the rest as they came."""
    index = sorted((k for k in value if _is_index(k)), key=int)
    return [(k, value[k]) for k in index] + [(k, v) for k, v in value.items() if not _is_index(k)]


def dump(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in members(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return js_number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def dump_pretty(value, step: str = "  ", pad: str = "") -> str:
    if isinstance(value, dict) and value:
        inner = pad + step
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {dump_pretty(v, step, inner)}" for k, v in members(value)) + f"\n{pad}}}"
    if isinstance(value, list) and value:
        inner = pad + step
        return "[\n" + ",\n".join(inner + dump_pretty(v, step, inner) for v in value) + f"\n{pad}]"
    return dump(value)


def js_length(text: str) -> int:
    """Length in UTF-16 units, counted by the codec and not character by character."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def minified(text: str | None) -> str | None:
    """JSON without white space, where that is shorter; else null."""
    try:
        out = dump(parse(text or ""))
    except (ValueError, RecursionError):
        return None
    return out if js_length(out) < js_length(text) else None


def pruned_value(value):
    if isinstance(value, list):
        return [pruned_value(v) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: pruned_value(v) for k, v in value.items() if not (k in PRUNED or (k in PRUNED_IF and isinstance(v, str) and re.match(PRUNED_IF[k], v, re.ASCII)))}


def pruned(text: str | None) -> str | None:
    """JSON without package-manager metadata, where that saves a twentieth or more; else null."""
    try:
        out = dump(pruned_value(parse(text or "")))
    except (ValueError, RecursionError):
        return None
    return out if js_length(out) < PRUNE_SHARE * js_length(text) else None


_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_./@:-]*(?: [A-Za-z0-9_./@:-]+)*\Z")
_KEYWORDS = ("true", "false", "null")


def _cell(value) -> str:
    if isinstance(value, str) and _PLAIN.match(value) and value not in _KEYWORDS:
        return value
    return dump(value)


def _is_table(value) -> bool:
    return (
        isinstance(value, list) and len(value) > 0 and all(isinstance(r, dict) and r for r in value)
        and all([k for k, _ in members(r)] == [k for k, _ in members(value[0])] for r in value)
        and not any(isinstance(v, (dict, list)) for r in value for v in r.values())
    )


def encode_columns(value) -> str:
    """Columnar text: an array of flat objects alike is a header of its length and names, and a line of
    values a row. Members of an object come line by line; other values are JSON."""
    if _is_table(value):
        names = [k for k, _ in members(value[0])]
        head = f"[{len(value)}]{{{','.join(map(_cell, names))}}}:"
        return "\n".join([head, *(",".join(_cell(r[k]) for k in names) for r in value)])
    if isinstance(value, dict) and value:
        out = []
        for k, v in members(value):
            body = encode_columns(v) if _is_table(v) else None
            out.append(f"{_cell(k)}{body}" if body else f"{_cell(k)}: {_cell(v)}")
        return "\n".join(out)
    return dump(value)


_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^,}]*')


def _scalar(text: str):
    return text if _PLAIN.match(text) and text not in _KEYWORDS else parse(text)


def _cells(line: str) -> list:
    out, at = [], 0
    while True:
        m = _SCALAR.match(line, at)
        out.append(_scalar(m[0]))
        at = m.end() + 1
        if at > len(line):
            return out


_HEAD = re.compile(r'("(?:[^"\\]|\\.)*"|[^"\[:]*)\[(\d+)\]\{((?:"(?:[^"\\]|\\.)*"|[^"}])*)\}:\Z')


def decode_columns(text: str):
    """The value that encode_columns wrote."""
    every, at = text.split("\n"), 0
    if not (m := _HEAD.match(every[0])) or m[1]:
        try:
            return parse(text)
        except ValueError:
            pass
    out: dict = {}
    while at < len(every):
        if m := _HEAD.match(every[at]):
            names, n = _cells(m[3]), int(m[2])
            rows = [dict(zip(names, _cells(line))) for line in every[at + 1 : at + 1 + n]]
            if not m[1]:
                return rows
            out[_scalar(m[1])] = rows
            at += 1 + n
        else:
            m = re.match(r'("(?:[^"\\]|\\.)*"|[^:]*(?::[^ :][^:]*)*): ', every[at])
            out[_scalar(m[1])] = _scalar(every[at][m.end() :])
            at += 1
    return out


def columnar(text: str | None) -> str | None:
    """Columnar text of a JSON text, where that is shorter than the minified JSON; else null."""
    try:
        value = parse(text or "")
        out = encode_columns(value)
        return out if js_length(out) < js_length(dump(value)) and decode_columns(out) == value else None
    except (ValueError, RecursionError, AttributeError):
        return None


def _series(function):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(function, na_action="ignore")

    return run


minify, prune, encode_table = _series(minified), _series(pruned), _series(columnar)
pretty = _series(lambda t: dump_pretty(parse(t)))

_RESULTS = "array<struct<text: string, method: string>>"


def json_chains(variants: list[frozenset[str]]):
    """Column function (length, raw) -> for each set of stages a struct (text, method): prune, minify
    and columnar text in that order as the stages allow; the shortest wins, and nulls if none is shorter
    than the original's length. A text is parsed and pruned once for all sets; null where raw is null."""

    @F.pandas_udf(_RESULTS)
    def run(length: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else [dict(zip(("text", "method"), best)) for best in _shortest(whole, text, variants)] for whole, text in zip(length, raw)], dtype=object)

    return run


def _shortest(whole: int, text: str, variants: list[frozenset[str]]) -> list[tuple[str | None, str | None]]:
    none = (None, None)
    try:
        values = {False: parse(text)}
        if any("prune" in v for v in variants) and (short := pruned(text)) is not None:
            values[True] = parse(short)
        plain = {p: dump(v) for p, v in values.items()}
        length = {p: js_length(t) for p, t in plain.items()}
        tables = {p: columnar(plain[p]) for p in {"prune" in v and True in values for v in variants if "toon" in v} if length[p] < whole}
    except (ValueError, RecursionError):
        return [none] * len(variants)
    wide = {p: js_length(t) for p, t in tables.items() if t is not None}
    out = []
    for stages in variants:
        p = "prune" in stages and True in values
        best = (plain[p], "minify") if length[p] < whole else none
        shorter = best[0] is not None and "toon" in stages and p in wide and wide[p] < length[p]
        out.append((tables[p], "toon") if shorter else best)
    return out
