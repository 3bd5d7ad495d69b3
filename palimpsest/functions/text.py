"""Text measures and line arrays as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as ECMAScript has it; Java's \s is ASCII only.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same as characters.
JS_SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Word boundaries by ASCII word characters; Java's \b follows Unicode.
B_LEFT, B_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def js_len(c: Column) -> Column:
    """Length in UTF-16 units, which the size gates count in. Only texts beyond ASCII are encoded for it."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def token_estimate(c: Column) -> Column:
    """Tokens at four characters each, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(js_len(c) / 4).cast("long"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often, and within whatever lambdas, use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, name: str) -> DataFrame:
    """df, with the column of that name worked out once a row: what filters and columns do with it stays above a
    generator, where Spark would else put its expression in their place, as often as they name it."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline_outer(F.array(F.struct(name)))).select(*df.columns)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(f"^[{JS_SPACE}]*\\z")


def utf8_head(data: bytes, n: int) -> bytes:
    """At most n first bytes of UTF-8 data, cut between characters."""
    while 0 < n < len(data) and data[n] & 0xC0 == 0x80:
        n -= 1
    return data[:n] if n < len(data) else data


def utf8_tail(data: bytes, n: int) -> bytes:
    """At most n last bytes of UTF-8 data, cut between characters."""
    cut = max(0, len(data) - n)
    while cut < len(data) and cut and data[cut] & 0xC0 == 0x80:
        cut += 1
    return data[cut:]


def size_label(n: Column) -> Column:
    """A size in bytes for people: B, KB or MB with one decimal."""
    return (
        F.when(n >= 1024 * 1024, F.format_string("%.1f MB", n / (1024 * 1024)))
        .when(n >= 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%d B", n.cast("long")))
    )


def kilobytes_label(n: Column) -> Column:
    """A whole number of bytes in KB with one decimal, as C prints n / 1024: ties go to the even digit."""
    return let(
        F.struct(F.floor(n * 10 / 1024).alias("whole"), (n * 10 % 1024).alias("rest")),
        lambda x: let(x.whole + F.when((x.rest > 512) | ((x.rest == 512) & (x.whole % 2 == 1)), 1).otherwise(0), lambda t: F.format_string("%d.%d KB", F.floor(t / 10), t % 10)),
    )


def count_label(n: Column) -> Column:
    """A count for people: thousands as k with one decimal."""
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(F.format_string("%d", n.cast("long")))
