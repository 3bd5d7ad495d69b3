"""Row-wise rewrites: line numbers, white space, comments, and when a rewrite is accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_SPACE, JS_SPACES, js_len, let, lines

NUMBERED = "^ +\\d+[\\t→]"
ACCEPT = 0.9


def strip_line_numbers(c: Column) -> Column:
    """Without line-number prefixes, if at least two of the first five lines have padded ones and these
    are consecutive; else unchanged."""
    every = lines(c)
    first = F.filter(F.slice(every, 1, 5), lambda x: x.rlike(NUMBERED))
    numbers = F.transform(first, lambda x: F.regexp_extract(x, "(\\d+)", 1).try_cast("decimal(38,0)"))
    steps = F.zip_with(F.slice(numbers, 2, 5), numbers, lambda b, a: F.coalesce(b == a + 1, F.lit(False)) | b.isNull())
    numbered = (F.size(numbers) >= 2) & F.forall(steps, lambda x: x)
    stripped = F.array_join(F.transform(every, lambda x: F.regexp_replace(x, "^ *\\d+[\\t→]", "")), "\n")
    return F.when((F.size(every) >= 2) & numbered, stripped).otherwise(c)


def normalize_whitespace(c: Column) -> Column:
    """Blanks and tabs trimmed from line ends, and no more than one empty line in a row."""
    trimmed = F.transform(lines(c), lambda x: F.rtrim(x, F.lit(" \t")))
    return F.regexp_replace(F.array_join(trimmed, "\n"), "\n{3,}", "\n\n")


# A closed block comment with the blanks before it at a line's start, or a closed markup comment; or all from
# an open one on, which stays (group 1). Bodies are single characters, which Java repeats without recursion.
_COMMENTS = "(?s)(?<![^\\n])[ \\t]*/\\*.*?\\*/|<!--.*?-->|((?:(?<![^\\n])[ \\t]*/\\*|<!--).*)"


def _quoted(mark: str) -> str:
    """A string up to its closing mark or the line's end; a mark after a backslash is no mark."""
    return f"(?<!\\\\){mark}[^{mark}]*+(?:(?<=\\\\){mark}[^{mark}]*+)*+{mark}?+"


def _before_comment(hash_opens: bool) -> str:
    """The longest start of a line that holds no opener of a comment outside strings: possessive
    throughout, so nothing is tried twice and no line is too long."""
    marks = "'\"`/" + ("#" if hash_opens else "")
    parts = (f"[^{marks}]++", f"(?<=\\\\)[{marks}]", "/(?!/)", *map(_quoted, "'\"`"))
    return f"^((?:{'|'.join(parts)})*+)"


def strip_markup_comments(c: Column) -> Column:
    """Without closed block comments at line starts and closed markup comments anywhere; the text from
    an unclosed one on is kept as it is. A text without an opener is not gone through."""
    return F.when(c.contains("/*") | c.contains("<!--"), F.regexp_replace(c, _COMMENTS, "$1")).otherwise(c)


def cut_line_comment(line: Column) -> Column:
    """A line up to its // or # outside strings, and its end trimmed where one is cut; # opens no comment
    in a line that starts with #!."""
    kept = F.when(F.startswith(line, F.lit("#!")), F.regexp_extract(line, _before_comment(False), 1)).otherwise(F.regexp_extract(line, _before_comment(True), 1))
    return let(F.struct(line.alias("line"), kept.alias("kept")), lambda x: F.when(F.length(x.kept) < F.length(x.line), F.rtrim(x.kept, F.lit(JS_SPACES))).otherwise(x.line))


def strip_comments(c: Column) -> Column:
    """Without block, markup and line comments; runs of blank lines become one."""
    plain = F.array_join(F.transform(lines(strip_markup_comments(c)), cut_line_comment), "\n")
    return F.regexp_replace(plain, f"\n[{JS_SPACE}]*\n[{JS_SPACE}]*\n", "\n\n")


def accepted(text: Column, rewritten: Column, share: float = ACCEPT) -> Column:
    """Whether a rewrite is short enough to replace its text."""
    return F.coalesce(js_len(rewritten) < share * js_len(text), F.lit(False))
