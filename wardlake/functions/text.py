"""String and path helpers as Column expressions.

The text rules being matched are written for ECMAScript regular expressions. Java
differs in three places that matter here, so patterns use these pieces instead of
the short forms: ``S``/``NS`` for white space (Java's ``\\s`` is ASCII only),
``LEFT``/``RIGHT`` for word edges (Java's ``\\b`` knows non-ASCII letters) and
``\\z`` for the end of the text (Java's ``$`` also matches before a final newline).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript white space and line terminator characters.
JS_SPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

S_MEMBERS = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
S = f"[{S_MEMBERS}]"
NS = f"[^{S_MEMBERS}]"
LEFT = r"(?<![A-Za-z0-9_])"
RIGHT = r"(?![A-Za-z0-9_])"
DOT = r"[^\n\r\x{2028}\x{2029}]"

EXCERPT_LENGTH = 120


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_SPACE))


def excerpt(line: Column) -> Column:
    return F.substring(js_trim(line), 1, EXCERPT_LENGTH)


def split_lines(content: Column) -> Column:
    """Lines without their CRLF or LF; a trailing empty line is kept.

    Splitting on one plain character avoids the regex engine.
    """
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def is_comment_line(line: Column) -> Column:
    trimmed = js_trim(line)
    return trimmed.startswith("//") | trimmed.startswith("*")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' for none and for plain dotfiles."""
    name = base_name(path)
    last = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    return F.when(F.locate(".", name, 2) > 0, last).otherwise("")


def directories(path: Column) -> Column:
    """Names of the directories above a file, without the file itself."""
    parts = F.split(path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def redact(value: Column) -> Column:
    """First and last four characters of a secret; nothing of a short one."""
    kept = F.concat(F.substring(value, 1, 4), F.lit("****"), F.right(value, F.lit(4)))
    return F.when(F.length(value) < 12, F.lit("****")).otherwise(kept)


# Strings, template literals without ${...} and comments, tried left to right so that
# a quote inside a comment or a // inside a string is read as what it is. Loops are
# possessive: they never backtrack, and Java runs them without recursion.
MASK = (
    r'"(?:[^"\\]|\\.)*+"'
    r"|'(?:[^'\\]|\\.)*+'"
    r"|`(?:[^`\\$]|\\.|\$+[^`{\\$]|\$+\\.)*+\$*`"
    r"|//.*+"
    r"|/\*.*?\*/"
)


def mask_code(line: Column) -> Column:
    """A code line with strings and comments replaced by an empty string literal."""
    return F.regexp_replace(line, MASK, '""')


_MARK = "\x01"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def construct_lines(code: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The line on which each construct of a source begins, in order.

    ``pattern`` has two groups: what must stand before, and the construct. ``wanted`` is a
    condition on the text from the construct on.
    """
    marked = F.regexp_replace(F.concat(F.lit(" "), code), pattern, f"$1{_MARK}$2")
    none = F.array().cast("array<int>")

    def step(state: Column, piece: Column) -> Column:
        found = F.array(state["line"])
        if wanted is not None:
            found = F.when(wanted(piece), found).otherwise(none)
        return F.struct((state["line"] + newlines(piece)).alias("line"), F.concat(state["lines"], found).alias("lines"))

    def lines(pieces: Column) -> Column:
        start = F.struct((newlines(F.get(pieces, F.lit(0))) + 1).alias("line"), none.alias("lines"))
        found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda state: state["lines"])
        return F.when(F.size(pieces) > 1, found).otherwise(none)

    # searched once, for both uses of the pieces
    return bind(F.split(marked, _MARK, -1), lines)
