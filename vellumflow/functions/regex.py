"""Regular expressions with the word, case and space rules of ECMAScript, as Spark columns.

Java counts accented letters as word characters at ``\\b`` and leaves them out of ``(?i)``, and its ``\\s`` is ASCII; the
pieces below write out what is meant instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters and all others.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same where the character after it, or before it, is known to be a word character.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: White space, without brackets, for use in a class.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
S = f"[{SPACE}]"


def translate_pattern(pattern: str, *, ignore_case: bool = False) -> str:
    r"""A pattern written with ``\b`` and ``\s`` (outside classes) in Java's terms."""
    out = pattern.replace(r"\b", EDGE).replace(r"\s", S)
    return f"(?iu){out}" if ignore_case else out


def matches(text: Column, pattern: str) -> Column:
    """Array of whole matches, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column], *, hint: str | None = None) -> Column:
    """Replace every match by ``change(match)``: the gaps between matches zipped with the changed matches.

    ``hint`` is a cheap pattern that stands in every text with a match; other texts are left as they are without a look at ``pattern``.
    """
    def changed(t: Column) -> Column:
        found = F.concat(matches(t, pattern), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda g, m: F.concat(g, F.when(m == "", F.lit("")).otherwise(change(m)))), "")

    return bind(text, lambda t: F.when(t.rlike(hint), changed(t)).otherwise(t) if hint else changed(t))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def quote(text: Column) -> Column:
    """A pattern that matches ``text`` itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")
