"""Names in texts by position: keys of neighbouring words that an equality join finds names by, and the names' replacement.

A canonical name (``pii.normalize_name``) stands in a text where its parts, in their order or all reversed, follow each other with
an optional comma and white space between, whatever their case and accents, composed or combining, and where word boundaries
enclose them. As in the patterns of ECMAScript the Spanish accented letters do not count as parts of words there, so a name that
begins or ends in one of them, composed, is missed at that end unless a letter stands beside it. One that begins with an apostrophe is
found where a letter follows.

All functions take a text of any length in one pass; a name's occurrences are looked up by its first word.
"""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..plans.marks import in_table
from .pii import NAME_TOKEN
from .regex import SPACE
from .text import ACCENTED, PLAIN

_PLAIN = [(c, p.lower()) for c, p in zip(ACCENTED, PLAIN, strict=True) if p.isalpha()] + [(c, c.lower()) for c in string.ascii_letters]
_FOLD = str.maketrans(dict(_PLAIN))
_LETTER = f"[{''.join(c for c, _ in _PLAIN)}]"
_MARKS = re.compile("[\u0300-\u036f]")
#: Letters that are no word characters at a boundary.
OUTSIDE = "áéíóúñÁÉÍÓÚÑ"
_WORDLIKE = f"[0-9_{''.join(c for c, _ in _PLAIN if c not in OUTSIDE)}]"
_EDGE = f"(?:(?<={_WORDLIKE})(?!{_WORDLIKE})|(?<!{_WORDLIKE})(?={_WORDLIKE}))"
_IS_WORDLIKE = re.compile(_WORDLIKE).match
#: Letters of the second word that make a key, with the first word.
KEY = 5
_SECOND = rf"[',{SPACE}]+({_LETTER}{{1,{KEY + 1}}})"
# A boundary before a letter, told by the letter; in plain text that is lower case, an ASCII one.
_PAIR = re.compile(rf"(?:(?<!{_WORDLIKE})(?![{OUTSIDE}])|(?<={_WORDLIKE})(?=[{OUTSIDE}]))(?=({_LETTER}+){_SECOND})")
_PLAIN_PAIR = re.compile(rf"\b([a-z]+)(?=[',{SPACE}]+([a-z]{{1,{KEY}}}))", re.ASCII)
_START = re.compile(rf"{_EDGE}(?=({_LETTER}+))")
_GAP = re.compile(f",?[{SPACE}]+")
_WORD = re.compile("[a-z]+")


def _orders(name: str) -> list[list[str]]:
    """The parts of a canonical name in both orders; none for fewer than two."""
    parts = [p for p in name.split(" ") if p]
    return [parts, parts[::-1]] if len(parts) > 1 else []


def keys_of_name(name: str) -> set[str]:
    found = (_WORD.findall(" ".join(parts)) for parts in _orders(name))
    return {f"{w[0]} {w[1][:KEY]}" for w in found if len(w) > 1}


def keys_of_text(text: str) -> set[str]:
    """A key for each pair of neighbouring words, and where the second may end sooner, at a boundary, one more."""
    if text.isascii():
        return set(map(" ".join, _PLAIN_PAIR.findall(text.lower())))
    out = set()
    for first, second in set(_PAIR.findall(_MARKS.sub("", text))):
        if second.isascii():
            key = f"{first} {second[:KEY]}"
            out.add(key.lower() if first.isascii() else key.translate(_FOLD))
            continue
        ends = [j for j in range(1, min(KEY, len(second))) if (second[j - 1] in OUTSIDE) != (second[j] in OUTSIDE)]
        out.update(f"{first} {second[:j]}".translate(_FOLD) for j in [*ends, KEY])
    return out


def hashes_of_keys(keys: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64)


@F.pandas_udf(ArrayType(LongType()))
def name_hashes(name: pd.Series) -> pd.Series:
    """Hashes of the keys that a canonical name is found by."""
    return name.map(lambda n: hashes_of_keys(sorted(keys_of_name(n))).view(np.int64))


def text_hashes(table: Broadcast):
    """A function of an array of texts: the hashes of their keys that may be those of names, by a table of bits."""

    @F.pandas_udf(ArrayType(LongType()))
    def found(parts: pd.Series) -> pd.Series:
        def of(texts):
            if texts is None:
                return None
            values = hashes_of_keys(set().union(*(keys_of_text(t) for t in texts if t is not None)))
            return values[in_table(table.value, values)].view(np.int64)

        return parts.map(of)

    return found


def _end_of(parts: list[str], folded: str, at: int) -> int | None:
    """Where a name of these parts that begins at ``at`` ends."""
    for i, part in enumerate(parts):
        if i:
            gap = _GAP.match(folded, at)
            if gap is None:
                return None
            at = gap.end()
        if not folded.startswith(part, at):
            return None
        at += len(part)
    return at


def replace_names(text: str, names: Iterable[str], token: str = NAME_TOKEN) -> str:
    """``text`` with a token in place of each of ``names``, one name after the other: an earlier one's places are gone for later ones."""
    wanted = [(order, _WORD.search(" ".join(order))) for name in names for order in _orders(name)]
    firsts = {m[0] for _, m in wanted if m}
    if not firsts:
        return text
    if text.isascii() and not any(map(text.lower().__contains__, firsts)):
        return text
    whole, at = text, range(len(text) + 1)  # where each character was before combining marks were left out
    if _MARKS.search(text):
        at = [i for i, c in enumerate(text) if not "\u0300" <= c <= "\u036f"] + [len(text)]
        text = _MARKS.sub("", text)
    folded, starts = text.translate(_FOLD), {}
    for m in _START.finditer(text):
        word = m[1].translate(_FOLD)
        if word in firsts:
            starts.setdefault(word, []).append(m.start())
    begins, ends = [], {}  # of places taken, and the end of each

    def is_word(i: int) -> bool:
        return 0 <= i < len(text) and _IS_WORDLIKE(text[i]) is not None

    def edge(i: int) -> bool:
        """Whether a boundary is at ``i`` when tokens, which begin and end in brackets, stand in the places taken."""
        k = bisect.bisect_left(begins, i)
        before = is_word(i - 1) and not (k and ends[begins[k - 1]] == i)
        after = is_word(i) and not (k < len(begins) and begins[k] == i)
        return before != after

    def is_free(i: int, j: int) -> bool:
        k = bisect.bisect_left(begins, j)
        return not k or ends[begins[k - 1]] <= i

    for k in range(0, len(wanted), 2):  # both orders of a name
        places = sorted((p - m.start(), n) for n, (_, m) in enumerate(wanted[k : k + 2]) if m for p in starts.get(m[0], ()))
        upto = 0
        for begin, n in places:
            if begin < upto or not edge(begin):
                continue
            end = _end_of(wanted[k + n][0], folded, begin)
            if end is not None and is_free(begin, end) and edge(end):
                bisect.insort(begins, begin)
                ends[begin] = upto = end
    out, last = [], 0
    for b in begins:
        out += (whole[last : at[b]], token)
        last = at[ends[b]]
    return "".join([*out, whole[last:]])


@F.pandas_udf(ArrayType(StringType()))
def replace_names_in_parts(parts: pd.Series, names: pd.Series, markup: pd.Series) -> pd.Series:
    """Parts of texts with names replaced; with markup, parts that are tags stay. Null where parts are."""
    return pd.Series([None if p is None else [t if m and t.startswith("<") else replace_names(t, n) for t in p] for p, n, m in zip(parts, names, markup, strict=True)])
