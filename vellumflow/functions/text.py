"""Scalar text functions: accents, slugs, file names, formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _accent_table() -> tuple[str, str]:
    """Characters that decompose to one ASCII character and marks of U+0300 to U+036F, or to it alone, and those ASCII characters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0x80, 0xD800), *range(0xE000, 0x110000))]
    found = [(a, b[0]) for a, b in found if b[0].isascii() and all("\u0300" <= m <= "\u036f" for m in b[1:])]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _accent_table()
MARKS = "[\\u0300-\\u036F]"


def fold_accents(text: Column) -> Column:
    """Drop accents of Latin letters, composed or combining; runs in the JVM."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), MARKS, "")


@F.pandas_udf(StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """Canonical decomposition without U+0300 to U+036F, for any script; slower than ``fold_accents``."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))


def slugify(text: Column, *, most: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens, cut after trimming, so a cut may leave a hyphen at the end."""
    words = F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, most)


def event_base_name(date: Column, category: Column, description: Column) -> Column:
    """Date, category and description as one name; a missing description has a fixed slug, an empty part is left out."""
    parts = F.array(date, slugify(category), slugify(F.coalesce(description, F.lit("sin-descripcion"))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "_")


def archive_name(owner: Column, at: Column, *, prefix: str = "export", fallback: str = "paciente") -> Column:
    """Name of an archive: prefix, owner's slug, local date and time of the session's zone."""
    slug = slugify(owner)
    return F.concat(F.lit(f"{prefix}_"), F.when(F.coalesce(slug, F.lit("")) == "", fallback).otherwise(slug), F.lit("_"), F.date_format(at, "yyyy-MM-dd_HHmm"), F.lit(".zip"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks, whatever the session says about chunks."""
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def base64_bytes(text: Column) -> Column:
    """Bytes of a base64 text with white space allowed; null where it is malformed."""
    return F.try_to_binary(F.regexp_replace(text, "[\\s\\u00A0]+", ""), F.lit("base64"))


def iso_instant(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _in_units(size: Column, unit: int, digits: int, half_even: bool) -> Column:
    """``size`` in units of ``2**unit`` with ``digits`` decimals, rounded on whole numbers."""
    scale, half = 10**digits, 1 << unit - 1
    parts = size.bitwiseAND((1 << unit) - 1) * scale
    cut, rest = F.shiftright(parts, unit), parts.bitwiseAND((1 << unit) - 1)
    up = (rest > half) | ((rest == half) & (cut % 2 == 1 if half_even else F.lit(True)))
    decimals = cut + up.cast("long")
    carry = (decimals == scale).cast("long")
    return F.format_string(f"%d.%0{digits}d", F.shiftright(size, unit) + carry, decimals - carry * scale)


def format_bytes(size: Column, *, half_even: bool = False) -> Column:
    """Bytes, KiB with one decimal or MiB with two. Halves, which are exact here, round up, or with ``half_even`` to the even digit, as C's printf does."""
    size = size.cast("long")
    kib, mib = _in_units(size, 10, 1, half_even), _in_units(size, 20, 2, half_even)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(kib, F.lit(" KiB"))).otherwise(F.concat(mib, F.lit(" MiB")))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, half up, at most 100, and 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(F.lit(100.0) * done / total + 0.5))).otherwise(0).cast("long")


def backoff_ms(attempt: Column, *, first: int = 1000, most: int = 16000) -> Column:
    """Delay before the retry after attempt 0, 1, ...: doubling up to a limit."""
    return F.least(F.lit(most).cast("long"), (F.lit(first) * F.pow(F.lit(2.0), attempt)).cast("long"))


#: States of a run and what the overlay and the panel call them.
OVERLAY_LABELS = {
    "idle": "En espera",
    "discovering": "Descubriendo eventos…",
    "running": "Extrayendo…",
    "paused": "Pausado",
    "cancelled": "Cancelado",
    "completed": "Completado",
    "error": "Error",
}
PANEL_LABELS = OVERLAY_LABELS | {"discovering": "Descubriendo…", "running": "Extrayendo"}


def state_label(state: Column, labels: dict[str, str] = OVERLAY_LABELS) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), state)


def polling_ends(state: Column) -> Column:
    return state.isin("completed", "cancelled", "error", "idle")


def is_busy(state: Column) -> Column:
    return state.isin("running", "discovering", "paused")


def can_download(state: Column, processed: Column) -> Column:
    return (processed > 0) | (state == "completed")


def missing_count(expected: Column, captured: Column, failed: Column) -> Column:
    """Records that were announced and neither captured nor failed; null where the counts agree."""
    return F.when((expected > 0) & (captured + failed < expected), expected - captured - failed)
