"""Direct identifiers: patterns, keys and the rewrites that need no dictionary."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import BEGIN, EDGE, END, SPACE, S, matches, rewrite, translate_pattern, trim
from .text import fold_accents

# Shapes of identifiers. A match of CEDULA counts only with 7 or 8 digits, but is consumed either way.
EMAIL = f"{EDGE}[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}{END}"
CEDULA = f"{BEGIN}(?:\\d{{1,3}}(?:\\.\\d{{3}}){{1,2}}[-/]?\\d?|\\d{{7,8}}[-/]?\\d?){EDGE}"
_GAP = f"[{SPACE}.\\-]?"
PHONE = f"\\+598{_GAP}\\d{{1,2}}{_GAP}\\d{{3}}{_GAP}\\d{{3,4}}{END}|{BEGIN}09\\d{_GAP}\\d{{3}}{_GAP}\\d{{3}}{END}|{BEGIN}(?:2|4)\\d{{3}}{_GAP}\\d{{4}}{END}"
#: Cheap patterns that stand in every text with a match of the ones above.
EMAIL_HINT, CEDULA_HINT, PHONE_HINT = "@", r"\d(?:\d{6}|\.\d{3})", f"09\\d|\\+598|[24]\\d{{3}}{_GAP}\\d{{4}}"
REDACTED = f"^{S}*(?:\\[[A-Z_0-9]+\\]|\\*+|[Xx]+|[-—]+|N/?A|n/?a)?{S}*$"
ID_TOKEN, NATIONAL_ID_TOKEN, NAME_TOKEN = "[ID]", "[CI]", "[PACIENTE]"
# Tokens that a manifest lists; header identifiers are replaced by ID_TOKEN, which it does not list.
LISTED_TOKENS = ("[PACIENTE]", "[CI]", "[TEL_N]", "[EMAIL_N]")
TOKENS = (*LISTED_TOKENS, ID_TOKEN)


def email_key(match: Column) -> Column:
    return F.lower(match)


def phone_key(match: Column) -> Column:
    return F.regexp_replace(match, r"[^\d+]", "")


def is_national_id(match: Column) -> Column:
    return F.length(F.regexp_replace(match, r"\D", "")).between(7, 8)


def rewrite_national_ids(text: Column) -> Column:
    return rewrite(text, CEDULA, lambda m: F.when(is_national_id(m), NATIONAL_ID_TOKEN).otherwise(m), hint=CEDULA_HINT)


def count_national_ids(text: Column) -> Column:
    count = F.size(F.filter(matches(text, CEDULA), is_national_id)).cast("long")
    return F.when(text.rlike(CEDULA_HINT), count).when(text.isNotNull(), F.lit(0).cast("long"))


def is_redacted(value: Column) -> Column:
    """Whether a value is a token, a row of stars, crosses or dashes, "not available", or empty."""
    return value.rlike(REDACTED)


# --- identifier in a header row ---------------------------------------------------------------------------------------------

# The label cell and the value cell that a header row is known by.
_CLASS = "[^>]*class\\s*=\\s*[\"'][^\"']*\\b{0}\\b[^\"']*[\"'][^>]*"
HEADER_ID = translate_pattern(
    r"<td\b[^>]*>\s*(?:<span\b" + _CLASS.format("td_label") + r">\s*)?Documento\s*(?:</span\s*>)?\s*</td\s*>\s*<td\b(" + _CLASS.format("td_header_role_value") + r")>\s*([^<]*?)\s*</td\s*>",
    ignore_case=True,
)


def rewrite_header_id(html: Column) -> Column:
    """Put a token in the cell after a cell that says ``Documento``; the label cell gets its usual form."""
    def change(m: Column) -> Column:
        cells = F.concat(F.lit('<td class="td_header_role_name"><span class="td_label">Documento</span></td><td'), F.regexp_extract(m, HEADER_ID, 1), F.lit(f">{ID_TOKEN}</td>"))
        return F.when(is_redacted(F.regexp_extract(m, HEADER_ID, 2)), m).otherwise(cells)

    return rewrite(html, HEADER_ID, change, hint="(?iu)documento")


# --- names -------------------------------------------------------------------------------------------------------------------


# What is taken out of a page before its labels are read, in this order, and what is put in its place.
READABLE = (
    (translate_pattern(r"<script\b[^>]*>(?s:.*?)</script\s*>", ignore_case=True), " "),
    (translate_pattern(r"<style\b[^>]*>(?s:.*?)</style\s*>", ignore_case=True), " "),
    (translate_pattern("<pre\\b[^>]*id\\s*=\\s*[\"']?b64[^>]*>(?s:.*?)</pre\\s*>", ignore_case=True), " "),
    (translate_pattern(r"</td\s*>\s*<td\b[^>]*>", ignore_case=True), ": "),
    (translate_pattern(r"</tr\s*>", ignore_case=True), "\n"),
    (translate_pattern(r"<br\s*/?\s*>", ignore_case=True), "\n"),
    ("<[^>]+>", " "),
    ("(?i)&nbsp;", " "),
    ("[ \\t]+", " "),
    (f"{S}*\\n{S}*", "\n"),
)
# Labels that a name follows, and labels that end it.
NAME_LABELS = ("paciente", r"nombre(?:\s+del\s+paciente)?", r"apellidos?\s+y\s+nombres?")
STOP_LABELS = ("prestador", "profesional", "c[eé]dula", "ci", "documento", "dni", "tel[eé]fono", "tel", "email", "correo", "fecha", r"nombre\s+del\s+prestador", r"nombre\s+del\s+profesional")
NAME_HINT = "(?iu)paciente|nombre"


def _name_after_label(ends: str, before_end: str) -> str:
    """Pattern of a label and, in its group, the name: up to one of the characters ``ends``, a label that ends it, or the end."""
    label, stop = "|".join(NAME_LABELS), "|".join(STOP_LABELS)
    return translate_pattern(rf"\b(?:{label})\s*[:\-]\s*([^{ends}]+?)(?=\s+(?:{stop})\s*[:\-]|{before_end}[{ends}]|\z)", ignore_case=True)


NAME_LABEL = _name_after_label(r"\n\r,;|", "")
#: As above, and an opening bracket ends a name too.
NAME_LABEL_STRICT = _name_after_label(r"\n\r,;|(", r"\s*")


def readable_text(html: Column) -> Column:
    """Text of a page for reading labels: cells joined by a colon, rows and breaks by a line end, tags dropped."""
    return trim(functools.reduce(lambda out, step: F.regexp_replace(out, *step), READABLE, html))


def name_parts(name: Column) -> Column:
    """Parts of two letters or more of a name in plain lower case."""
    letters = F.regexp_replace(F.lower(fold_accents(name)), f"[^a-z{SPACE}']", " ")
    return F.filter(F.split(trim(F.regexp_replace(letters, f"{S}+", " ")), " "), lambda p: F.length(p) >= 2)


def normalize_name(name: Column) -> Column:
    """Canonical form of a name, or "" for what is no full name: two parts, and two of three letters or more."""
    parts = name_parts(name)
    full = (F.size(parts) >= 2) & (F.size(F.filter(parts, lambda p: F.length(p) >= 3)) >= 2)
    return F.when(full, F.array_join(parts, " ")).otherwise("")


def extract_names(html: Column, *, strict: bool = False) -> Column:
    """Canonical names after a name label, without repeats, in order; no look is taken at texts without the words of a label."""
    raw = F.regexp_extract_all(readable_text(html), F.lit(NAME_LABEL_STRICT if strict else NAME_LABEL), F.lit(1))
    names = F.array_distinct(F.filter(F.transform(raw, lambda r: normalize_name(trim(r))), lambda n: n != ""))
    return F.when(html.rlike(NAME_HINT), names).when(html.isNotNull(), F.array().cast("array<string>"))
