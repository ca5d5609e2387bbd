"""HTML as a string: segments of tags and text, character set, embedded attachments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import S, translate_pattern, trim
from .text import base64_bytes, base64_plain

#: Raw zones whole, other tags, and runs of text. A zone without its end reaches to the end; so does a tag.
SEGMENT = (
    r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<pre.{0,53}?id\s*=\s*[\x22\x27]?b64.*?(?:</pre>|\z)"
    r"|<!-->|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)|[^<]+"
)


def segments(html: Column) -> Column:
    """All of the text cut into tags, raw zones and text between them, nothing lost."""
    return F.regexp_extract_all(html, F.lit(SEGMENT), F.lit(0))


def is_text(segment: Column) -> Column:
    return ~segment.startswith("<")


def map_text(html: Column, change: Callable[[Column], Column]) -> Column:
    """Change text outside tags and raw zones."""
    return F.array_join(F.transform(segments(html), lambda s: F.when(is_text(s), change(s)).otherwise(s)), "")


def zone(segment: Column) -> Column:
    """Kind of a segment: script, style, attachment, comment, tag or text."""
    low = F.lower(F.substring(segment, 1, 60))
    return (
        F.when(is_text(segment), "text")
        .when(low.startswith("<script"), "script")
        .when(low.startswith("<style"), "style")
        .when(low.startswith("<pre") & low.rlike(r"id\s*=\s*[\x22\x27]?b64"), "attachment")
        .when(low.startswith("<!--"), "comment")
        .otherwise("tag")
    )


def attribute_names(html: Column) -> Column:
    """Distinct attribute names in start tags, sorted."""
    tags = F.filter(segments(html), lambda s: s.rlike("^<[A-Za-z]"))
    names = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"\s([A-Za-z][A-Za-z0-9_-]*)="), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: F.lower(n))))


def diagnostics(html: Column) -> list[Column]:
    """What a page holds when no record was found in it: counts by kind of element, attribute names, first rows and anchors.

    Of the first three rows 600 characters and 200 of their text, of the first ten anchors 120 and 80 of their text.
    """
    def count(tag: str) -> Column:
        return F.regexp_count(html, F.lit(f"(?i)<{tag}[ >]")).cast("long").alias(f"n_{tag}")

    def samples(tag: str, most: int, long: int, short: int) -> tuple[Column, Column]:
        found = F.slice(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[ >].*?</{tag}>"), F.lit(0)), 1, most)
        plain = F.transform(found, lambda x: F.substring(trim(F.regexp_replace(x, "<[^>]*>", "")), 1, short))
        return F.transform(found, lambda x: F.substring(x, 1, long)), plain

    rows, row_texts = samples("tr", 3, 600, 200)
    anchors, anchor_texts = samples("a", 10, 120, 80)
    joined = ((rows, "rows"), (row_texts, "row_texts"), (anchors, "anchors"), (anchor_texts, "anchor_texts"))
    kept = F.size(rows).cast("long").alias("row_samples")
    return [*map(count, ("a", "tr", "iframe", "form", "li")), F.array_join(attribute_names(html), " ").alias("attributes"), kept, *(F.array_join(x, "\n").alias(n) for x, n in joined)]


_META = translate_pattern("<meta\\s+charset\\s*=\\s*[\"']?[^\"'>\\s]+[\"']?\\s*/?>".replace("[^\"'>\\s]", "[^\"'>" + S[1:-1] + "]"), ignore_case=True)
_META_HTTP = translate_pattern("<meta\\s+http-equiv\\s*=\\s*(?:\"content-type\"|'content-type'|content-type)\\s+content\\s*=\\s*(?:\"[^\"']*\"|'[^\"']*')\\s*/?>", ignore_case=True)
_SAYS_UTF8 = translate_pattern("charset\\s*=\\s*[\"']?utf-?8", ignore_case=True)


def rewrite_charset(html: Column) -> Column:
    """Make a page say that it is UTF-8: its own declaration changed, or one put in the head."""
    out = F.regexp_replace(html, _META, '<meta charset="utf-8">')
    out = F.regexp_replace(out, _META_HTTP, '<meta http-equiv="Content-Type" content="text/html; charset=utf-8">')
    added = F.regexp_replace(out, "(?is)^(.*?)<head(" + translate_pattern(r"\b") + "[^>]*)>", '$1<head$2>\n<meta charset="utf-8">')
    return F.when(out.rlike(_SAYS_UTF8), out).otherwise(added)


def serialize_document(doctype: Column, root: Column) -> Column:
    """Document type, or that of HTML, a line end and the root element with its character set rewritten."""
    return F.concat(F.coalesce(doctype, F.lit("<!DOCTYPE html>")), F.lit("\n"), rewrite_charset(root))


def attachment_bytes(html: Column) -> Column:
    """Bytes of the PDF in ``<pre id="b64">``; null if short, malformed or of another kind."""
    raw = F.regexp_replace(F.regexp_extract(html, r"(?is)<pre\b[^>]*\bid\s*=\s*[\x22\x27]?b64\b[^>]*>(.*?)</pre\s*>", 1), f"{S}+", "")
    data = base64_bytes(F.when(F.length(raw) >= 100, raw))
    return F.when((F.octet_length(data) >= 5) & (F.hex(F.substring(data, 1, 4)) == "25504446"), data)


def attachment_struct(html: Column) -> Column:
    """Base64 (normalised), kind and hash of the attachment, or null."""
    data = attachment_bytes(html)
    return F.when(data.isNotNull(), F.struct(base64_plain(data).alias("base64"), F.lit("application/pdf").alias("mime"), F.sha2(data, 256).alias("sha256")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def attachment_page(doc_id: Column, category: Column, date: Column, sha256: Column, description: Column, provider: Column, professional: Column) -> Column:
    """A page that stands for an attached PDF: what is known about the record and a link to the file."""
    def row(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<dt>{label}</dt><dd>"), escape_html(value), F.lit("</dd>\n"))).otherwise("")

    title = F.concat(escape_html(category), F.lit(" — "), escape_html(date))
    file = F.concat(doc_id, F.lit(".pdf"))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="es">\n<head><meta charset="utf-8"><title>'), title, F.lit("</title></head>\n<body>\n<h1>"), title, F.lit("</h1>\n<dl>\n"),
        row("Descripción", description), row("Prestador", provider), row("Profesional", professional),
        F.lit('<dt>Archivo</dt><dd><a href="./'), file, F.lit('">'), file, F.lit("</a></dd>\n<dt>SHA-256</dt><dd><code>"), sha256,
        F.lit('</code></dd>\n</dl>\n<embed src="./'), file, F.lit('" type="application/pdf">\n</body>\n</html>'),
    )
