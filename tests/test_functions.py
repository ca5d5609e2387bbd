"""Literal cases of the column functions."""

import base64
import re
import string
import unicodedata
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import html as H
from vellumflow.functions import names, pdf, pii
from vellumflow.functions import regex as R
from vellumflow.functions import text as T
from vellumflow.functions import timeline as L


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rewrite_keeps_gaps_and_matches(spark):
    got = values(spark, ["a1b22c", "", "33", "none", None], lambda x: R.rewrite(x, r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))))
    assert got == ["a<1>b<22>c", "", "<33>", "none", None]


def test_word_edges_are_ascii(spark):
    assert values(spark, ["1234567ñ", "x1234567"], lambda x: F.size(R.matches(x, pii.CEDULA))) == [1, 0]


@pytest.mark.parametrize(("text", "n"), [("juan.perez@example.com.uy", 1), ("maria+test@example.com", 1), ("foo@bar", 0), ("", 0)])
def test_email(spark, text, n):
    assert values(spark, [text], lambda x: F.size(R.matches(x, pii.EMAIL))) == [n]


def test_national_ids(spark):
    rows = ["1.234.567-8", "12345678", "1234567", "1.234.567/8", "123456789", "193.195.198-5", "13.149.130", "a 1.234.567 b 12"]
    assert values(spark, rows, pii.rewrite_national_ids) == ["[CI]", "[CI]", "[CI]", "[CI]", "123456789", "193.195.198-5", "[CI]", "a [CI] b 12"]
    assert values(spark, rows, pii.count_national_ids) == [1, 1, 1, 1, 0, 0, 1, 1]


def test_phones(spark):
    rows = ["099 123 456", "099123456", "2487 1234", "4332 5566", "+598 99 123 456", "ref 12345", "2026-04-20", "2024-2025"]
    assert values(spark, rows, lambda x: F.size(R.matches(x, pii.PHONE))) == [1, 1, 1, 1, 1, 0, 0, 1]


def test_redacted(spark):
    rows = ["[ID]", "", "***", "XXX", "---", "N/A", "n/a", "133199101", "AB-12345", "X1"]
    assert values(spark, rows, pii.is_redacted) == [True] * 7 + [False] * 3


def test_header_id(spark):
    def row(value, name="Documento"):
        return f'<tr><td><span class="td_label">{name}</span></td>\n<td class="td_header_role_value" x="1">{value}</td></tr>'

    got = values(spark, [row("133199101"), row("***"), row(""), row("123", "Nombre")], pii.rewrite_header_id)
    assert ">[ID]</td>" in got[0] and 'x="1"' in got[0] and "133199101" not in got[0]
    assert got[1:] == [row("***"), row(""), row("123", "Nombre")]


def test_normalize_name(spark):
    rows = ["Juan", "Juán Pérez", "PÉREZ,  JUAN", "de la", "Juan de la Rosa", "", "  J. P. Ana  Gómez"]
    assert values(spark, rows, pii.normalize_name) == ["", "juan perez", "perez juan", "", "juan de la rosa", "", "ana gomez"]


def plain_replace(text, names):
    """Names replaced by a pattern each, one after the other."""
    for name in names:
        both = {c: "".join(x for x in LETTERS if PLAIN[x] == c) for c in set(PLAIN.values())}
        parts = ["".join(f"[{both[c]}]" if c in both else re.escape(c) for c in p) for p in name.split(" ")]
        if len(parts) > 1:
            gap = f",?[{R.SPACE}]+"
            text = re.sub(rf"{EDGE}(?:{gap.join(parts)}|{gap.join(parts[::-1])}){EDGE}", "[PACIENTE]", text)
    return text


LETTERS = string.ascii_letters + "".join(c for c in T.ACCENTED if unicodedata.normalize("NFD", c)[0].isalpha())
PLAIN = {c: unicodedata.normalize("NFD", c)[0].lower() for c in LETTERS}
WORD = "[0-9_" + "".join(c for c in LETTERS if c not in "áéíóúñÁÉÍÓÚÑ") + "]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def test_replace_names():
    assert all(names.replace_names(t, ["juan perez"]) == "[PACIENTE] x" for t in ("JUAN PEREZ x", "Perez Juan x", "Juán Pérez x", "Pérez,  Juan x", "Jua\u0301n Pe\u0301rez x"))
    for text in ("juanperezoso", "juan perezoso", "xjuan perez", "juan-perez", "juan  \n, perez", "juan", ""):
        assert names.replace_names(text, ["juan perez", "solo", ""]) == text
    for form in ("NFC", "NFD"):
        assert names.replace_names(unicodedata.normalize(form, "Nguyễn Thị; Thị, Nguyễn."), ["nguyen thi"]) == "[PACIENTE]; [PACIENTE]."
    composed = unicodedata.normalize("NFC", "Juan José, Ángel Pérez")
    assert names.replace_names(composed, ["juan jose", "angel perez"]) == composed  # as in the patterns that it stands for
    assert names.replace_names(unicodedata.normalize("NFD", "Juan José, y"), ["juan jose"]) == "[PACIENTE], y"
    long = "juan, " * 50_000
    assert names.replace_names(long + "perez", ["juan perez"]) == long[:-6] + "[PACIENTE]"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["ana", "Ana", "ANÁ", "á", "gomez", "Gómez", "gomeza", "o'neil", "O'Neil", "de", "sosa", "x1", "_", "é", "’", "'", ","]), max_size=14), st.lists(st.sampled_from([" ", " ", ", ", "  ", "\n", "", ",", "-", " "]), min_size=14, max_size=14), st.lists(st.sampled_from(["ana gomez", "gomez ana", "ana de sosa", "sosa ana", "o'neil ana", "ana o'neil", "gomez sosa ana", "ana ana", "de ana"]), max_size=4))
def test_replace_names_like_patterns(words, gaps, which):
    text = "".join(w + g for w, g in zip(words, gaps, strict=False))
    assert names.replace_names(text, which) == plain_replace(text, which)
    hit = {n for n in which if plain_replace(text, [n]) != text}
    keys = names.keys_of_text(text)
    assert all(keys & names.keys_of_name(n) for n in hit)  # every name that occurs is found by a key


def test_accents_of_all_letters(spark):
    """Slugs and names fold whatever canonical decomposition folds."""
    chars = [chr(c) for c in (*range(0x20, 0xD800), *range(0xF900, 0x10000), *range(0x1D100, 0x1D200)) if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = ["a" + "b".join(chars[i : i + 20]) + "c" for i in range(0, len(chars), 20)]

    def slug(t):
        plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t)).lower()
        return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", plain))[:80]

    assert values(spark, rows, T.slugify) == [slug(t) for t in rows]
    assert values(spark, ["Nguyễn Thị", "NGUYỄN Thị"], T.slugify) == ["nguyen-thi"] * 2
    assert values(spark, ["Nguyễn Thị", "Đặng Văn Lâm"], pii.normalize_name) == ["nguyen thi", "ang van lam"]


def test_extract_names(spark):
    rows = [
        "<p><strong>Paciente:</strong> Juan Pérez</p>",
        '<pre id="b64">Paciente: Ana Gómez</pre>',
        "<table><tr><td>Nombre</td><td>Ana Gómez</td></tr><tr><td>Edad</td><td>40</td></tr></table>",
        "Paciente: Juan Pérez Prestador: Otro Nombre",
        "nada",
        "Paciente: Juan Pérez (CI: 1.234.567-8)",
    ]
    assert values(spark, rows, pii.extract_names) == [["juan perez"], [], ["ana gomez"], ["juan perez"], [], ["juan perez ci"]]
    assert values(spark, rows[-1:], lambda x: pii.extract_names(x, strict=True)) == [["juan perez"]]


def test_slugify(spark):
    rows = ["Imagenología — Ecografía", "  --hola--  ", "Internación 2025/03", "", "***", "a" * 90, "ab " * 40]
    got = values(spark, rows, T.slugify)
    assert got[:5] == ["imagenologia-ecografia", "hola", "internacion-2025-03", "", ""]
    assert got[5] == "a" * 80 and len(got[6]) == 80


def test_accents_agree_with_decomposition(spark):
    rows = ["Ñandú àéîõü ŠŽç", "café", None]
    assert values(spark, rows, T.fold_accents) == values(spark, rows, T.strip_marks) == ["Nandu aeiou SZc", "cafe", None]


def test_formats(spark):
    assert values(spark, [0, 1023, 1024, 1536, 1048576, 5000000], T.format_bytes, "long") == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.00 MiB", "4.77 MiB"]
    # Halves: up, and to the even digit as C's printf, which the query's SQL calls. 1.125 and 1.375 MiB, 1.25 and 1.75 KiB.
    halves = [1179648, 1441792, 1280, 1792, 1023 * 1024 + 1000]
    assert values(spark, halves, T.format_bytes, "long") == ["1.13 MiB", "1.38 MiB", "1.3 KiB", "1.8 KiB", "1024.0 KiB"]
    assert values(spark, halves, lambda c: T.format_bytes(c, half_even=True), "long") == ["1.12 MiB", "1.38 MiB", "1.2 KiB", "1.8 KiB", "1024.0 KiB"]
    assert values(spark, [2**62 + 2**19], T.format_bytes, "long") == ["4398046511104.50 MiB"]
    assert values(spark, [0, 1, 2, 3, 4, 9], T.backoff_ms, "long") == [1000, 2000, 4000, 8000, 16000, 16000]
    assert values(spark, [0, 1, 5, 300], lambda x: T.percent(x, F.lit(200)), "long") == [0, 1, 3, 100]


def test_base64(spark):
    long = base64.b64encode(b"x" * 200).decode()
    assert values(spark, [long[:50] + "\n " + long[50:], "!!!no-es-base64!!!"], T.base64_bytes) == [b"x" * 200, None]
    assert values(spark, [b"x" * 200], T.base64_plain, "binary") == [long]


def test_segments(spark):
    rows = ['a<b c="1">d</b>', '<script>var t="<p>";</script>x<!-- <a> -->y', '<pre id="b64">JV<x</pre>z', "<style>p{", "x<p"]
    got = values(spark, rows, H.segments)
    assert ["".join(g) for g in got] == rows
    assert got[1] == ['<script>var t="<p>";</script>', "x", "<!-- <a> -->", "y"] and got[2][0].endswith("</pre>")
    assert values(spark, ['<a href="mailto:q@e.com">q@e.com</a>'], lambda x: H.map_text(x, lambda s: F.replace(s, F.lit("q"), F.lit("Q")))) == ['<a href="mailto:q@e.com">Q@e.com</a>']


def test_charset(spark):
    rows = ["<html><head><meta charset=ISO-8859-1></head>", '<head x><meta http-equiv="Content-Type" content="text/html; charset=latin1"/>', "<HEAD><title></title>", "<p>"]
    assert values(spark, rows, H.rewrite_charset) == [
        '<html><head><meta charset="utf-8"></head>',
        '<head x><meta http-equiv="Content-Type" content="text/html; charset=utf-8">',
        '<head>\n<meta charset="utf-8"><title></title>',
        "<p>",
    ]


def test_attachment(spark):
    good = base64.b64encode(b"%PDF-1.4 " + b"a" * 100).decode()
    rows = [f'<pre id="b64">{good[:20]}\n{good[20:]}</pre>', '<pre id="b64">JVBERi0x</pre>', f"<pre id='b64'>{base64.b64encode(b'b' * 120).decode()}</pre>", "none"]
    got = values(spark, rows, H.attachment_struct)
    assert got[0]["base64"] == good and got[1:] == [None, None, None]


def test_listing_lines(spark):
    assert [tuple(v) for v in values(spark, ["Mostrando del 1 al 10 de 45 resultados", "x MOSTRANDO  del 21 al 30 de 45 resultados y"], L.total_line)] == [(1, 10, 45), (21, 30, 45)]
    assert values(spark, ["Todos los registros (45)", "Todos los registros"], L.sidebar_count) == [45, None]
    pages = values(spark, ["Mostrando del 1 al 10 de 45 resultados", "Mostrando del 41 al 45 de 45 resultados", "Mostrando del 1 al 3 de 3 resultados"], lambda x: L.pagination(L.total_line(x)))
    assert [tuple(p) for p in pages] == [(1, 5, 10), (9, 9, 5), (1, 1, 3)]
    assert values(spark, ["99/99/2024 x", "01/02/20245"], L.find_date) == ["2024-99-99", None]
    assert values(spark, ["entre nosotros", "LABORATORIO", "Siguiente"], L.find_category) == ["Otros", "Laboratorio", None]


def test_cells(spark):
    cells = [["01/02/2024", "Laboratorio", "corta", "igual!", "Médico: ", "Médico: Dra. X", "ver"]]
    assert values(spark, cells, lambda c: L.pick_description(c, F.lit("row"), F.lit("Laboratorio")), "array<string>") == ["Médico: Dra. X"]
    assert values(spark, cells, lambda c: L.labelled_cell(c, "Profesional", "Médico"), "array<string>") == ["Dra. X"]


def _pdf(pages: int) -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 595 842] >>" % (pages, b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(pages)))]
    for i in range(pages):
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 99 0 R >> >> >>" % (4 + 2 * i), b"<< /Length 20 >>\nstream\nBT (secreto %d) Tj ET\nendstream" % i]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + o + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


@pytest.mark.parametrize("pages", [1, 3, 7])
def test_pdf_cover(pages):
    data = _pdf(pages)
    new, reason = pdf.cover_header(data)
    assert reason is None and new.startswith(data) and new.count(b"0 710 595 70 re f") == pages
    assert len(covered_pages(new)) == pages
    assert pdf.cover_header(new)[1] is None


def covered_pages(data):
    """Bodies of covered pages, by a chain that holds."""
    file = pdf._File(data)
    assert not file.broken
    bodies = [file.get(n)[1] for n, p in file.places.items() if p[0] != "free"]
    return [b for b in bodies if b"/Type /Page " in b and b"/VfLabel" in b and b"/F1 99 0 R" in b]


def _pdf_of_streams(objects, packed, *, predictor=False, before=None, base=b"%PDF-1.5\n"):
    """A file, or an update to one, whose cross-references are a stream; ``packed`` objects lie in an object stream."""
    out, rows = bytearray(base), {0: (0, 0, 65535)}
    size = max([*objects, *packed]) + 1
    if packed:
        bodies, heads, at = b"", b"", 0
        for k, (n, body) in enumerate(packed.items()):
            heads, bodies, rows[n] = heads + b"%d %d " % (n, len(bodies)), bodies + body + b" ", (2, size, k)
        raw = zlib.compress(heads + bodies)
        rows[size] = (1, len(out), 0)
        out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (size, len(packed), len(heads), len(raw)) + raw + b"\nendstream\nendobj\n"
        size += 1
    for n, body in objects.items():
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    rows[size] = (1, at, 0)
    lines = [b"%c" % k + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, (k, a, b) in sorted(rows.items())]
    if predictor:  # each line as its difference from the one above
        lines = [b"\2" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)) for line, above in zip(lines, [bytes(7), *lines], strict=False)]
    raw = zlib.compress(b"".join(lines))
    parms = b" /DecodeParms << /Predictor 12 /Columns 7 >>" if predictor else b""
    prev = b" /Prev %d" % before if before is not None else b""
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Index [%b] /Root 1 0 R /Filter /FlateDecode%b%b /Length %d >>\nstream\n" % (size, size + 1, index, parms, prev, len(raw)) + raw + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


DECOY = b"BT (x) Tj ET\n3 0 obj\n<< /Type /Font >>\nendobj\ntrailer\n<< /Root 3 0 R /Encrypt 3 0 R >>\n(endobj) startxref"
PAGE = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /MediaBox [0 0 300 400] /Resources << /Font << /F1 99 0 R >> >> /Title (a >> \\) endobj ] b) >>"
TREE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 3: PAGE}
CONTENT = {4: b"<< /Length %d >>\nstream\n" % len(DECOY) + DECOY + b"\nendstream"}


@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_pdf_with_streams_of_references(packed, predictor):
    data = _pdf_of_streams(CONTENT if packed else TREE | CONTENT, TREE if packed else {}, predictor=predictor)
    new, reason = pdf.cover_header(data)
    assert reason is None and new.startswith(data) and b"\nxref" not in new[len(data) :] and b"/Type /XRef" in new[len(data) :] and b"/Prev" in new[len(data) :]
    (page,) = covered_pages(new)
    assert b"/MediaBox [0 0 300 400]" in page and b" 4 0 R " in page and b"/Font << /F1 99 0 R /VfLabel" in b" ".join(page.split())
    again, reason = pdf.cover_header(new)
    assert reason is None and len(covered_pages(again)) == 1
    # An update to the file wins over what it replaces, wherever the older object is found.
    moved = _pdf_of_streams({3: PAGE.replace(b"300 400", b"500 600")}, {}, before=int(re.findall(rb"startxref\s+(\d+)", data)[-1]), base=data)
    (page,) = covered_pages(pdf.cover_header(moved)[0])
    assert b"[0 0 500 600]" in page


def test_pdf_whose_stream_holds_the_text_of_objects():
    for pages in (1, 2):
        plain = _pdf(pages)
        data = plain.replace(b"BT (secreto 0) Tj ET", b"3 0 obj <<>> endobj ")  # as long as before
        assert len(data) == len(plain) and data != plain
        new, reason = pdf.cover_header(data)
        assert reason is None and len(covered_pages(new)) == pages
        for lost in (data.replace(b"xref\n0", b"xrex\n0"), re.sub(rb"startxref\n\d+", b"startxref\n0", data), data.replace(b"%PDF-1.4\n", b"%PDF-1.4\n%moved\n")):
            new, reason = pdf.cover_header(lost)  # read object by object, and mended
            assert reason is None and new.startswith(lost) and len(covered_pages(new)) == pages
    packed = _pdf_of_streams(CONTENT, TREE)
    new, reason = pdf.cover_header(re.sub(rb"startxref\n\d+", b"startxref\n7", packed))
    assert reason is None and len(covered_pages(new)) == 1
    assert pdf.cover_header(re.sub(rb"startxref\n\d+", b"", data))[1]


def test_pdf_refusals(spark):
    assert pdf.cover_header(b"hola")[1] and pdf.cover_header(b"%PDF-1.4 x")[1]
    assert "cifrado" in pdf.cover_header(_pdf(1).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))[1]
    assert "páginas" in pdf.cover_header(_pdf(0))[1]
    got = values(spark, [_pdf(2), b"hola", None], pdf.redact_pdf, "binary")
    assert [r["ok"] for r in got] == [True, False, False] and bytes(got[1]["data"]) == b"hola" and got[2]["reason"]
