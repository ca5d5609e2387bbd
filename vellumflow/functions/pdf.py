"""Cover a band of every page of a PDF by an incremental update, without a PDF library.

Original bytes stay as they are; new page objects, a font and the drawing are appended with a new cross-reference section, a table
or a stream as the file has them. It is a visual cover: the text below remains in the file. Encrypted files, files without pages and
files whose pages cannot be found are left alone and a reason is given.

Objects are where the chain of cross-reference tables and streams says, newest first. A file whose chain is broken is read object
by object from its begin, over the contents of streams, and gets a new chain for all of its objects.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b64encode

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

# The band, in points from the top of a page, and what is written on it.
TOP, HEIGHT, LABEL, SIZE = 62, 70, "[DATOS PERSONALES REDACTADOS]", 7
#: Width of the label at size 1: standard widths of the bold sans-serif font for its letters, in thousandths.
_WIDTHS = {"[": 333, "]": 333, " ": 278, "A": 722, "C": 722, "D": 722, "E": 667, "L": 611, "N": 722, "O": 778, "P": 667, "R": 722, "S": 667, "T": 611}
LABEL_WIDTH = sum(_WIDTHS[c] for c in LABEL) / 1000

_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")


_HEAD, _ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,10})\s"), re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])(?![a-z])")
_STREAM = re.compile(rb"\s*stream(?:\r\n|\n|\r)")
_SKIP = re.compile(rb"[^<>()%]+|%[^\r\n]*")


def _dictionary(body: bytes, at: int = 0) -> bytes:
    """The first outermost ``<<...>>`` of a body from ``at`` on; brackets in strings and comments do not count."""
    start = at = body.find(b"<<", at)
    depth = 0
    while 0 <= at < len(body):
        two = body[at : at + 2]
        if two == b"<<":
            depth, at = depth + 1, at + 2
        elif two == b">>":
            depth, at = depth - 1, at + 2
            if not depth:
                return body[start:at]
        elif two[:1] == b"(":
            at = _string_end(body, at)
        elif m := _SKIP.match(body, at):
            at = m.end()
        else:
            at += 1
    return b""


def _string_end(body: bytes, at: int) -> int:
    """The place after a literal string that begins at ``at``."""
    depth = 0
    for m in re.compile(rb"\\.|[()]", re.S).finditer(body, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(body)


class _File:
    """Objects of a file by number, its trailer, and how its chain of cross-references is kept."""

    def __init__(self, data: bytes) -> None:
        self.data, self.bodies = data, {}
        self.places: dict[int, tuple] = {}  # number to ("at", offset, generation) or ("in", number of the object stream, place there)
        self.trailers: list[bytes] = []  # newest first
        self.is_stream = self.broken = False
        starts = re.findall(rb"startxref\s+(\d+)", data)
        self.start = int(starts[-1]) if starts else None
        if self.start is not None:
            try:
                self._follow_chain()
                self._require_pages()
            except (ValueError, IndexError, TypeError, zlib.error):
                self._read_all()

    def _follow_chain(self) -> None:
        at, seen = self.start, set()
        while at is not None:
            if at in seen:
                raise ValueError("the chain runs in a circle")
            seen.add(at)
            table = re.compile(rb"\s*xref\b").match(self.data, at)
            trailer = self._table(table.end()) if table else self._xref_stream(at)
            self.is_stream = self.is_stream or not self.trailers and not table
            self.trailers.append(trailer)
            if table and (more := _value(trailer, b"XRefStm")):
                self._xref_stream(int(more))
            at = int(before) if (before := _value(trailer, b"Prev")) else None

    def _table(self, at: int) -> bytes:
        while not re.compile(rb"\s*trailer").match(self.data, at):
            head = _HEAD.match(self.data, at)
            if not head:
                raise ValueError("no cross-reference table")
            at = head.end() - 1
            for number in range(int(head[1]), int(head[1]) + int(head[2])):
                entry = _ENTRY.match(self.data, at)
                if not entry:
                    raise ValueError("short cross-reference table")
                at = entry.end()
                self.places.setdefault(number, ("at", int(entry[1]), int(entry[2])) if entry[3] == b"n" else ("free",))
        return _dictionary(self.data, at)

    def _xref_stream(self, at: int) -> bytes:
        head = re.compile(rb"\s*\d+\s+\d+\s+obj\b").match(self.data, at)
        if not head:
            raise ValueError("no cross-reference stream")
        d = _dictionary(self.data, head.end())
        if _value(d, b"Type") != b"/XRef":
            raise ValueError("no cross-reference stream")
        raw = self._decoded(d, self.data.index(d, head.end()) + len(d))
        wide = [int(x) for x in re.findall(rb"\d+", _value(d, b"W"))]
        size = sum(wide)
        index = [int(x) for x in re.findall(rb"\d+", _value(d, b"Index") or b"")] or [0, int(_value(d, b"Size"))]
        row = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + count):
                fields, cut = [], row * size
                if cut + size > len(raw):
                    raise ValueError("short cross-reference stream")
                for w in wide:
                    fields.append(int.from_bytes(raw[cut : cut + w], "big"))
                    cut += w
                kind = fields[0] if wide[0] else 1
                self.places.setdefault(number, {1: ("at", *fields[1:3]), 2: ("in", *fields[1:3])}.get(kind, ("free",)))
                row += 1
        return d

    def _require_pages(self) -> None:
        root = self.value(self.root())
        if not root or not self.value(_value(root, b"Pages")):
            raise ValueError("no pages by the chain")

    def _read_all(self) -> None:
        """Places of objects as they follow each other; what is in streams is no object."""
        self.places, self.bodies, self.trailers, self.is_stream, self.broken = {}, {}, [], False, True
        at, heads = 0, re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b|\btrailer\b")
        inside: list[tuple[int, bytes, int]] = []
        while m := heads.search(self.data, at):
            if m[1] is None:
                self.trailers.insert(0, d := _dictionary(self.data, m.end()))
                at = m.end() + len(d)
                continue
            number = int(m[1])
            self.places[number] = ("at", m.start(), int(m[2]))
            end = self.data.find(b"endobj", m.end())
            d = _dictionary(self.data[m.end() : end]) if end >= 0 else b""
            if not d and self.data[m.end() : m.end() + 64].lstrip().startswith(b"<<"):
                d = _dictionary(self.data, m.end())  # a string of it holds the word
            at = max(m.end(), end)
            if d:
                after = self.data.index(d, m.end()) + len(d)
                at = self._stream_end(d, after) or max(at, after)
                if _value(d, b"Type") == b"/ObjStm":
                    inside.append((number, d, after))
                elif _value(d, b"Type") == b"/XRef":
                    self.trailers.insert(0, d)
        for number, d, after in inside:
            try:
                for k, (n, _) in enumerate(self._members(d, after)):
                    self.places.setdefault(n, ("in", number, k))
            except (ValueError, TypeError, zlib.error):
                continue

    def _stream_bounds(self, d: bytes, after: int) -> tuple[int, int] | None:
        """Begin and end of the stream that follows a dictionary: by its length, or where that is wrong by its closing word."""
        m = _STREAM.match(self.data, after)
        if not m:
            return None
        length = _value(d, b"Length")
        if length and _REF.fullmatch(length):
            length = None if self.broken else self.value(length).strip()
        end = m.end() + int(length) if length and length.isdigit() else -1
        if end < 0 or not self.data[end : end + 16].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", m.end())
        return m.end(), len(self.data) if end < 0 else end

    def _stream_end(self, d: bytes, after: int) -> int | None:
        bounds = self._stream_bounds(d, after)
        return bounds and bounds[1]

    def _decoded(self, d: bytes, after: int) -> bytes:
        bounds = self._stream_bounds(d, after)
        if bounds is None:
            raise ValueError("no stream")
        raw, filters = self.data[bounds[0] : bounds[1]], re.findall(rb"/\w+", _value(d, b"Filter") or b"")
        if filters not in ([], [b"/FlateDecode"]):
            raise ValueError("a filter that is not read here")
        raw = zlib.decompressobj().decompress(raw) if filters else raw
        parms = _dictionary(_value(d, b"DecodeParms") or b"")
        if int(_value(parms, b"Predictor") or 1) < 10:
            return raw
        wide = int(_value(parms, b"Columns") or 1)
        out, above = bytearray(), bytes(wide)
        for at in range(0, len(raw) - wide, wide + 1):
            line = bytearray(raw[at + 1 : at + 1 + wide])
            for i in range(wide):
                left, up, corner = (line[i - 1], above[i], above[i - 1]) if i else (0, above[0], 0)
                paeth = min((left, up, corner), key=lambda x, p=left + up - corner: abs(p - x))
                line[i] = line[i] + (0, left, up, (left + up) // 2, paeth)[raw[at]] & 255
            out += line
            above = bytes(line)
        return bytes(out)

    def _members(self, d: bytes, after: int) -> list[tuple[int, bytes]]:
        """(number, body) of the objects in an object stream."""
        raw, count, first = self._decoded(d, after), int(_value(d, b"N")), int(_value(d, b"First"))
        heads = [int(x) for x in raw[:first].split()][: 2 * count]
        ends = [*heads[3::2], len(raw) - first]
        return [(n, raw[first + a : first + b]) for n, a, b in zip(heads[::2], heads[1::2], ends, strict=True)]

    def root(self) -> bytes | None:
        return next((v for t in self.trailers if (v := _value(t, b"Root"))), None)

    def get(self, number: int) -> tuple[int, bytes] | None:
        """Generation and body of an object, or None."""
        if number not in self.bodies:
            self.bodies[number] = self._read(number)
        return self.bodies[number]

    def _read(self, number: int) -> tuple[int, bytes] | None:
        place = self.places.get(number, ("free",))
        if place[0] == "at":
            head = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b").match(self.data, place[1])
            if not head or int(head[1]) != number:
                raise ValueError(f"object {number} is not where it should be")
            end = self.data.find(b"endobj", head.end())
            body = self.data[head.end() : end if end >= 0 else len(self.data)]
            if body.lstrip().startswith(b"<<"):
                body = _dictionary(self.data, head.end())  # of a stream its dictionary
            return int(head[2]), body
        if place[0] == "in":
            outer = self.places.get(place[1], ("free",))
            head = re.compile(rb"\s*\d+\s+\d+\s+obj\b").match(self.data, outer[1]) if outer[0] == "at" else None
            if not head:
                return None
            d = _dictionary(self.data, head.end())
            return next(((0, body) for n, body in self._members(d, self.data.index(d, head.end()) + len(d)) if n == number), None)
        return None

    def value(self, value: bytes | None) -> bytes:
        """A value, or what it refers to."""
        for _ in range(8):
            m = _REF.fullmatch((value or b"").strip())
            if not m:
                break
            found = self.get(int(m[1]))
            value = found[1].strip() if found else b""
        return value or b""


def _value(dictionary: bytes, key: bytes) -> bytes | None:
    """Raw value of a top-level key."""
    inner, depth, at = dictionary[2:-2], 0, 0
    while at < len(inner):
        two = inner[at : at + 2]
        if two in (b"<<", b">>"):
            depth, at = depth + (1 if two == b"<<" else -1), at + 2
            continue
        if two[:1] == b"(":
            at = _string_end(inner, at)
            continue
        if inner[at : at + 1] in b"[]":
            depth += 1 if inner[at : at + 1] == b"[" else -1
        elif depth == 0 and (m := re.compile(rb"/" + key + rb"(?![A-Za-z0-9])\s*").match(inner, at)):
            rest = inner[m.end() :]
            if rest.startswith(b"<<"):
                return _dictionary(rest)
            if rest.startswith(b"["):
                return rest[: rest.index(b"]") + 1]
            return (_REF.match(rest) or re.match(rb"/?[^\s/<>\[\]()]+", rest) or re.match(rb"", rest))[0]
        at += 1
    return None


def cover_header(data: bytes) -> tuple[bytes | None, str | None]:
    """(new file, None), or (None, reason)."""
    if data[:4] != b"%PDF":
        return None, "No es un PDF válido (magic number incorrecto)"
    file = _File(data)
    root, follow = file.root(), file.value
    if file.start is None or root is None:
        return None, "El PDF no se pudo cargar (corrupto)"
    if any(_value(t, b"Encrypt") for t in file.trailers):
        return None, "El PDF no se pudo cargar (cifrado)"

    pages: list[tuple[int, dict[bytes, bytes]]] = []

    def walk(number: int, inherited: dict[bytes, bytes], seen: frozenset[int]) -> None:
        found = None if number in seen else file.get(number)
        if found is None:
            return
        node = _dictionary(found[1])
        own = inherited | {k: v for k in (b"MediaBox", b"Resources") if (v := _value(node, k)) is not None}
        kids = _value(node, b"Kids")
        if kids is None:
            pages.append((number, own))
            return
        for m in _REF.finditer(follow(kids)):
            walk(int(m[1]), own, seen | {number})

    tree = _REF.fullmatch(_value(_dictionary(follow(root)), b"Pages") or b"")
    if tree:
        walk(int(tree[1]), {}, frozenset())
    if not pages:
        return None, "El PDF no tiene páginas"

    next_number = max(file.places) + 1
    font, out, places = next_number, bytearray(data if data.endswith(b"\n") else data + b"\n"), {}

    def put(number: int, generation: int, body: bytes) -> None:
        places[number] = (len(out), generation)
        out.extend(b"%d %d obj\n" % (number, generation) + body + b"\nendobj\n")

    put(font, 0, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>")
    at = font + 1
    for number, own in pages:
        generation, body = file.get(number)
        page = _dictionary(body)
        box = [float(x) for x in re.findall(rb"-?[\d.]+", follow(own.get(b"MediaBox")) or b"0 0 612 792")][:4]
        left, width, top = box[0], box[2] - box[0], box[3]
        y = top - TOP - HEIGHT
        x = left + (width - LABEL_WIDTH * SIZE) / 2
        drawing = f"q 1 1 1 rg {left:g} {y:g} {width:g} {HEIGHT} re f Q\nq BT /VfLabel {SIZE} Tf 0.5 0.5 0.5 rg {x:.3f} {y + HEIGHT / 2 - SIZE / 2:g} Td ({LABEL}) Tj ET Q".encode("latin-1")
        put(at, 0, b"<< /Length 2 >>\nstream\nq\n\nendstream")
        put(at + 1, 0, b"<< /Length %d >>\nstream\nQ\n" % (len(drawing) + 2) + drawing + b"\nendstream")
        old = _value(page, b"Contents")
        inner = b" ".join(m[0] for m in _REF.finditer(old if old and old.startswith(b"[") else follow(old) if old and follow(old).startswith(b"[") else old or b""))
        resources = follow(own.get(b"Resources")) or b"<< >>"
        resources = _dictionary(resources) or b"<< >>"
        fonts = _value(resources, b"Font")
        entry = b"/VfLabel %d 0 R" % font
        known = _dictionary(follow(fonts)) if fonts else b""
        plain = resources.replace(b"/Font" + resources[resources.index(b"/Font") + 5 : resources.index(fonts) + len(fonts)], b"", 1) if fonts else resources
        resources = plain[:-2] + b" /Font << " + (known[2:-2] if known else b"") + b" " + entry + b" >> >>"
        stripped = page
        for key in (b"Contents", b"Resources"):
            if (value := _value(stripped, key)) is not None:
                begin = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*" + re.escape(value), stripped)
                if begin:
                    stripped = stripped[: begin.start()] + stripped[begin.end() :]
        put(number, generation, stripped[:-2] + b" /Contents [%d 0 R " % at + inner + b" %d 0 R] /Resources " % (at + 1) + resources + b" >>")
        at += 2

    _append_references(file, out, places, at)
    return bytes(out), None


def _append_references(file: _File, out: bytearray, places: dict[int, tuple[int, int]], size: int) -> None:
    """The section for ``places`` that names the one before it; for a broken chain, one of all objects that names none."""
    rows = {n: (1, *p) for n, p in places.items()}
    if file.broken:
        rows = {n: (1, *p[1:]) if p[0] == "at" else (2, *p[1:]) for n, p in file.places.items() if p[0] != "free"} | rows
    kept = b"".join(b" /" + k + b" " + v for k in (b"Info", b"ID") if (v := next((x for t in file.trailers if (x := _value(t, k))), None)))
    before = b"" if file.broken else b" /Prev %d" % file.start
    where = len(out)
    if file.is_stream or any(r[0] == 2 for r in rows.values()):
        rows[size] = (1, where, 0)
        data = b"".join(b"%c%b%b" % (kind, a.to_bytes(8, "big"), b.to_bytes(4, "big")) for _, (kind, a, b) in sorted(rows.items()))
        index = b" ".join(b"%d 1" % n for n in sorted(rows))
        out.extend(b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 8 4] /Index [%b] /Root %b%b%b /Length %d >>\nstream\n" % (size, size + 1, index, file.root(), kept, before, len(data)))
        out.extend(data + b"\nendstream\nendobj\n")
    else:
        out.extend(b"xref\n" + (b"0 1\n0000000000 65535 f \n" if file.broken else b""))
        for number, (_, offset, generation) in sorted(rows.items()):
            out.extend(b"%d 1\n%010d %05d n \n" % (number, offset, generation))
        out.extend(b"trailer\n<< /Size %d /Root %b%b%b >>\n" % (size, file.root(), kept, before))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % where)


def _redact(data: bytes | None) -> tuple[bool, bytes | None, str | None, str | None]:
    if data is None:
        return False, None, None, "base64 decode falló"
    try:
        new, reason = cover_header(bytes(data))
    except (ValueError, IndexError, TypeError, RecursionError) as e:
        new, reason = None, f"El PDF no se pudo modificar: {e}"
    kept = bytes(data) if new is None else new
    return new is not None, kept, hashlib.sha256(kept).hexdigest(), reason


_RESULT = StructType([StructField("ok", BooleanType()), StructField("data", BinaryType()), StructField("sha256", StringType()), StructField("reason", StringType())])


@F.pandas_udf(_RESULT)
def redact_pdf(data: pd.Series) -> pd.DataFrame:
    """Struct of ok, bytes, their hash and a reason; bytes are the input's where ok is false."""
    return pd.DataFrame([_redact(d) for d in data], columns=["ok", "data", "sha256", "reason"])


def pdf_problem(data):
    """Why bytes cannot be a PDF, or null: the checks that need no parsing, in the JVM."""
    return (
        F.when(data.isNull(), "base64 decode falló")
        .when((F.octet_length(data) < 4) | (F.hex(F.substring(data, 1, 4)) != "25504446"), "No es un PDF válido (magic number incorrecto)")
        .otherwise(F.lit(None).cast("string"))
    )


def to_base64(data: bytes) -> str:
    return b64encode(data).decode()
