"""Pseudonyms, names of files and duplicates over a stream of documents, with state per run.

What a document says of itself (header, labels, segments, identifiers, keys that names may be found by) is worked out before it
reaches the state of its run, and it is rewritten after it, both by as many tasks as there are. Between them a run is one ordered
stream, so one task reads its rows of a batch, sorted on disk where they are many, and does what needs their order: it numbers
identifiers and names by first appearance, finds the names that a document may hold, and gives its slug. How many rows a batch has is
set by ``files_per_batch``. Many runs are read side by side. Repeated texts are found after that, by hash.

The state of a run holds its token numbers, its names by hashes of the keys that they are found by, and its slugs, each in a map on
disk that is read and written through memory. A table of bits of fixed size tells which keys of a text may be those of names, so that
only these are looked up; a name found by another's hash is not in the text, and is not replaced. A name found after a label is
replaced from that document on, which is the cumulative scope of ``operators.anonymize``.
"""

from __future__ import annotations

import heapq
import json
import operator
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from ..functions import html as H
from ..functions import pii
from ..functions.names import hashes_of_keys, keys_of_name, keys_of_text, replace_names
from ..plans.marks import in_table

EMAIL, CEDULA, PHONE = (re.compile(p, re.ASCII) for p in (pii.EMAIL, pii.CEDULA, pii.PHONE))
#: Stands in every text with a national identity number or a phone.
_NUMBER_HINT = re.compile(r"\d{3}", re.ASCII)
#: Bits for the keys of a run's names, 128 KB: beyond some hundred thousand names more keys are looked up, and none is missed.
NAME_BITS = 20
#: Entries of a map on disk that are held in memory.
HELD = 1 << 16


def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_KEY, _NUMBER, _TEXT, _BITS = _struct(k=StringType()), _struct(n=LongType()), _struct(v=StringType()), _struct(bits=BinaryType())
#: What is found in a document: identifiers in order of appearance, each once, and the high halves of its keys' hashes.
_FOUND = _struct(ids=ArrayType(StringType()), keys=BinaryType())
#: A document with the numbers of its identifiers, in their order, and the names that it may hold.
_NUMBERED = _struct(run_id=StringType(), ordinal=LongType(), text=StringType(), numbers=ArrayType(LongType()), known=ArrayType(StringType()), slug=StringType())
OUTPUT = _struct(run_id=StringType(), ordinal=LongType(), text=StringType(), slug=StringType(), sha256=StringType(), duplicate=BooleanType())

_ROWS = pa.schema([("ordinal", pa.int64()), ("base", pa.string()), ("text", pa.string()), ("names", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("keys", pa.binary())])
_CHANGED = pa.schema([("ordinal", pa.int64()), ("text", pa.string()), ("slug", pa.string()), ("sha256", pa.string())])
#: Bytes of a run's rows that are sorted in memory, rows that are read at a time of what was sorted, and characters given at a time.
SORT_BYTES, READ_ROWS, OUT_CHARS = 64 << 20, 32, 4 << 20


def in_order(frames: Iterator[pd.DataFrame], limit: int = SORT_BYTES, schema: pa.Schema | None = None) -> Iterator[dict]:
    """The rows of one run in order of ``ordinal``. More than ``limit`` bytes are sorted on disk, in a folder that is deleted at the end.

    Columns are those of ``schema``, or of the first frame.
    """
    held, size, sorted_files = [], 0, []

    def settled() -> pa.Table:
        table = pa.concat_tables(held)
        return table.take(np.argsort(table["ordinal"].to_numpy(), kind="stable"))

    def read(path: str) -> Iterator[dict]:
        with pa.OSFile(path) as f, pa.ipc.open_file(f) as batches:
            for i in range(batches.num_record_batches):
                yield from batches.get_batch(i).to_pylist()

    def rows_of(table: pa.Table) -> Iterator[dict]:
        for batch in table.to_batches(READ_ROWS):
            yield from batch.to_pylist()

    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        for frame in frames:
            schema = schema or pa.Table.from_pandas(frame, preserve_index=False).schema.remove_metadata()
            held.append(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
            size += held[-1].nbytes
            if size > limit:
                path = f"{folder}/{len(sorted_files)}"
                with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, held[0].schema) as out:
                    out.write_table(settled(), READ_ROWS)
                sorted_files.append(path)
                held, size = [], 0
        rest = [rows_of(settled())] if held else []
        yield from heapq.merge(*map(read, sorted_files), *rest, key=operator.itemgetter("ordinal"))


def _in_frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with their text third, in frames of some MB."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[2])
        if chars > OUT_CHARS:
            yield pd.DataFrame(out, columns=columns)
            out, chars = [], 0
    yield pd.DataFrame(out, columns=columns)


class _Held:
    """A map state from a string to one value, with up to ``HELD`` entries in memory; changed ones are written when these are full, and by ``write``."""

    def __init__(self, state) -> None:
        self.state, self.held, self.changed = state, {}, set()

    def get(self, key: str):
        if key not in self.held:
            if len(self.held) >= HELD:
                self.write()
            entry = self.state.getValue((key,))
            self.held[key] = None if entry is None else entry[0]
        return self.held[key]

    def put(self, key: str, value) -> None:
        if key not in self.held and len(self.held) >= HELD:
            self.write()
        self.held[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), (self.held[key],))
        self.held, self.changed = {}, set()


class RunTokens(StatefulProcessor):
    """Numbers identifiers and names by first appearance, tells which names a document may hold, and makes slugs unique."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {name: handle.getMapState(name, _KEY, _TEXT if name == "named" else _NUMBER) for name in ("tokens", "names", "named", "slugs", "given", "counts")}
        self.filter = handle.getValueState("filter", _BITS)

    def _count(self, kind: str) -> int:
        n = (self.counts.get(kind) or 0) + 1
        self.counts.put(kind, n)
        return n

    def _number(self, key: str) -> int:
        n = self.tokens.get(key)
        if n is None:
            n = self._count(key.split(" ", 1)[0])
            self.tokens.put(key, n)
        return n

    def _learn_names(self, names: list[str]) -> None:
        for name in names:
            if self.names.get(name) is None:
                n = self._count("NAME")
                self.names.put(name, n)
                for h in set(_high_halves(keys_of_name(name)).tolist()):
                    held = json.loads(self.named.get(str(h)) or "[]")
                    self.named.put(str(h), json.dumps([*held, [n, name]]))
                    at = h >> 32 - NAME_BITS
                    self.bits[at >> 3] |= 1 << (at & 7)
                    self.learned = True

    def _names_at(self, keys: bytes) -> list[str]:
        """Names that may occur, in order of their first appearance in the run."""
        halves, found = np.frombuffer(keys, np.uint32), set()
        for h in halves[in_table(self.bits, halves.astype(np.uint64) << np.uint64(32))].tolist():
            found.update(map(tuple, json.loads(self.named.get(str(h)) or "[]")))
        return [name for _, name in sorted(found)]

    def _taken(self, slug: str) -> int | None:
        """The last number given to a slug, 1 where it is only taken itself, or None. A slug with a number has taken all smaller ones."""
        n = self.slugs.get(slug)
        if n is None and (m := _NUMBERED_SLUG.fullmatch(slug)) and int(m[2]) <= (self.slugs.get(m[1]) or 0):
            return 1
        return n

    def _take(self, base: str, n: int) -> None:
        self.slugs.put(base, n)
        if m := _NUMBERED_SLUG.fullmatch(base):  # documents named ``m[1]`` have to look for it
            self.given.put(m[1], 1)

    def _slug(self, base: str) -> str:
        base = base or "evento"
        n = self._taken(base)
        if n is None:
            self._take(base, 1)
            return base
        n += 1
        while self.given.get(base) and self.slugs.get(f"{base}-{n}") is not None:
            n += 1
        self._take(base, n)
        return f"{base}-{n}"

    def _numbered(self, run_id: str, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for r in in_order(rows, schema=_ROWS):
            self._learn_names(r["names"] or [])
            numbers = [self._number(key) for key in r["ids"] or []]
            known = self._names_at(r["keys"]) if r["keys"] and self.any_name | self.learned else []
            yield run_id, r["ordinal"], r["text"] or "", numbers, known, self._slug(r["base"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {name: _Held(state) for name, state in self.maps.items()}
        self.__dict__.update(held)
        bits = self.filter.get()
        self.any_name, self.learned = bits is not None, False
        self.bits = np.frombuffer(bits[0], np.uint8).copy() if bits else np.zeros(1 << NAME_BITS - 3, np.uint8)
        yield from _in_frames(self._numbered(key[0], rows), _NUMBERED.names)
        for state in held.values():
            state.write()
        if self.learned:
            self.filter.update((self.bits.tobytes(),))

    def close(self) -> None:
        pass


class RunRepeats(StatefulProcessor):
    """Marks the texts that a run has had before, in order, for some of the hashes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", _KEY, _NUMBER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hashes = _Held(self.hashes)

        def marked() -> Iterator[tuple]:
            for r in in_order(rows, schema=_CHANGED):
                seen = hashes.get(r["sha256"]) is not None
                if not seen:
                    hashes.put(r["sha256"], 1)
                yield key[0], r["ordinal"], r["text"], r["slug"], r["sha256"], seen

        yield from _in_frames(marked(), OUTPUT.names)
        hashes.write()

    def close(self) -> None:
        pass


_NUMBERED_SLUG = re.compile(r"(.+)-([2-9]|[1-9][0-9]{1,17})", re.DOTALL)


def _high_halves(keys: Iterable[str]) -> np.ndarray:
    return (hashes_of_keys(keys) >> np.uint64(32)).astype(np.uint32)


def _rewrite_ids(text: str, token: Callable[[str, str], str]) -> str:
    """Addresses, national identity numbers, phones, in this order."""
    if "@" in text:
        text = EMAIL.sub(lambda m: token("EMAIL", m[0].lower()), text)
    if _NUMBER_HINT.search(text) is None:
        return text
    text = CEDULA.sub(lambda m: pii.NATIONAL_ID_TOKEN if 7 <= len(re.sub(r"\D", "", m[0])) <= 8 else m[0], text)
    return PHONE.sub(lambda m: token("TEL", re.sub(r"[^\d+]", "", m[0])), text)


def _is_text(part: str, markup: bool) -> bool:
    return not (markup and part.startswith("<"))


def _find(markup: bool):
    """A function of the parts of texts: what is found in them. Keys do not depend on the numbers of tokens, as no word stands in these."""

    def of(parts) -> tuple[list[str], bytes]:
        ids, keys = {}, set()

        def token(kind: str, key: str) -> str:
            ids[f"{kind} {key}"] = None
            return f"[{kind}_0]"

        for p in () if parts is None else parts:
            if _is_text(p, markup):
                keys |= keys_of_text(_rewrite_ids(p, token))
        return list(ids), _high_halves(keys).tobytes()

    @F.pandas_udf(_FOUND)
    def found(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(p) for p in parts], columns=_FOUND.names)

    return found


def _rewrite(markup: bool):
    """A function of the parts of texts, the numbers of their identifiers and the names that they may hold: identifiers, then names, replaced."""

    def of(parts, numbers, known) -> str:
        tokens, left = {}, iter(numbers)

        def token(kind: str, key: str) -> str:
            entry = f"{kind} {key}"
            if entry not in tokens:
                tokens[entry] = f"[{kind}_{next(left)}]"
            return tokens[entry]

        done = [_rewrite_ids(p, token) if _is_text(p, markup) else p for p in parts]
        return "".join(replace_names(p, known) if _is_text(p, markup) and len(known) else p for p in done)

    @F.pandas_udf(StringType())
    def rewritten(parts: pd.Series, numbers: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([of(*r) for r in zip(parts, numbers, known, strict=True)], dtype=object)

    return rewritten


def tokenize_stream(docs: DataFrame, *, markup: bool = False, strict_labels: bool = False) -> DataFrame:
    """Streaming (run_id, ordinal, text, base) to run_id, ordinal, text, slug, sha256, duplicate. Needs the RocksDB state store.

    With ``markup`` header identifiers are replaced, and other identifiers and names only outside tags and raw zones. A null text is
    an empty one.
    """
    text = F.col("text")
    parts = H.segments(text) if markup else F.array(text)
    names = pii.extract_names(text, strict=strict_labels)
    read = docs.repartition("run_id", "ordinal").select("run_id", "ordinal", "base", (pii.rewrite_header_id(text) if markup else text).alias("text"), names.alias("names"))
    found = read.withColumn("found", _find(markup)(F.when(text.isNotNull(), parts))).select("run_id", "ordinal", "base", "text", "names", "found.*")
    numbered = found.groupBy("run_id").transformWithStateInPandas(RunTokens(), _NUMBERED, "Append", "None")
    changed = numbered.repartition("run_id", "ordinal").withColumn("text", _rewrite(markup)(parts, "numbers", "known")).withColumn("sha256", F.sha2("text", 256))
    some = changed.select("run_id", F.substring("sha256", 1, 2).alias("some"), "ordinal", "text", "slug", "sha256").groupBy("run_id", "some")
    return some.transformWithStateInPandas(RunRepeats(), OUTPUT, "Append", "None")


def drop_captured(docs: DataFrame) -> DataFrame:
    """Streaming rows without those whose hash their run has had, in native keyed state without expiry."""
    return docs.dropDuplicates(["run_id", "sha256"])
