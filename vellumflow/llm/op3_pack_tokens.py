"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are encoded with a given byte-level vocabulary. A document longer than a row is cut into row-long pieces and a rest;
nothing is dropped. Rests are placed, longest first, into the fullest row that still has room, which a segment tree over free
capacities finds. Each packed row holds its ids, the cumulative lengths of its segments and positions that start from 0 with
every segment; document identifier, row number and token offset of each segment make the packing reversible.

Packing runs where the documents lie: a task packs its rows in blocks of ``BLOCK_TOKENS`` tokens, in the order of identifier and
text, so nothing is shuffled, memory is bounded and a task that is run again gives the same rows.

Defined cases
- null or empty text has no tokens and no segment. Null identifiers stay null in ``doc_ids``.
- rows that repeat an identifier are packed one by one and told apart by ``rows``.
- a text of any length is encoded whole, and its pieces may lie in several rows. Extra columns are ignored.
- how segments meet in rows depends on how the input is split into partitions; which segments there are does not.
- an empty table gives no rows. The rest of a row is filled with ``pad``; ``n_tokens`` says how much is used.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .words import column_blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this kind of vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW, BLOCK_TOKENS, LONG_SPACE = 2048, 4_000_000, 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")

_encodings: dict[str, tiktoken.Encoding] = {}

SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, rows array<long>, offsets array<long>"
_ARROW = pa.schema(
    [
        ("pack_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("rows", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
    ]
)


def encoding(content: bytes) -> tiktoken.Encoding:
    """The encoder for a vocabulary file's content; kept for the life of the process."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def encode_text(encode: Callable[[str], np.ndarray], text: str) -> np.ndarray:
    """Token ids of a text of any length.

    Runs of white space are cut after every ``LONG_SPACE`` characters, as the encoder fails on runs of about a million: that
    changes how such a run is merged, not what the ids decode to.
    """
    ends = [m.end() for m in _LONG_SPACE.finditer(text)]
    if not ends:
        return encode(text)
    return np.concatenate([encode(text[a:b]) for a, b in zip([0, *ends], [*ends, len(text)], strict=True)])


class Capacities:
    """Open rows by free capacity, with a segment tree that finds the least capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)  # whether the part of the range below a node has an open row
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.open[capacity].append(row)
        node = capacity + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of a row with the least capacity of at least ``need``, no longer open."""
        node = need + self.leaves
        if not self.any[node]:
            while node > 1 and (node % 2 or not self.any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.open[capacity].pop()
        if not self.open[capacity]:
            self.any[node] = 0
            while node > 1 and not self.any[node ^ 1]:
                node //= 2
                self.any[node] = 0
        return capacity, row


def best_fit_decreasing(lengths: list[int], row: int = ROW) -> list[list[int]]:
    """Rows of numbers of segments; every segment is at most ``row`` long. Ties keep the given order."""
    free, rows = Capacities(row), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        capacity, at = found if found else (row, len(rows))
        if not found:
            rows.append([])
        rows[at].append(i)
        if capacity > lengths[i]:
            free.add(capacity - lengths[i], at)
    return rows


def _pack(vocabulary: Broadcast, row: int, pad: int, block_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary.value).encode_to_numpy
        kind = np.uint16 if pad < 1 << 16 else np.uint32
        base, seen, packs = TaskContext.get().partitionId() << 33, 0, 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal packs
            rows = best_fit_decreasing([len(s[3]) for s in held], row)
            for first in range(0, len(rows), 1000):
                out = []
                for members in rows[first : first + 1000]:
                    parts = [held[i] for i in members]
                    sizes = [len(p[3]) for p in parts]
                    used = sum(sizes)
                    ids, places = np.full(row, pad, kind), np.zeros(row, np.uint16 if row <= 1 << 16 else np.uint32)
                    np.concatenate([p[3] for p in parts], out=ids[:used])
                    np.concatenate([np.arange(n, dtype=places.dtype) for n in sizes], out=places[:used])
                    out.append((base + packs, used, ids.tobytes(), places.tobytes(), [0, *np.cumsum(sizes).tolist()], *([p[k] for p in parts] for k in range(3))))
                    packs += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held.clear()

        for batch in batches:
            texts = itertools.chain.from_iterable(part for _, part in column_blocks(batch.column("text")))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = encode_text(encode, text).astype(kind)
                for at in range(0, len(ids), row):
                    held.append((doc_id, base + seen, at, ids[at : at + row]))
                seen, total = seen + 1, total + len(ids)
                if total >= block_tokens:
                    yield from close()
                    total = 0
        if held:
            yield from close()

    return pack


def pack_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY, row: int = ROW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed row; ``input_ids`` and ``position_ids`` are little-endian matrices rows of ``row`` entries.

    Entries have 16 bits where the vocabulary allows, else 32. The vocabulary is a local file of the driver, sent to tasks.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    pad = encoding(content).n_vocab
    rows = docs.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(_pack(docs.sparkSession.sparkContext.broadcast(content), row, pad, block_tokens), SCHEMA)


def _unpack(vocabulary: Broadcast):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind = np.uint16 if encoding(vocabulary.value).n_vocab < 1 << 16 else np.uint32
                ids, ends = np.frombuffer(r["input_ids"], kind), r["cu_seqlens"]
                for k, (doc, row, at) in enumerate(zip(r["doc_ids"], r["rows"], r["offsets"], strict=True)):
                    piece = encoding(vocabulary.value).decode_bytes(ids[ends[k] : ends[k + 1]].tolist())
                    out.append((doc, row, at, piece))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "row", "at", "piece"])

    return unpack


def unpack_documents(packed: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every packed document that has tokens."""
    with open(vocabulary, "rb") as f:
        sent = packed.sparkSession.sparkContext.broadcast(f.read())
    pieces = packed.mapInArrow(_unpack(sent), "doc_id long, row long, at long, piece binary")
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("pieces"))
    return whole.select("doc_id", F.unhex(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).cast("string").alias("text"))


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
