"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, so of two fingerprints that differ in at most two bits one half differs in at
most one. Every distinct fingerprint is indexed under its 64 variants: a half with one of its 32 bits as a wildcard. Rows
with equal variants are brought together by an equality shuffle and verified by their exact distance.

Equal variants form a run. A run gives a spanning forest of its verified links instead of its pairs, which keeps every
connection. Runs of more than ``RUN`` fingerprints are not compared in one task: their members get a second wildcard, which
leaves at most four fingerprints to a key and covers every way two of them can differ in two bits.

Defined cases
- null text is empty; a text without words has fingerprint 0 and links like any other.
- copies have one fingerprint, hence one component. Rows that repeat an identifier get a row each.
- null identifiers are passed over when the smallest identifier of a component is taken.
- extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, release
from ..sources.tables import read_table
from .alike import as_struct
from .bits import FILTER_BITS, _free, bitmap, rows_without
from .components import connected_components
from .words import column_blocks, hash_words, mix

BITS, RUN = 2, 1024
#: A byte spread over eight lanes of eight bits, so that up to 255 bytes can be added up in one word.
LANES = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], dtype=np.uint64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a UTF-8 text over shingles of ``words`` words; A-Z count as a-z."""
    found = text.lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D separate
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    lanes = LANES[np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(lanes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for _, texts in column_blocks(batch.column("text")) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks)], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark: the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, mark long")


def _forest(marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of ``marks`` to the first of its component, for those that are not first themselves."""
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= bits
    label = np.arange(len(marks))
    while True:
        after = np.where(near, label[None, :], len(marks)).min(1)
        after = after[after]
        if (after == label).all():
            break
        label = after
    rest = np.flatnonzero(label != np.arange(len(marks)))
    return marks[rest], marks[label[rest]]


def _runs(bits: int, limit: int):
    """Reads (key, mark) sorted by key; gives links as (mark, root, null) and members of long runs as (mark, null, key)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks, long_key = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key)], ["u", "v", "key"])

        def settle(k: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(first, len(k)))
            two = first[size == 2]
            two = two[np.bitwise_count(m[two] ^ m[two + 1]) <= bits]
            yield out(m[two + 1], m[two], None)
            for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if n > limit:
                    yield out(m[a : a + n], None, k[a : a + n])
                else:
                    yield out(*_forest(m[a : a + n], bits), None)

        for batch in batches:
            k, m = batch.column("key").to_numpy(), batch.column("mark").to_numpy().view(np.uint64)
            if not len(k):
                continue
            if long_key is not None:  # a run already known to be long is passed on as it comes
                same = int(np.searchsorted(k, long_key, side="right"))
                if same:
                    yield out(m[:same], None, k[:same])
                k, m = k[same:], m[same:]
                if not len(k):
                    continue
                long_key = None
            keys, marks = np.concatenate((keys, k)), np.concatenate((marks, m))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if cut:
                yield from settle(keys[:cut], marks[:cut])
                keys, marks = keys[cut:], marks[cut:]
            if len(keys) > limit:
                long_key = keys[-1]
                yield out(marks, None, keys)
                keys, marks = keys[:0], marks[:0]
        if len(keys):
            yield from settle(keys, marks)

    return links


def _variants(distinct: DataFrame) -> DataFrame:
    """(key, mark): key is the number of the variant above 32 bits of a half with one bit cleared."""
    high, low = F.shiftrightunsigned("mark", 32), F.col("mark").bitwiseAND(0xFFFFFFFF)
    keys = [half.bitwiseAND(0xFFFFFFFF ^ 1 << i) + (n * 32 + i << 32) for n, half in enumerate((high, low)) for i in range(32)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "mark")


def _second_wildcards(members: DataFrame) -> DataFrame:
    """Links among members of long runs: (u, v).

    Members of a run agree on one half but for one bit. Two that differ in that bit differ in at most one bit of the other
    half: one wildcard there. Two that agree on the half also meet in its run for bit 0, where two wildcards are tried.
    """
    def single(i: int) -> int:
        return (1 << i) - (1 << 64) if i == 63 else 1 << i

    def flips(own: int, other: range, bit: int) -> list[int]:
        base = single(own + bit)
        one = [base | single(j) for j in other]
        return one + ([single(i) | single(j) for i in other for j in other if i < j] if bit == 0 else [])

    parts = [(n * 32 + i, flips(32 * (1 - n), range(32 * n, 32 * n + 32), i)) for n in (0, 1) for i in range(32)]
    table = members.sparkSession.createDataFrame(parts, "variant int, masks array<bigint>")
    tried = members.withColumn("variant", F.shiftright("key", 32).cast("int")).join(F.broadcast(table), "variant")  # 64 fixed rows
    tried = tried.select("mark", F.explode("masks").alias("mask")).select("mark", "mask", F.col("mark").bitwiseAND(F.bitwise_not("mask")).alias("rest")).distinct()
    heads = tried.groupBy("mask", "rest").agg(F.min("mark").alias("v"), F.max("mark").alias("w"))
    return heads.where("v <> w").join(tried, ["mask", "rest"]).where("mark <> v").select(F.col("mark").alias("u"), "v").distinct()


def near_links(marks: DataFrame, *, bits: int = BITS, run_limit: int = RUN) -> DataFrame:
    """Links (u, v) between distinct fingerprints in column ``mark`` that connect all those at ``bits`` or fewer bits."""
    if bits > 2:
        raise ValueError("one wildcard in one of two halves finds at most two differing bits")
    keyed = _variants(marks).repartition("key").sortWithinPartitions("key", "mark")
    found = materialize(keyed.mapInArrow(_runs(bits, run_limit), "u long, v long, key long"), "simhash-runs")
    links = found.where("key is null").select("u", "v").distinct()
    members = found.where("key is not null").select(F.col("u").alias("mark"), "key")
    if members.isEmpty():
        return links
    more = _second_wildcards(members).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return links.union(more).distinct()


def near_duplicates(docs: DataFrame, *, bits: int = BITS, run_limit: int = RUN) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component)."""
    marks = materialize(fingerprints(docs), "simhash-marks")
    distinct = materialize(marks.groupBy("mark").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("mark"), bits=bits, run_limit=run_limit), "simhash-links")
    linked = distinct.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(linked.join(least, "root").select("mark", "component_id"), "simhash-components")
    return marks.join(named, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of 0.8 and more ----------------------------------------------------------------------------------------------
#
# Pairs come from the deletion variants of the fingerprints first. Two bits of 64 stand for a similarity of about 0.98, so that
# others are left: these are found by an exact join of the sets of shingles. Shingles are put in an order, rare ones first, and two
# sets at the similarity share one among the first few of each (prefix filter). Texts that share such a shingle form a run. All pairs
# are verified alike.
#
# Pairs of a run are verified in steps: each text with the first of its run and the one before it; then, of texts that this has
# left in different components, each with the nearest few of another component; last, in runs where a text has more of these,
# all pairs that are still in different components. Nearness is read off parity bits: each shingle turns one bit, so that the number of bits in which two
# texts differ is never more than the number of shingles in which their sets do. Pairs beyond the bound are never listed. No
# pair that can reach the similarity is left out, and of a large group of near copies a few pairs to each text are listed.

#: Counters of shingles, 2 MB as sent to tasks. They set the order only: rare shingles first makes short runs, any order is exact.
RARITY_BITS, SLICE_BITS = 21, 16
#: A run of about this many rows and more is dealt to several tasks. Nearest texts of another component that are verified in a step.
HOT_ROWS, NEAREST = 4096, 2
#: Parity bits that rows of a run carry. A text has as many as twice its shingles or more, for pairs that pass on these.
RUN_BITS = 512


def _shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all shingles, in order; a text of fewer words is one shingle."""
    hashes, which, _, _ = hash_words([t.lower() for t in texts])
    counts = np.bincount(which, minlength=len(texts))
    n = len(hashes) - words + 1
    found = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        found = mix(found + hashes[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    inside = np.flatnonzero(which[: max(n, 0)] == which[words - 1 :]) if n > 0 else np.empty(0, np.int64)
    begin = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    whole = np.array([int.from_bytes(xxhash.xxh64_digest(hashes[begin[t] : begin[t] + counts[t]].tobytes())) for t in short], dtype=np.uint64)
    h, of = np.concatenate((found[inside], whole)), np.concatenate((which[inside], short))
    order = np.argsort(of, kind="stable")
    return h[order], of[order]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _shingle_counts(words: int):
    """Rows (slice, counts) of this task's counters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            at = np.unique(batch.column("node").to_numpy(), return_index=True)[1]
            for _, texts in column_blocks(batch.column("text"), at=at):
                counts += np.bincount(_counter(_shingles(texts, words)[0]), minlength=len(counts))
        if counts.any():
            # Low bytes, then high bytes, which are mostly 0 and shrink to nothing.
            parts = [c.view(np.uint8).reshape(-1, 2).T.tobytes() for c in np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, 1 << SLICE_BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return read


def _slice_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums.setdefault(n, np.zeros(1 << SLICE_BITS, np.int64))[:] += np.frombuffer(part, np.uint8).reshape(2, -1).T.copy().view("<u2").reshape(-1)
    for n, total in sums.items():
        codes = np.log2(np.maximum(total, 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([codes.tobytes()], pa.binary())], ["slice", "codes"])


def _shingle_rarity(rows: DataFrame, words: int) -> np.ndarray:
    """Per counter the whole part of the logarithm of its count; at most 2**(RARITY_BITS - SLICE_BITS) rows reach the driver."""
    codes = np.zeros((1 << RARITY_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    counted = rows.mapInArrow(_shingle_counts(words), "slice int, counts binary").repartition("slice")
    for r in counted.mapInArrow(_slice_logs, "slice int, codes binary").collect():
        codes[r["slice"]] = np.frombuffer(r["codes"], np.uint8)
    return codes.reshape(-1)


def _salts(codes: np.ndarray, hot_rows: int) -> np.ndarray:
    """By logarithm of a counter, over how many tasks a shingle's run is dealt: 1 unless the counter stands out and is hot."""
    usual = int(np.bincount(codes).argmax()) + 2
    hot = max(usual, int(np.log2(hot_rows)))
    return np.array([1 << min(max(0, c - hot), 20) for c in range(64)])


def _shingle_prefixes(words: int, similarity: float, rarity, hot_rows: int):
    """Rows (key, salt, node, size, place): the shingles of a text's prefix, the size of its set, and where in the order each stands.

    Of copies a batch indexes one, so that a large group of them sends a few rows from each task. ``salt`` is 0 but for
    shingles in very many texts, whose rows are dealt to several tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rarity.value
        dealt = _salts(codes, hot_rows)
        for batch in batches:
            nodes, at = np.unique(batch.column("node").to_numpy(), return_index=True)
            for start, texts in column_blocks(batch.column("text"), at=at):
                h, of = _shingles(texts, words)
                if not len(h):
                    continue
                code = codes[_counter(h)]
                order = np.lexsort((h, code, of))
                h, of, code = h[order], of[order], code[order]
                fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
                h, of, code = h[fresh], of[fresh], code[fresh]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                size = np.diff(np.append(first, len(of)))
                place, n = np.arange(len(of)) - np.repeat(first, size), np.repeat(size, size)
                some = np.flatnonzero(place <= n - np.ceil(similarity * n - 1e-9))
                node, over = nodes[start + of[some]], dealt[code[some]]
                salt = np.where(over > 1, 1 + (mix(node.view(np.uint64)) % over.astype(np.uint64)).astype(np.int64), 0)
                columns = [h[some].view(np.int64), salt.astype(np.int32), node, n[some].astype(np.int32), place[some].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "salt", "node", "size", "place"])

    return read


def _fit(similarity: float, size: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows can reach the similarity by their sizes, if the shingle they share is the first that they share."""
    need = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9)
    return np.minimum(size[x] - place[x], size[y] - place[y]) >= need


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.column_stack((np.minimum(u, v), np.maximum(u, v))), axis=0)


def _first_links(similarity: float):
    """From prefix rows sorted by key, salt and node: pairs (u, v) of each text with the first of its run and the one before it.

    Gives also the rows of runs of four or more, or dealt to several tasks, whose other pairs are left, as (key, u, size, place).
    """
    names = ["u", "v", "key", "size", "place"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_in, held = ["key", "salt", "node", "size", "place"], None  # the first and last row of a run that may go on
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in names_in]
            if not len(columns[0]):
                continue
            own = 0 if held is None else len(held[0])
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            k, s, n = columns[:3]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
            fresh = new | np.concatenate(([True], n[1:] != n[:-1]))
            own = int(fresh[:own].sum())
            k, s, n, size, place = (c[fresh] for c in columns)
            first = np.flatnonzero(new[fresh])
            length = np.diff(np.append(first, len(k)))
            head = np.repeat(first, length)
            y = np.flatnonzero(np.arange(len(k)) > head)
            x, y = np.concatenate((head[y], y - 1)), np.concatenate((y, y))
            good = _fit(similarity, size, place, x, y)
            pairs = _pairs(n[x[good]], n[y[good]])
            open_ = np.isin(head, (first[0], first[-1]))  # may have rows in other batches
            rest = np.flatnonzero((open_ | (s > 0) | (np.repeat(length, length) > 3)) & (np.arange(len(k)) >= own))
            a = [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int32())]
            yield pa.RecordBatch.from_arrays(a, names)
            b = [pa.array(n[rest]), pa.nulls(len(rest), pa.int64()), pa.array(k[rest]), pa.array(size[rest].astype(np.int32)), pa.array(place[rest].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(b, names)
            ends = np.unique([first[-1], len(k) - 1])
            held = tuple(c[ends] for c in (k, s, n, size, place))

    return read


def fold(bits: np.ndarray, length: int) -> np.ndarray:
    """Parity bits as bytes, folded to ``length`` bytes: a shingle's place among fewer bits is its place among more, modulo."""
    return np.bitwise_xor.reduce(bits.reshape(-1, length), axis=0)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Bytes of parity bits of a set of hashes: a power of two of bits, RUN_BITS or more, and twice the shingles or more."""
    n = max(RUN_BITS, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else RUN_BITS
    place = (shingles & np.array(n - 1, shingles.dtype)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=n) & 1).astype(bool), bitorder="little")


#: Pairs compared at a time, and pairs of texts gathered before they are given.
COMPARED = 1 << 22


def _other_links(similarity: float, nearest: int | None):
    """Pairs (u, v, null) of different root from (key, i, j, block, node, size, place, root, bits) sorted by key, i and j.

    Where i and j differ, of pairs of one from block i and one from block j. ``nearest``: of a text that many with the least
    difference in parity bits, and keys (null, null, key) of which there are more; None: all that the bits let pass.
    """
    slack = (1 - similarity) / (1 + similarity)  # sets of sizes a and b may differ in this share of a + b

    def chosen(y: np.ndarray, x: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Which pairs are among the ``nearest`` of either of their two texts."""
        keep = np.zeros(len(y), bool)
        for one, other in ((y, x), (x, y)):
            order = np.lexsort((other, apart, one))
            head = np.flatnonzero(np.concatenate(([True], one[order][1:] != one[order][:-1])))
            rank = np.arange(len(one)) - np.repeat(head, np.diff(np.append(head, len(one))))
            keep[order[rank < nearest]] = True
        return keep

    def settle(k: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray, n: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        at = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
        apart = i != j
        found, total, y, step = [], 0, np.arange(len(k)), 0
        while len(y):
            step += 1
            y = y[at[y] >= step]
            z = y[(root[y] != root[y - step]) & ((block[y] != block[y - step]) | ~apart[y])]
            z = z[_fit(similarity, size, place, z - step, z)]
            far = np.bitwise_count(bits[z] ^ bits[z - step]).sum(1, dtype=np.int64)
            fine = far <= (size[z] + size[z - step]) * slack + 1e-9
            found.append((z[fine], z[fine] - step, far[fine]))
            total += int(fine.sum())
            if total and (total > COMPARED or not len(y)):
                a, b, far = (np.concatenate(c) for c in zip(*found, strict=True))
                if nearest is not None:
                    keep = chosen(a, b, far)
                    more = np.unique(k[a[~keep]])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more)], ["u", "v", "key"])
                    a, b = a[keep], b[keep]
                pairs = _pairs(n[a], n[b])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], ["u", "v", "key"])
                found, total = [], 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "block", "node", "size", "place", "root")]
            held.append([*numbers, np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, RUN_BITS // 64)])
            if all(held[-1][c][-1] == held[0][c][0] for c in range(3)):
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]) & (whole[2] == whole[2][-1])
            cut = int(np.argmax(last))  # the last block pair may go on
            yield from settle(*(c[:cut] for c in whole))
            held = [[c[cut:] for c in whole]]
        if held:
            yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return read


def _wanted_sets(words: int, wanted, columns: tuple[str, ...]):
    """(node, ``columns``) of the texts whose node may be wanted: size, bits and parity, or shingles."""

    def made(column: str, sets: list[np.ndarray]) -> pa.Array:
        if column == "size":
            return pa.array([len(s) for s in sets], pa.int32())
        if column == "shingles":
            # The upper halves of the hashes: of two texts of n shingles about n * n / 2**32 are equal by chance.
            return pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())
        parity = [parity_bits(s) for s in sets]
        return pa.array([(p if column == "parity" else fold(p, RUN_BITS // 8)).tobytes() for p in parity], pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = wanted.value
        for batch in batches:
            nodes, once = np.unique(batch.column("node").to_numpy(), return_index=True)
            at = (nodes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = np.flatnonzero(kept[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for first, part in column_blocks(batch.column("text"), at=once[hit]):
                h, of = _shingles(part, words)
                ends = np.searchsorted(of, np.arange(len(part) + 1))
                sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit[first : first + len(part)]]), *(made(c, sets) for c in columns)], ["node", *columns])

    return read


def _of_nodes(rows: DataFrame, words: int, nodes: DataFrame, *columns: str) -> DataFrame:
    """(node, ``columns``) of ``rows`` for the nodes in column c of ``nodes`` at least, each once, as a table."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(nodes, "c"))
    kinds = {"size": "int"}
    made = rows.mapInArrow(_wanted_sets(words, sent, columns), ", ".join(["node long", *(f"{c} {kinds.get(c, 'binary')}" for c in columns)]))
    return materialize(made.groupBy("node").agg(*(F.first(c).alias(c) for c in columns)), "similar-sets")


def _near_enough(similarity: float):
    """Pairs (u, v) whose parity bits do not rule the similarity out, of (u, v, a, b, m, n): bits and sizes."""
    slack = (1 - similarity) / (1 + similarity)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "n")), strict=True):
                a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                least = min(len(a), len(b))
                keep.append(int(np.bitwise_count(fold(a, least) ^ fold(b, least)).sum()) <= (m + n) * slack + 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], ["u", "v"])

    return read


def _similar(similarity: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9 and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], ["u", "v"])

    return read


def _sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of u as a and m, and of v as b and n."""
    for side, names in (("u", "am"), ("v", "bn")):
        pairs = pairs.join(of.select(F.col("node").alias(side), *(F.col(c).alias(n) for c, n in zip(columns, names, strict=False))), side)
    return pairs


def _verified(rows: DataFrame, signs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles are similar; sets are made for pairs that pass on their parity bits only."""
    near = materialize(_sides(pairs, signs, "parity", "size").select("u", "v", "a", "b", "m", "n").mapInArrow(_near_enough(similarity), "u long, v long"), "similar-near")
    if near.isEmpty():
        return near
    sets = _of_nodes(rows, words, near.select(F.col("u").alias("c")).union(near.select(F.col("v").alias("c"))), "shingles")
    links = materialize(_sides(near, sets, "shingles").select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long"), "similar-verified")
    release(sets)
    return links


def _block_pairs(runs: DataFrame, limit: int) -> DataFrame:
    """``runs`` with i, j and block: runs of more than ``limit`` rows are cut into blocks, and each row goes to all pairs of its own.

    So a task compares about two blocks at a time, and every two rows of a run meet under one (key, i, j).
    """
    count = F.ceil(F.col("rows") / F.lit(limit)).cast("int")
    cut = runs.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in runs.columns if c not in ("key", "rows")]
    return other.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *rest)


def variant_pairs(rows: DataFrame, *, bits: int = BITS, run_limit: int = RUN) -> DataFrame:
    """Pairs (u, v) of nodes of the (node, text) in ``rows`` that connect all whose fingerprints differ in at most ``bits`` bits.

    As in ``near_duplicates``: deletion variants of two halves, an equality shuffle, and links verified by their distance. Nodes of one
    fingerprint are paired with the first of them.
    """
    made = rows.select(F.col("node").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, mark long")
    marks = materialize(made.groupBy("doc_id").agg(F.first("mark").alias("mark")), "similar-marks")
    heads = materialize(marks.groupBy("mark").agg(F.min("doc_id").alias("head")), "similar-heads")
    links = near_links(heads.select("mark"), bits=bits, run_limit=run_limit)
    for side in "uv":
        links = links.join(heads.select(F.col("mark").alias(side), F.col("head").alias(f"_{side}")), side)
    same = marks.join(heads, "mark").where("doc_id <> head").select(F.col("doc_id").alias("_u"), F.col("head").alias("_v"))
    return links.select("_u", "_v").union(same).select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))


def similar_roots(rows: DataFrame, words: int, similarity: float, run_limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of the (node, text) in ``rows`` that are linked: those whose sets of shingles have the similarity."""
    context = rows.sparkSession.sparkContext
    near = materialize(variant_pairs(rows), "similar-variants")
    rarity = context.broadcast(_shingle_rarity(rows, words))
    keyed = rows.mapInArrow(_shingle_prefixes(words, similarity, rarity, hot_rows), "key long, salt int, node long, size int, place int")
    keyed = keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    found = materialize(keyed.mapInArrow(_first_links(similarity), "u long, v long, key long, size int, place int"), "similar-runs")
    pairs = materialize(found.where("key is null").select("u", "v").union(near).distinct(), "similar-pairs")
    runs = found.where("key is not null").select("key", F.col("u").alias("node"), "size", "place")
    named = found.select(F.col("u").alias("c")).union(pairs.select(F.col("v").alias("c"))).union(near.select(F.col("u").alias("c")))
    signs = _of_nodes(rows, words, named, "size", "bits", "parity")
    links, tried = _verified(rows, signs, pairs, words, similarity), pairs
    roots = materialize(connected_components(links, "similar-links"), "similar-roots")
    for nearest in (NEAREST, None):
        marked = signs.select("node", "bits").join(roots, "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root"))
        rooted = materialize(runs.join(marked, "node"), "similar-left")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high")
        left = _block_pairs(rooted.join(mixed.select("key", "rows"), "key"), run_limit)
        left = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        listed = materialize(left.mapInArrow(_other_links(similarity, nearest), "u long, v long, key long").distinct(), "similar-listed")
        more = materialize(listed.where("u is not null").select("u", "v").join(tried, ["u", "v"], "left_anti"), "similar-more")
        release(rooted)
        if not more.isEmpty():
            new = _verified(rows, signs, more, words, similarity)
            links, tried = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new), tried.union(more)
            roots = materialize(connected_components(links, "similar-links"), "similar-roots")
        runs = runs.join(listed.where("u is null").select("key"), "key", "left_semi")  # where not all was listed
    for df in (found, signs):
        release(df)
    return roots


def text_nodes(docs: DataFrame, node=None) -> DataFrame:
    """(doc_id, node, text): equal texts and no others have one node.

    A node is a 64-bit hash of the text. Where two texts share one, which a second hash shows, their nodes are made of both.
    """
    text = F.coalesce("text", F.lit(""))
    node = F.xxhash64(text) if node is None else node(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), text.cast("binary").alias("text"))
    other = F.xxhash64(F.lit("other"), "text")
    spread = rows.groupBy("node").agg(F.min(other).alias("low"), F.max(other).alias("high"))
    clash = materialize(spread.where("low <> high").select(F.col("node").alias("_node")), "similar-clash")  # about n * n / 2**65 of n texts
    if clash.isEmpty():
        return rows
    both = rows.join(clash, F.col("node") == F.col("_node"), "left")
    return both.select("doc_id", F.when(F.col("_node").isNull(), F.col("node")).otherwise(F.xxhash64("node", other)).alias("node"), "text")


def similar_documents(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, run_limit: int = 2048, hot_rows: int = HOT_ROWS, node=None) -> DataFrame:
    """One row per document: doc_id, node (of its text), component_id, the smallest doc_id of the texts linked to its own.

    Texts are linked whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``: all of
    them are found, and every link is verified.
    """
    rows = text_nodes(docs, node)
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "similar-nodes")
    roots = similar_roots(rows.select("node", "text"), words, similarity, run_limit, hot_rows)
    linked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(materialize(named, "similar-components"), "node").select("doc_id", "node", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Documents without the near-duplicates of others; of each component the row with the smallest doc_id stays.

    Rows that repeat the identifier that stays count as one document: the one whose text has the smallest hash stays, then the one
    whose other columns, as JSON, have; of rows equal in all columns any. Rows without identifier stay.
    """
    found = similar_documents(docs.where("doc_id is not null"), **options)
    rows = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("rows"))
    rows = materialize(rows.where("rows <> 1"), "similar-dropped")
    key = F.col("doc_id").cast("long")
    stay = rows_without(docs, [key], rows.where("rows = 0").select("doc_id"))
    twice = rows.where("rows > 1").select("doc_id")
    if twice.isEmpty():
        return stay
    start = _free(docs)
    own, place = [F.col(f"`{c}`") for c in docs.columns], F.struct(F.xxhash64("text"), F.sha2("text", 256), F.to_json(as_struct(docs.columns, "row")))
    repeated = stay.withColumn(f"{start}key", key).join(twice.withColumnRenamed("doc_id", f"{start}key"), f"{start}key", "left_semi")
    repeated = repeated.select(f"{start}key", place.alias(f"{start}place"), *own)
    one = repeated.groupBy(f"{start}key").agg(F.min_by(F.struct(*own), f"{start}place").alias(f"{start}row"))
    return rows_without(stay, [key], twice).unionByName(one.select(f"{start}row.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
