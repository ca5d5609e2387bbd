"""Line deduplication as an exact set-similarity join.

A line is a set of words. Words are ordered by rarity over all documents; two lines whose Jaccard similarity is at least
``SIMILARITY`` share a word among the rarest few of each (prefix filter). Lines that share such a word are compared by their
sizes (length filter), by where in the order the word stands (positional filter) and by a parity signature that bounds their
difference; what is left is verified on the full sets. A line is removed if any earlier line is equal or similar to it,
whether that one stays or not. Earlier: smaller doc_id, then line number; ties go by hash.

Lines that are equal as bags of words form a class, found by a 128-bit sum over their words, and only the first line of a class
is compared. A class goes by the first 64 bits of its sum; classes that share these, about n*n/2**65 of n, are found and renamed. To know that a class has an earlier match one verified match is enough, so of the earlier lines that pass all
filters the nearest two are verified first; classes that these do not settle have more of their list verified, in ``STEPS``,
and where the last step does not settle one with a longer list, all of it is listed and verified. Large groups of similar
lines are settled in the first step and nothing is dropped. Lines that share one of the most common words as their rarest are
dealt to several tasks and first compared within each, and in very long runs with many but not all before them; those that this
does not settle are compared with all.

Rarity is counted over all words in 2**RARITY_BITS counters (32 MB as sent to tasks, whatever the input); words that share a
counter count as more common than they are, which changes the order only, the same way everywhere, never the result.

Defined cases
- null text stays null. Lines end at line feeds; lines without words always stay.
- rows that repeat identifier and text are later copies of one document: of them one row keeps lines with words.
- null identifiers come first. Extra columns are kept by ``dedup_lines``; those it adds (n_lines, kept_lines, removed) take the
  place of columns of the same name. An empty table, or one without a word, loses no line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, release
from ..sources.tables import read_table
from .alike import as_struct, number_alike
from .bits import FILTER_BITS, bitmap, mark
from .words import SPACES, column_blocks, hash_words, mix, numbered

SIMILARITY, RARITY_BITS, SLICE_BITS = 0.8, 25, 16
LONG_RUN = 512
#: Lines whose rarest words occur more often than this are dealt to several tasks by their class.
HOT_RUN = 1 << 22
#: In a run of more lines than this a line is first compared with as many before it and as many at the run's begin.
WIDE = 1 << 15
#: How many of the nearest earlier lines are verified in each step; a step is for lines that the ones before it did not settle.
STEPS = (2, 64, 512)
#: Words whose counters are added up at a time.
COUNTED = 2_000_000
_K1, _K2, _K3 = (np.uint64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


class Lines:
    """Words of the lines of some texts: hashes, and per line with words its text, number, first word and class sums.

    ``class_bits`` is less than 64 in tests only, to make first sums clash.
    """

    def __init__(self, texts: list[bytes], class_bits: int = 64):
        self.hashes, which, starts, data = hash_words(texts, SPACES)
        ends = np.flatnonzero(data == 10)
        line = numbered(starts, ends)  # texts are joined by a line end, so lines are counted through
        new = np.concatenate(([True], line[1:] != line[:-1])) if len(line) else np.empty(0, bool)
        self.first = np.flatnonzero(new)
        self.text = which[self.first]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(sizes) - sizes
        self.number = line[self.first] - np.searchsorted(ends, begin)[self.text] if len(line) else line
        self.of_word = np.cumsum(new) - 1
        self.classes = [np.add.reduceat(mix(self.hashes ^ k), self.first) if len(line) else self.hashes for k in (_K1, _K2)]
        self.classes[0] &= np.uint64((1 << class_bits) - 1)

    def ids(self, clash: np.ndarray) -> np.ndarray:
        return class_ids(*self.classes, clash)


def class_ids(c1: np.ndarray, c2: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Names of classes: the first sum, or where that is one of ``clash`` (sorted), a hash of both."""
    if not len(clash):
        return c1
    at = np.minimum(np.searchsorted(clash, c1), len(clash) - 1)
    return np.where(clash[at] == c1, mix(c1 ^ mix(c2 ^ _K3)), c1)


def _renamed(clash: np.ndarray):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = class_ids(*(batch.column(c).to_numpy().view(np.uint64) for c in ("c1", "c2")), clash)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *batch.columns[1:]], batch.schema.names)

    return read


def _first_pass(class_bits: int):
    """Rows with c1: the first line of each class in a block; with a slice: sums of the rarity counters by slice; others: lines with words of a text."""
    names = ["c1", "c2", "doc_id", "sum", "line", "slice", "places", "counts"]
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def out(columns: dict[str, object], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), []
        for batch in batches:
            ids, sums = batch.column("doc_id"), batch.column("sum").to_numpy()
            for first, texts in column_blocks(batch.column("text")):
                lines = Lines(texts, class_bits)
                waiting.append((lines.hashes >> np.uint64(64 - RARITY_BITS)).astype(np.uint32))
                if sum(map(len, waiting)) > COUNTED:
                    places, counts = _add_counts(places, counts, waiting)
                    waiting = []
                c1, c2 = (c.view(np.int64) for c in lines.classes)
                rows = pa.array(lines.text + first)
                yield out({"c1": c1, "c2": c2, "doc_id": ids.take(rows), "sum": sums[lines.text + first], "line": lines.number.astype(np.int32)}, len(c1))
                some, counts_of = np.unique(lines.text, return_counts=True)
                yield out({"doc_id": ids.take(pa.array(some + first)), "sum": sums[some + first], "line": counts_of.astype(np.int32)}, len(some))
        places, counts = _add_counts(places, counts, waiting)
        slices = (places >> np.uint64(SLICE_BITS)).astype(np.int64)
        for a, b in _runs_of(slices):  # none in a part without words
            inside = (places[a:b] & np.uint64((1 << SLICE_BITS) - 1)).astype("<u2")
            yield out({"slice": [int(slices[a])], "places": [inside.tobytes()], "counts": [counts[a:b].astype("<u8").tobytes()]}, 1)

    return read


def _runs_of(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(sorted_values):
        return []
    edges = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_values)], strict=True))


def _add_counts(places: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and their counts, with one more for each of ``more``."""
    if not more:
        return places, counts
    new = np.sort(np.concatenate(more))
    heads = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1]))) if len(new) else np.empty(0, np.int64)
    n = np.diff(np.append(heads, len(new)))
    # A place and its count are sorted as one number: a task counts fewer than 2**(64 - RARITY_BITS) words.
    room = np.uint64(64 - RARITY_BITS)
    both = np.sort(np.concatenate((places << room | counts.astype(np.uint64), new[heads].astype(np.uint64) << room | n.astype(np.uint64))))
    places = both >> room
    heads = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.empty(0, np.int64)
    counts = both & ((np.uint64(1) << room) - np.uint64(1))
    return places[heads], (np.add.reduceat(counts, heads) if len(heads) else counts).astype(np.int64)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters by slice, as the rows come; memory for the slices of this task only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts")), strict=True):
            sums.setdefault(n, np.zeros(1 << SLICE_BITS, np.uint64))[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u8")
    for n, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([total[at].astype("<u8").tobytes()])], ["slice", "places", "counts"])


def _as_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _add_up(batches):
        codes = np.zeros(1 << SLICE_BITS, np.uint8)
        at = np.frombuffer(batch.column("places")[0].as_py(), "<u2")
        codes[at] = np.log2(np.frombuffer(batch.column("counts")[0].as_py(), "<u8").astype(float)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array([codes.tobytes()])], ["slice", "codes"])


def _needed(similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of sizes a and b."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)


def _dealt(hot: int) -> np.ndarray:
    """By logarithm of a counter, over how many tasks the lines of a word are dealt."""
    return np.array([1 << max(0, c - int(np.log2(hot))) for c in range(64)])


def _in_order(known: np.ndarray, ids: np.ndarray, number: np.ndarray) -> bool:
    """Whether lines come in the order of their places, as they do where rows are stored by identifier."""
    step = np.diff(ids)
    return bool(known.all() and ((step > 0) | ((step == 0) & (np.diff(number) >= 0))).all())


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit set in a bitmap."""
    at = (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: A prefix row. ``at``: size of the line, place of the word from bit 31 on, whether the word is hot in bit 62.
RECORD = {"run": "<u8", "at": "<i8", "c1": "<i8", "parity": "<u8", "parity2": "<u8", "doc_id": "<i8", "line": "<i4", "known": "<u1"}
_BYTES = sum(np.dtype(t).itemsize for t in RECORD.values())
#: Prefix rows that a task gathers before it sends them, and buckets of runs to a partition.
GATHERED, BUCKETS = 100_000, 8


def _as_blobs(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Gathered rows as (bucket, rows), a row for each bucket, column by column, which packs well."""
    columns = {c: np.concatenate([h[c] for h in held]).astype(t, copy=False) for c, t in RECORD.items()}
    bucket = (mix(columns["run"] ^ _K1) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = {c: v[order] for c, v in columns.items()}, bucket[order]
    runs = _runs_of(bucket)
    blobs = [b"".join(v[a:b].tobytes() for v in columns.values()) for a, b in runs]
    return pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in runs]]), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def _from_blobs(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Rows of a bucket by run, and of each run by first line; runs of one row, which has nothing to be compared with, are left out."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in RECORD}
    for blob in blobs:
        n, at = len(blob) // _BYTES, 0
        for c, t in RECORD.items():
            parts[c].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    run = np.concatenate(parts["run"])
    order = np.argsort(run)
    same = run[order][1:] == run[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    hot = np.flatnonzero(np.concatenate(parts["at"]) >> 62)  # lines of a hot word are compared with those of its other tasks later
    if len(hot):
        order = np.union1d(order, hot)
        order = order[np.argsort(run[order])]
    rows = {c: np.concatenate(v) for c, v in parts.items()}
    order = order[_by_place({c: rows[c][order] for c in ("run", "known", "doc_id", "line", "c1")})]
    return {c: v[order] for c, v in rows.items()}


def _by_place(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Order by run, null or not, identifier, line and class, of rows that have equal runs together."""
    n, c1 = len(rows["run"]), rows["c1"]
    if n:
        run = np.cumsum(np.concatenate(([False], rows["run"][1:] != rows["run"][:-1])))
        least, lines = int(rows["doc_id"].min()), int(rows["line"].max()) + 1
        span = int(rows["doc_id"].max()) - least + 1
        if 2 * (int(run[-1]) + 1) * span * lines < 1 << 63:  # all but the class as one number, of which one sort is enough
            key = ((run * 2 + rows["known"]) * span + (rows["doc_id"] - least)) * lines + rows["line"]
            order = np.argsort(key)
            key = key[order]
            if not ((key[1:] == key[:-1]) & (c1[order][1:] != c1[order][:-1])).any():
                return order
    return np.lexsort((c1, rows["line"], rows["doc_id"], rows["known"], rows["run"]))


def _first_of_classes(run: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The first row of each class of each run, in the order of rows."""
    if not len(run):
        return np.empty(0, np.int64)
    key = mix(c1.view(np.uint64) ^ mix(run.astype(np.uint64) ^ _K2))
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    if (~new[1:] & ((c1[order][1:] != c1[order][:-1]) | (run[order][1:] != run[order][:-1]))).any():  # two share a key
        order = np.lexsort((c1, run))
        new = np.concatenate(([True], (run[order][1:] != run[order][:-1]) | (c1[order][1:] != c1[order][:-1])))
    return np.sort(np.minimum.reduceat(order, np.flatnonzero(new)))


def _prefixes(rarity, similarity: float, clash: np.ndarray, class_bits: int, hot: int, buckets: int, asking=None, tokens=None, words_only: bool = False):
    """(bucket, rows): blocks of RECORD, one for each prefix word of a line; words that stand nowhere else are left out.

    ``run`` is a word, or of a hot word's lines those dealt to one task. With ``asking``, a bitmap of classes, lines of
    those go to all tasks of a word; with ``tokens``, a bitmap too, the rows of those words only are given. With ``words_only``
    the rows are the prefix words (c) of the asking lines.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rarity.value
        dealt = _dealt(hot)
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            ids = batch.column("doc_id")
            for start, texts in column_blocks(batch.column("text")):
                lines = Lines(texts, class_bits)
                h, of = lines.hashes, lines.of_word
                if not len(h):
                    continue
                # Equal lines of a block have equal prefixes: the earliest is sent, in whatever order rows are stored.
                c1, own = lines.ids(clash), ids.take(pa.array(lines.text + start))
                known, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
                use = np.zeros(len(lines.first), bool)
                if _in_order(known, own, lines.number):
                    use[np.unique(c1, return_index=True)[1]] = True
                else:
                    order = np.lexsort((lines.number, own, known, c1))
                    use[order[np.concatenate(([True], c1[order][1:] != c1[order][:-1]))]] = True
                h, of = h[use[of]], of[use[of]]
                code = codes[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                packed = of.astype(np.uint64) << np.uint64(43) | code.astype(np.uint64) << np.uint64(37) | h >> np.uint64(27)
                order = np.argsort(packed) if len(lines.first) < 1 << 21 else np.lexsort((h, code, of))
                close = packed[order]
                if len(lines.first) < 1 << 21 and ((close[1:] == close[:-1]) & (h[order][1:] != h[order][:-1])).any():
                    order = np.lexsort((h, code, of))
                h, of, code = h[order], of[order], code[order]
                fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
                h, of, code = h[fresh], of[fresh], code[fresh]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                size = np.diff(np.append(first, len(h)))
                place = np.arange(len(h)) - np.repeat(first, size)
                spread = mix(h ^ _K3)
                bits, upper = np.uint64(1) << (spread & np.uint64(63)), spread >> np.uint64(63)
                # Each word turns one of 128 bits, in one of two parts.
                parity, parity2 = (np.bitwise_xor.reduceat(np.where(upper == part, bits, np.uint64(0)), first) for part in (0, 1))
                n = np.repeat(size, size)
                # Sets of three words or fewer have no similar set but themselves, of 0.8 that is.
                some = (place <= n - np.ceil(similarity * n - 1e-9)) & (code > 0)
                if tokens is not None:
                    some &= _marked(tokens.value, h)
                if words_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[some & _marked(asking.value, c1)[of]]).view(np.int64))], ["c"])
                    continue
                at = np.flatnonzero(some)
                over = dealt[code[at]]
                salt = np.where(over > 1, 1 + (mix(c1[of[at]] ^ _K1) % over.astype(np.uint64)).astype(np.int64), 0)
                if asking is not None:  # a row in each of the word's tasks
                    times = np.where((over > 1) & _marked(asking.value, c1[of[at]]), over, 1)
                    each = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    salt = np.where(np.repeat(times, times) > 1, 1 + each, np.repeat(salt, times))
                    at = np.repeat(at, times)
                line = of[at]
                rank = np.searchsorted(of[first], line)
                run = np.where(salt > 0, mix(h[at] ^ salt.astype(np.uint64) * _K2), h[at])
                packed_at = n[at] | place[at] << 31 | (salt > 0).astype(np.int64) << 62
                held.append({"run": run, "at": packed_at, "c1": c1.view(np.int64)[line], "parity": parity[rank], "parity2": parity2[rank], "doc_id": own[line], "line": lines.number[line], "known": known[line]})
                if sum(len(x["run"]) for x in held) >= GATHERED:
                    yield _as_blobs(held, buckets)
                    held = []
        if held:
            yield _as_blobs(held, buckets)

    return read


def _candidates(similarity: float, listed: int | None, only, wide: int = WIDE):
    """Reads prefix rows by bucket; gives (c1, near: earlier classes that pass all filters, nearest first, more), and rows of
    place alone: where the first lines of all these classes stand, once for a bucket.

    All runs at hand are compared together, each row with the ones 1, 2, ... before it; a run
    longer than ``LONG_RUN`` is compared on its own, a row with all before it. ``more``: not all earlier classes are in the list.
    """
    slack = (1 - similarity) / (1 + similarity)  # sets of sizes a and b may differ in this share of a + b

    def pass_filters(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of rows pass, and how far their signatures are apart."""
        both = r["size"][x] + r["size"][y]
        apart = np.bitwise_count(r["parity"][x] ^ r["parity"][y]).astype(np.int64) + np.bitwise_count(r["parity2"][x] ^ r["parity2"][y])
        fine = np.flatnonzero(apart <= both * slack + 1e-9)
        x, y, apart = x[fine], y[fine], apart[fine]
        need = _needed(similarity, r["size"][x], r["size"][y])
        room = np.minimum(r["size"][x] - r["place"][x], r["size"][y] - r["place"][y])
        good = (np.minimum(r["size"][x], r["size"][y]) >= need) & (room >= need)
        return fine[good], apart[good]

    def settle(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(r["run"])
        if not n:
            return
        run = np.cumsum(np.concatenate(([True], r["run"][1:] != r["run"][:-1]))) - 1
        keep = _first_of_classes(run, r["c1"])  # of a class the first line, as rows come in that order
        r, run = {k: v[keep] for k, v in r.items()}, run[keep]
        r |= {"size": r["at"] & 0x7FFFFFFF, "place": r["at"] >> 31 & 0x7FFFFFFF, "hot": r["at"] >> 62 > 0}
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        sizes = np.diff(np.append(starts, len(run)))
        wanted = np.ones(len(run), bool)
        if only is not None:
            wanted = _marked(only.value, r["c1"].view(np.uint64))
        long_ = np.repeat(sizes > LONG_RUN, sizes)
        place = np.arange(len(run)) - np.repeat(starts, sizes)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active, step = np.flatnonzero(wanted & ~long_ & (place > 0)), 0
        while len(active):
            step += 1
            active = active[place[active] >= step]
            fine, apart = pass_filters(r, active - step, active)
            found.append((active[fine], active[fine] - step, apart))
        for y in np.flatnonzero(wanted & long_ & (place > 0)).tolist():
            begin = y - int(place[y])
            x = np.arange(begin, y)
            if listed is not None and len(x) > 2 * wide:
                x = np.concatenate((x[:wide], x[-wide:]))
            fine, apart = pass_filters(r, x, np.full(len(x), y))
            if listed is not None and len(fine) > listed + 1:
                nearest = np.argsort(apart, kind="stable")[: listed + 1]
                fine, apart = fine[nearest], apart[nearest]
            found.append((np.full(len(fine), y), x[fine], apart))
        empty = np.empty(0, np.int64)
        y, x, apart = (np.concatenate(c) for c in zip((empty, empty, empty), *found, strict=True))
        order = np.lexsort((x, apart, y))
        y, x = y[order], x[order]
        heads = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))) if len(y) else y
        counts = np.diff(np.append(heads, len(y)))
        if listed is not None:
            x = x[np.arange(len(y)) - np.repeat(heads, counts) < listed]
        lengths = counts if listed is None else np.minimum(counts, listed)
        near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(r["c1"][x], pa.int64()))
        cut = counts > lengths
        if listed is not None:
            part = r["hot"] | (place > 2 * wide)  # compared with some of the earlier lines only
            cut |= part[y[heads]]
            alone = np.unique(r["c1"][np.setdiff1d(np.flatnonzero(part), y)])
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(alone) + 1), pa.int32()), pa.array([], pa.int64()))
            yield out(pa.array(alone), none, pa.array(np.ones(len(alone), bool)))
        yield out(pa.array(r["c1"][y[heads]], pa.int64()), near, pa.array(cut))
        named = np.unique(np.concatenate((x, y)))
        places = np.unique(_places(r["doc_id"][named], r["line"][named]))
        none = (pa.nulls(len(places), k) for k in (pa.int64(), near.type, pa.bool_()))
        yield out(*none, pa.array(places.view(np.int64)))

    def out(c1: pa.Array, near: pa.Array, more: pa.Array, place: pa.Array | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c1, near, more, pa.nulls(len(c1), pa.int64()) if place is None else place], ["c1", "near", "more", "place"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, now = [], None
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if blobs and bucket != now:
                    yield from settle(_from_blobs(blobs))
                    blobs = []
                now = bucket
                blobs.append(rows)
        if blobs:
            yield from settle(_from_blobs(blobs))

    return read


def _places(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hashes of places of lines: identifier (of null: 0) and line number. Places that share one are let through together."""
    return mix(mix(ids.view(np.uint64) ^ _K1) + number.astype(np.uint64) * _K3)


def _sets(wanted, clash: np.ndarray, class_bits: int):
    """(c1, words): the sorted distinct word hashes of lines whose place may be wanted; only these lines are read by words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for start, texts in column_blocks(batch.column("text")):
                data = b"\n".join(texts)
                ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data))
                begin = np.concatenate(([0], ends[:-1] + 1))
                sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
                first = np.searchsorted(begin, np.cumsum(sizes) - sizes)  # of each text its first line
                times = np.diff(np.append(first, len(ends)))
                number = np.arange(len(ends)) - np.repeat(first, times)
                hit = np.flatnonzero(_marked(wanted.value, _places(np.repeat(ids[start : start + len(texts)], times), number)))
                lines = Lines([data[a:b] for a, b in zip(begin[hit].tolist(), ends[hit].tolist(), strict=True)], class_bits)
                c1, once = np.unique(lines.ids(clash), return_index=True)
                ends = np.append(lines.first, len(lines.hashes))
                words = [np.unique(lines.hashes[ends[i] : ends[i + 1]]).tobytes() for i in once.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(words, pa.binary())], ["c1", "words"])

    return read


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays without repeats."""
    together = np.concatenate((a, b))
    together.sort()
    both = np.count_nonzero(together[1:] == together[:-1])
    return both / (len(together) - both)


def _verify(similarity: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("words", "other"))
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-12 for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("c1").filter(pa.array(good, pa.bool_()))], ["c1"])

    return read


def _rarity(first: DataFrame) -> np.ndarray:
    """Per counter the whole part of the logarithm of its count: 0 where all its words together occur once."""
    sums = first.where("slice is not null").select("slice", "places", "counts")
    groups = max(1, sums.rdd.getNumPartitions() // 256)
    if groups > 1:  # a tree of sums, so that no task reads the counters of all tasks
        sums = sums.repartition("slice", F.pmod(F.xxhash64("counts"), F.lit(groups))).mapInArrow(_add_up, "slice int, places binary, counts binary")
    codes = np.zeros((1 << RARITY_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for r in sums.repartition("slice").mapInArrow(_as_logs, "slice int, codes binary").collect():  # one row per slice
        codes[r["slice"]] = np.frombuffer(r["codes"], np.uint8)
    return codes.reshape(-1)


def later_matches(docs: DataFrame, *, similarity: float = SIMILARITY, steps: tuple[int, ...] = STEPS, hot: int = HOT_RUN, class_bits: int = 64, wide: int = WIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first lines of classes: c1, doc_id, sum, line; c1 of the classes with an earlier similar line; lines with words by doc_id and sum, and rows)."""
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sum"), F.col("text").cast("binary").alias("text"))
    first = materialize(rows.mapInArrow(_first_pass(class_bits), "c1 long, c2 long, doc_id long, sum long, line int, slice int, places binary, counts binary"), "lines-first")
    rarity = spark.sparkContext.broadcast(_rarity(first))
    lines = first.where("c1 is not null").select("c1", "c2", "doc_id", "sum", "line")
    own = first.where("c1 is null and slice is null").groupBy("doc_id", "sum").agg(F.sum("line").alias("lines"), F.count(F.lit(1)).alias("rows"))
    own = materialize(own, "lines-own")
    earliest = F.min(F.struct("doc_id", "line", "sum")).alias("at")
    heads = materialize(lines.groupBy("c1").agg(earliest, F.min("c2").alias("low"), F.max("c2").alias("high")), "lines-heads")
    clash = np.sort(heads.where("low <> high").select("c1").toArrow()["c1"].to_numpy().view(np.uint64))  # about n * n / 2**65 of n classes
    if len(clash):
        heads = materialize(lines.mapInArrow(_renamed(clash), lines.schema).groupBy("c1").agg(earliest), "lines-heads")
    release(first)
    heads = heads.select("c1", "at.*")
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def candidates(listed: int | None, asking=None, tokens=None) -> DataFrame:
        prefixes = rows.select("doc_id", "text").mapInArrow(_prefixes(rarity, similarity, clash, class_bits, hot, buckets, asking, tokens), "bucket int, rows binary")
        dealt = prefixes.repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_candidates(similarity, listed, asking, wide), "c1 long, near array<long>, more boolean, place long")

    def sets_of(listed: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(bitmap(listed.where("place is not null"), "place"))
        made = rows.select("doc_id", "text").mapInArrow(_sets(sent, clash, class_bits), "c1 long, words binary")
        return materialize(made.groupBy("c1").agg(F.first("words").alias("words")), "lines-sets")

    found = materialize(candidates(steps[-1]), "lines-candidates")
    all_sets = [sets_of(found)]

    def verified(pairs: DataFrame) -> DataFrame:
        """c1 of the pairs (c1, other class) that are similar."""
        sets = all_sets[-1]
        other = sets.select(F.col("c1").alias("near"), F.col("words").alias("other"))
        return pairs.distinct().join(sets, "c1").join(other, "near").select("c1", "words", "other").mapInArrow(_verify(similarity), "c1 long").distinct()

    settled = spark.createDataFrame([], "c1 long")
    for low, high in zip((0, *steps), steps, strict=False):
        left = found.where(F.size("near") > low).join(settled, "c1", "left_anti")
        new = verified(left.select("c1", F.explode(F.slice("near", low + 1, high - low)).alias("near")))
        settled = materialize(settled.union(new), "lines-settled")
    long_ = materialize(found.where("more").select("c1").distinct().join(settled, "c1", "left_anti"), "lines-long")
    if not long_.isEmpty():
        asking = spark.sparkContext.broadcast(bitmap(long_, "c1"))
        words = rows.select("doc_id", "text").mapInArrow(_prefixes(rarity, similarity, clash, class_bits, hot, buckets, asking, words_only=True), "c long")
        tokens = spark.sparkContext.broadcast(bitmap(words, "c"))
        rest = materialize(candidates(None, asking, tokens), "lines-rest")
        all_sets.append(sets_of(rest))
        settled = settled.union(verified(rest.join(long_, "c1", "left_semi").select("c1", F.explode("near").alias("near"))))
    settled = materialize(settled.distinct(), "lines-removed")
    for df in (found, *all_sets):  # before texts are shuffled
        release(df)
    return heads, settled, own


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and n_lines, kept_lines, removed (line numbers from 0)."""
    heads, settled, own = later_matches(docs.select("doc_id", "text"), **options)
    stay = heads.join(settled, "c1", "left_anti").repartition("doc_id", "sum").groupBy("doc_id", "sum").agg(F.collect_list("line").alias("stay"))
    stay = stay.withColumnsRenamed({"doc_id": "_id", "sum": "_sum"})
    # Texts that lose lines, and those of which other rows repeat identifier and text. All others stay as and where they are.
    none = F.array().cast("array<int>")
    known = own.join(stay, own["doc_id"].eqNullSafe(stay["_id"]) & (own["sum"] == stay["_sum"]), "left").withColumn("stay", F.coalesce("stay", none))
    touched = known.where((F.col("lines") != F.size("stay")) | (F.col("rows") > 1))
    touched = materialize(touched.select(F.col("doc_id").alias("id"), F.col("sum").alias("key"), "stay", (F.col("rows") > 1).alias("many")), "lines-touched")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "kept_lines", "removed")]
    keyed = docs.select(as_struct(rest, "doc"), "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    keyed = mark(keyed, ["id", "key"], touched)
    other = touched.withColumnsRenamed({"id": "of", "key": "of_key"})
    joined = keyed.where("_marked").join(other, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")

    def whole(rows: DataFrame) -> DataFrame:
        n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
        return rows.select("doc", "text", n.alias("n_lines"), n.alias("kept_lines"), none.alias("removed"))

    def cut(rows: DataFrame, own_lines: Column, all_stay: Column) -> DataFrame:
        lines = rows.select("doc", F.split("text", "\n", -1).alias("lines"), own_lines.alias("own"), all_stay.alias("all"))
        numbers = F.sequence(F.lit(0), F.size("lines") - 1)
        blank = F.filter(numbers, lambda i: ~F.get("lines", i).rlike(r"[^\x20\x09-\x0D]"))
        lines = lines.select("doc", "lines", F.when(F.col("all"), numbers).otherwise(F.array_sort(F.concat(blank, "own"))).alias("kept"))
        text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
        n = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(a) for c, a in (("lines", "n_lines"), ("kept", "kept_lines"))]
        gone = F.coalesce(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("kept")), none)
        return lines.select("doc", F.when(F.col("lines").isNotNull(), text).alias("text"), *n, gone.alias("removed"))

    alone = joined.where("many is null or not many")
    out = whole(keyed.where("not _marked")).unionByName(cut(alone, F.coalesce("stay", none), F.col("many").isNull()))
    if not touched.where("many").isEmpty():
        copies = number_alike(joined.where("many").select("doc", "text", "id", "key", "stay"), ["id", "key"], "lines-copies")
        out = out.unionByName(cut(copies, F.when(F.col("n") == 1, F.col("stay")).otherwise(none), F.lit(False)))
    return out.select(*(F.col("doc")[c].alias(c) for c in rest), "text", "n_lines", "kept_lines", "removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "kept_lines", "removed", F.sha2(F.col("text"), 256).alias("text_sha256"))
