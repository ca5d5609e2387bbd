"""Benchmark decontamination by spaced-seed hashing.

A fixed mask covers some of the token positions of a window and ignores the rest, so a window keeps its hash when ignored
tokens are substituted. Hashes of the test items and of the documents are joined; around every hit the document and the
item are laid on each other and compared token by token.

An overlap counts where a window of ``WINDOW`` tokens (or the whole item if that is shorter) agrees in ``IDENTITY`` or more
of its places; an item of up to four tokens has to be there as it is. Tokens are lower-case runs of letters, marks and digits of
any script, and single characters of scripts that set no spaces. A document is contaminated if any overlap counts.

The documents are not shuffled: a Bloom filter over the test hashes, sized by their number within bounds, lets through the
places that may match, and only those, with a window of tokens around them, go into the join that decides. Every window that
counts has a hit inside it, so neither the filter nor the size of a region loses an overlap, however long items are.

Defined cases
- null or empty text: not contaminated. Null document identifiers are kept and reported as null.
- items without tokens, or null, match nothing; items shorter than a window have masks of their own.
- rows that repeat an identifier are judged by their own texts. Rows that repeat an item identifier are separate items;
  items of equal tokens are compared once.
- extra columns are ignored. An empty benchmark marks nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.tables import read_table
from .bits import rows_without
from .words import NOT_ALNUM, column_blocks, hash_words, mix

#: Offsets that a mask looks at. Of a window with as many substitutions as ``IDENTITY`` allows, wherever they are, one mask at
#: some place sees none.
MASKS = ((0, 1, 2, 4, 5, 7, 8), (0, 1, 3, 4, 6, 9, 10), (0, 2, 3, 5, 8, 9, 11), (0, 1, 2, 3, 4, 5, 6), (0, 1, 2, 6, 8, 10, 11))
WINDOW, IDENTITY = 13, 0.8
#: What is neither ASCII nor part of a word, and characters that are words by themselves.
SEPARATORS = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
SINGLES = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]\p{M}*"
#: The filter has 2**25 bits (4 MB) for up to two million test hashes, and more for more, up to 2**28 (32 MB); three bits stand for a hash.
FILTER_BITS = (25, 28)


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Masks for items of ``size`` < ``WINDOW`` tokens: without every choice of as many groups of places as may be substituted."""
    wrong = size - math.ceil(IDENTITY * size - 1e-9)
    width = 3 if size - 3 * wrong >= 5 else 2
    groups = [range(a, min(a + width, size)) for a in range(0, size, width)]
    return [tuple(i for i in range(size) if not any(i in g for g in out)) for out in combinations(groups, wrong)]


def _shapes(short: list[int]) -> list[tuple[int, ...]]:
    """The masks, and those of every size that short items have."""
    return [*MASKS, *(m for n in short for m in short_masks(n))]


def _seeds(hashes: np.ndarray, which: np.ndarray, shapes: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shape number, positions, seed hashes) of all windows that lie in one text."""
    for number, shape in enumerate(shapes):
        span = shape[-1] + 1
        n = len(hashes) - span + 1
        if n <= 0:
            continue
        seed = np.full(n, np.uint64(number * 0x5851F42D + 1))
        for k, offset in enumerate(shape):
            seed = seed + hashes[offset : offset + n] * np.uint64(2 * 0x9E3779B1 * (k + 1) ** 3 + 1)
            seed = mix(seed) if k == len(shape) // 2 else seed
        at = np.flatnonzero(which[:n] == which[span - 1 :])
        yield number, at, mix(seed[at])


def _filter_shifts(bits: int) -> tuple[int, ...]:
    return 0, (64 - bits) // 2, 64 - bits


def _filter_places(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [(seeds >> np.uint64(s)) & low for s in _filter_shifts(bits)]


def _items(short: list[int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for first, texts in column_blocks(batch.column("text")):
                hashes, which, _, _ = hash_words(texts, NOT_ALNUM)
                starts = np.searchsorted(which, np.arange(len(texts) + 1))
                shapes, own = _shapes(short), [n for n in short for _ in short_masks(n)]
                for number, at, seeds in _seeds(hashes, which, shapes):
                    item = which[at]
                    size = np.diff(starts)[item]
                    # Masks of less than a window serve the items of just that size, laid on their first token.
                    use = size >= WINDOW if number < len(MASKS) else (size == own[number - len(MASKS)]) & (at == starts[item])
                    at, seeds, item = at[use], seeds[use], item[use]
                    yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array([keys[first + i] for i in item], pa.int64()), pa.array(at - starts[item])], ["seed", "key", "place"])

    return read


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = []
        for _, texts in column_blocks(batch.column("text")):
            hashes, which, _, _ = hash_words(texts, NOT_ALNUM)
            starts = np.searchsorted(which, np.arange(len(texts) + 1))
            tokens += [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), pa.array(tokens, pa.binary())], ["key", "item_id", "item"])


def _regions(short: list[int], filter_: Broadcast):
    """Places that may match, gathered into regions that reach a window to both sides."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shapes, count, reach = filter_.value, _shapes(short), TaskContext.get().partitionId() << 36, WINDOW
        size = len(bits).bit_length() + 2
        for batch in batches:
            ids, sums = batch.column("doc_id").to_pylist(), batch.column("sum").to_pylist()
            rows: list[list] = [[] for _ in range(7)]
            for first, texts in column_blocks(batch.column("text")):
                hashes, which, _, _ = hash_words(texts, NOT_ALNUM)
                found = []
                for _, at, seeds in _seeds(hashes, which, shapes):
                    maybe = np.ones(len(seeds), bool)
                    for bit in _filter_places(seeds, size):
                        maybe &= (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    found.append((at[maybe], seeds[maybe]))
                if not found or not sum(len(a) for a, _ in found):
                    continue
                at, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                new = np.concatenate(([True], (which[at[1:]] != which[at[:-1]]) | (at[1:] - at[:-1] > 2 * reach)))
                for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)), strict=True):
                    text = which[at[a]]
                    lo = max(int(np.searchsorted(which, text)), int(at[a]) - reach)
                    hi = min(int(np.searchsorted(which, text, side="right")), int(at[b - 1]) + reach)
                    begin = int(np.searchsorted(which, text))
                    count += 1
                    for column, value in zip(rows, (count, ids[first + text], sums[first + text], lo - begin, hashes[lo:hi].tobytes(), (at[a:b] - lo).tolist(), seeds[a:b].view(np.int64).tolist()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["region", "doc_id", "sum", "start", "tokens", "places", "seeds"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return read


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, identity: float = IDENTITY) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) in ``doc`` of the overlap that counts, with item token 0 on doc token ``shift``; else None."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    size = min(window, len(item))
    if hi - lo < size or not size:
        return None
    same = np.concatenate(([0], np.cumsum(doc[lo:hi] == item[lo - shift : hi - shift])))
    good = np.flatnonzero(same[size:] - same[:-size] >= np.ceil(identity * size - 1e-9))
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + size
    return lo + a, lo + b, int(same[b] - same[a])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            span = overlap(np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["item"], np.uint64), r["shift"])
            if span:
                rows.append((r["doc_id"], r["sum"], r["key"], r["start"] + span[0], r["start"] + span[1], span[2]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "sum", "key", "first_word", "end_word", "equal_words"])


def spaced(text: Column) -> Column:
    """``text`` in lower case, as bytes in which ASCII characters other than letters and digits stand between all tokens."""
    low = F.lower(text)
    cut = F.regexp_replace(F.regexp_replace(low, SEPARATORS, " "), SINGLES, " $0 ")
    return F.when(low.rlike(r"[^\x00-\x7F]"), cut).otherwise(low).cast("binary")


def _row_sum():
    return F.xxhash64("text")


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, sum (of the document's text), item_id, first_word, end_word, equal_words: one row per counted overlap."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), spaced(F.col("text")).alias("text"))
    items = materialize(items.withColumn("key", F.monotonically_increasing_id()), "seeds-items")
    tokens = materialize(items.select("key", "item_id", "text").mapInArrow(_item_tokens, "key long, item_id long, item binary"), "seeds-tokens")
    # Of items with equal tokens one is compared, and all are named.
    named = tokens.where("octet_length(item) > 0").groupBy("item").agg(F.min("key").alias("first"), F.collect_list("item_id").alias("item_ids"))
    named = materialize(named.withColumn("n", (F.octet_length("item") / 8).cast("int")), "seeds-named")
    short = sorted(r["n"] for r in named.select("n").where(F.col("n") < WINDOW).distinct().collect())  # fewer than WINDOW
    firsts = items.join(named.select(F.col("first").alias("key")), "key", "left_semi")
    tests = materialize(firsts.select("key", "text").mapInArrow(_items(short), "seed long, key long, place long"), "seeds-tests")

    bits = min(max(FILTER_BITS[0], (16 * tests.count()).bit_length()), FILTER_BITS[1])
    places = F.explode(F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND((1 << bits) - 1) for s in _filter_shifts(bits)))).alias("bit")
    marks = tests.select(places).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    table = marks.toArrow()  # at most 2**(bits - 5) rows
    filter_ = np.zeros(1 << bits - 5, np.uint32)
    filter_[table["at"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(filter_.view(np.uint8))

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _row_sum().alias("sum"), spaced(F.col("text")).alias("text"))
    regions = texts.mapInArrow(_regions(short, sent), "region long, doc_id long, sum long, start long, tokens binary, places array<long>, seeds array<long>")
    regions = materialize(regions, "seeds-regions")
    hits = regions.select("region", F.explode(F.arrays_zip("places", "seeds")).alias("h")).select("region", "h.seeds", "h.places")
    laid = hits.join(tests, hits["seeds"] == tests["seed"]).select("region", "key", (F.col("places") - F.col("place")).alias("shift")).distinct()
    pairs = laid.join(named.select(F.col("first").alias("key"), "item"), "key").join(regions.select("region", "doc_id", "sum", "start", "tokens"), "region")
    found = pairs.select("doc_id", "sum", "start", "tokens", "shift", "key", "item").mapInArrow(_verify, "doc_id long, sum long, key long, first_word long, end_word long, equal_words long")
    members = named.select(F.col("first").alias("key"), F.explode("item_ids").alias("item_id"))
    return found.join(members, "key").select("doc_id", "sum", "item_id", "first_word", "end_word", "equal_words")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (sorted), first_word and end_word of its overlaps."""
    per = find_overlaps(docs, benchmark).groupBy("doc_id", "sum").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")
    )
    per = materialize(per, "seeds-found").withColumnsRenamed({"doc_id": "_id", "sum": "_sum"})
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), _row_sum()).alias("sum"))
    joined = ids.join(per, ids["doc_id"].eqNullSafe(per["_id"]) & (ids["sum"] == per["_sum"]), "left")
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        "first_word",
        "end_word",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that are contaminated, all their columns as they were."""
    found = materialize(find_overlaps(docs, benchmark).select("doc_id", "sum").distinct(), "seeds-drop")
    return rows_without(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], found)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
