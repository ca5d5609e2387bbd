"""Tables of bits that tell most rows apart before a shuffle; their size follows from the number of values, up to a bound."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and of a table: 16 MB at most as sent to tasks. In a larger set more values share a bit and are let through.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 12, 27


def bits_for(count: int) -> int:
    """Logarithm of the bits for a set of ``count`` values."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_EACH * max(1, count)))))


def _words(hashes: DataFrame, bits: int) -> DataFrame:
    """(word, bits): 32 bits to a word, for the high ends of the 64-bit values of a one-column table."""
    at = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    return hashes.select(F.shiftright(at, 5).cast("int").alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(31).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits as bytes, for use in Python; at most 2**(MOST_BITS - 5) rows reach the driver."""
    rows = _words(hashes, bits).toArrow()
    out = np.zeros(1 << bits - 5, "<u4")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether 64-bit ``values`` (unsigned) may be in the set of ``table``."""
    at = values >> np.uint64(64 - int(math.log2(len(table) * 8)))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def free_prefix(rows: DataFrame) -> str:
    """A beginning of names that no column of ``rows`` has."""
    start = "_"
    while any(c.lower().startswith(start) for c in rows.columns):
        start += "_"
    return start


def mark(rows: DataFrame, key: Column, among: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: true where ``key`` is in the one column of ``among``, and for few others. Rows stay where they are."""
    start, column = free_prefix(rows), F.col(among.columns[0])
    bits = bits_for(among.count())
    words = _words(among.where(column.isNotNull()).select(F.xxhash64(column).alias("hash")), bits).toDF(f"{start}word", f"{start}bits")
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    placed = rows.withColumn(f"{start}word", F.shiftright(at, 5).cast("int")).withColumn(f"{start}bit", at.bitwiseAND(31).cast("int"))
    joined = placed.join(F.broadcast(words), f"{start}word", "left")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(F.expr(f"bit_get({start}bits, {start}bit) = 1"), F.lit(False)).alias(name))
