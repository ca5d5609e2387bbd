"""Sets of 64-bit values as bits of a fixed size, for leaving out rows that cannot match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB as sent to tasks, whatever the number of values; values that share a bit are let through.
FILTER_BITS = 25


def bitmap(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2**bits bits for the high ends of 64-bit values; at most 2**(bits - 5) rows reach the driver."""
    at = F.shiftrightunsigned(column, 64 - bits)
    rows = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 5, "<u4")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


#: Bits that mark values for joins: a table of 2**17 rows at most is sent to all tasks, whatever the number of values.
MARK_BITS = 23


def _free(rows: DataFrame) -> str:
    """A beginning of names that no column of ``rows`` has."""
    start = "_"
    while any(c.lower().startswith(start) for c in rows.columns):
        start += "_"
    return start


def mark(rows: DataFrame, columns: list[str], among: DataFrame, name: str = "_marked") -> DataFrame:
    """``rows`` with ``name``: true for all rows whose ``columns`` are in ``among``, and for few others. Rows stay where they are."""
    start = _free(rows)
    word, bit = f"{start}word", f"{start}bit"

    def placed(df: DataFrame) -> DataFrame:
        place = F.shiftrightunsigned(F.xxhash64(*columns), 64 - MARK_BITS)
        return df.withColumn(word, F.shiftright(place, 6).cast("int")).withColumn(bit, place.bitwiseAND(63).cast("int"))

    words = placed(among.select(*columns)).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(f"{start}bits"))
    joined = placed(rows).join(F.broadcast(words), word, "left")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(F.expr(f"bit_get({start}bits, {bit}) = 1"), F.lit(False)).alias(name))


def rows_without(docs: DataFrame, keys: list[Column], dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not a row of ``dropped``; columns as they were.

    Only rows that a table of bits of fixed size cannot clear are dealt to the join that decides, so texts that stay are not shuffled.
    """
    start = _free(docs)
    names = [f"{start}key{i}" for i in range(len(keys))]
    out = dropped.toDF(*names)
    rows = docs.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    rows = mark(rows, names, out, f"{start}marked")
    doubtful, clear = rows.where(f"{start}marked"), rows.where(f"not {start}marked")
    decided = doubtful.join(out, [doubtful[n].eqNullSafe(out[n]) for n in names], "left_anti")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return clear.select(*own).unionByName(decided.select(*own))
