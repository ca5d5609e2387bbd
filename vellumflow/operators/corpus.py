"""Whole-corpus operators: identifiers, duplicates, totals, progress, logs."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timeline
from ..plans.ranking import number_rows
from ..plans.scratch import materialize


def page_ordinals(records: DataFrame, *order: Column, size: int = timeline.PAGE_SIZE) -> DataFrame:
    """Add ordinal (from 1), page (from 1) and place on the page (from 0)."""
    numbered = number_rows(records, *order, name="ordinal", tag="pages")
    return numbered.withColumn("page", F.ceil(F.col("ordinal") / size).cast("long")).withColumn("place", ((F.col("ordinal") - 1) % size).cast("long"))


def distinct_in_page(rows: DataFrame, page: str, key: str, place: str) -> DataFrame:
    """The first row of each key on a page."""
    first = F.row_number().over(Window.partitionBy(page, key).orderBy(place))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def keep_first_by_hash(docs: DataFrame, sha: str, order: str) -> DataFrame:
    """One row per hash, the first in ``order``. Only hash and order are shuffled, and copies meet in a partial minimum."""
    firsts = docs.groupBy(sha).agg(F.min(order).alias("_first")).withColumnRenamed(sha, "_sha")
    return docs.join(firsts, (F.col(order) == F.col("_first")) & (F.col(sha) == F.col("_sha")), "left_semi")


def duplicate_groups(docs: DataFrame, sha: str) -> DataFrame:
    return docs.groupBy(sha).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def not_yet_captured(docs: DataFrame, captured: DataFrame, sha: str) -> DataFrame:
    """Rows whose hash is not among those of an earlier run."""
    return docs.join(captured.select(sha).distinct(), sha, "left_anti")


def number_in_groups(rows: DataFrame, group: str, *order: Column, name: str = "n") -> DataFrame:
    """Add ``name``: 1, 2, ... in ``order`` within each ``group``, by ranks over all rows, so that a large group is not one task's."""
    ranked = number_rows(rows, F.col(group), *order, name="_rank", tag="groups")
    firsts = ranked.groupBy(group).agg(F.min("_rank").alias("_first")).withColumnRenamed(group, "_group")
    return ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", "_group")


def count_below(probes: DataFrame, entries: DataFrame, group: str, value: str, name: str = "below") -> DataFrame:
    """``probes`` with ``name``: how many ``entries`` of the same ``group`` have a smaller ``value``.

    Both are range-partitioned together, entries are counted up inside a partition and the counts of earlier partitions and groups,
    one row each, are taken into account. So work grows with the rows and not with their pairs, and a hot group is not one task's.
    """
    kind, part, upto, first = f"_{name}_kind", f"_{name}_part", f"_{name}_upto", f"_{name}_first"
    both = probes.withColumn(kind, F.lit(0)).unionByName(entries.select(group, value).withColumn(kind, F.lit(1)), allowMissingColumns=True)
    placed = materialize(both.repartitionByRange(group, value, kind).withColumn(part, F.spark_partition_id()), "below")
    inside = F.sum(kind).over(Window.partitionBy(part).orderBy(group, value, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = placed.groupBy(part).agg(F.sum(kind).alias("_size"))
    before = sizes.select(part, (F.sum("_size").over(Window.orderBy(part)) - F.col("_size")).alias("_before"))  # a row for each partition
    counted = placed.withColumn(upto, inside).join(F.broadcast(before), part).withColumn(upto, F.col(upto) + F.col("_before"))
    starts = counted.groupBy(group).agg(F.min(F.col(upto) - F.col(kind)).alias(first))
    out = counted.where(F.col(kind) == 0).join(starts, group)
    return out.withColumn(name, (F.col(upto) - F.col(first)).cast("long")).select(*probes.columns, name)


def _numbered_form(base: str) -> tuple[Column, Column]:
    """Stem and number of a base such as ``x-2``."""
    pattern = r"^(.+)-([1-9]\d{0,8})$"
    return F.regexp_extract(base, pattern, 1), F.regexp_extract(base, pattern, 2).try_cast("int")


def _replay(clashes: pd.DataFrame) -> pd.DataFrame:
    """(base, late, skips) of one family from (base, stem, k, place, before), in order of place.

    ``before`` rows of the stem come before the first row of ``base``, which is the stem with -k. If one of them has been
    given that name already, ``base`` comes late and starts with its number 2; otherwise the stem's rows skip k. Of the numbers
    t0 < t1 < ... that a stem skips, ``skips`` holds ti - i: the n-th name has number n and one more for each of these up to n.
    """
    late: set[str] = set()
    taken: dict[str, list[int]] = {}

    def skipped(numbers: list[int], n: int) -> int:
        """How many of the sorted ``numbers`` the n-th name passes over."""
        low, high = 0, len(numbers)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if numbers[mid] - mid <= n else (low, mid)
        return low

    for r in clashes.sort_values("place").itertuples(index=False):
        reached = r.before + (r.stem in late) if r.before else 0
        reached += skipped(taken.get(r.stem, []), reached)
        if r.k <= reached:
            late.add(r.base)
        else:
            bisect.insort(taken.setdefault(r.stem, []), r.k)
    bases = sorted(late | taken.keys())
    return pd.DataFrame({"base": bases, "late": [b in late for b in bases], "skips": [[t - i for i, t in enumerate(taken.get(b, []))] for b in bases]})


def unique_slugs(rows: DataFrame, base: str, *order: Column, name: str = "slug", fallback: str = "evento") -> DataFrame:
    """Add ``name``: the base for its first row, then base-2, base-3 and so on, each row taking the first name not yet given.

    Names are given in ``order``, which should leave no ties. Numbers follow from ranks; only where a base equals another one's
    numbered form (``x-2`` beside ``x``) does it matter which came first. Of such a pair of bases one row is replayed, in order,
    by families of bases without their final numbers.
    """
    base_ = F.when(F.coalesce(F.col(base), F.lit("")) == "", fallback).otherwise(F.col(base))
    numbered = materialize(number_in_groups(rows.withColumn("_base", base_), "_base", *order, name="_n").withColumn("_place", F.struct(*order)), "slugs")
    firsts = numbered.where("_n = 1").select(F.col("_base").alias("base"), F.col("_place").alias("place"))
    stem, k = _numbered_form("base")
    forms = firsts.select("base", "place", stem.alias("stem"), k.alias("k")).where("k >= 2")
    pairs = materialize(forms.join(firsts.select(F.col("base").alias("stem")), "stem"), "slugs-pairs")
    own = [F.col(c) for c in rows.columns]
    if pairs.isEmpty():
        return numbered.select(*own, _slug(F.col("_n")).alias(name))
    stems = numbered.join(pairs.select(F.col("stem").alias("_base")).distinct(), "_base", "left_semi")
    clashes = count_below(pairs, stems.select(F.col("_base").alias("stem"), F.col("_place").alias("place")), "stem", "place", "before")
    ranked = number_rows(clashes, F.col("place"), F.col("base"), name="at", tag="slugs-order").withColumn("family", F.regexp_replace("base", r"(-[1-9]\d{0,8})+$", ""))
    replayed = ranked.select("family", "base", "stem", "k", F.col("at").alias("place"), "before").groupBy("family").applyInPandas(lambda pdf: _replay(pdf), "base string, late boolean, skips array<long>")
    replayed = materialize(replayed, "slugs-replayed")
    known = replayed.select(F.col("base").alias("_base"), F.col("late").alias("_late"), (F.size("skips") > 0).alias("_skips"))
    joined = numbered.join(known, "_base", "left").withColumn("_number", F.col("_n") + F.when(F.col("_late"), 1).otherwise(0))
    plain = joined.where(~F.coalesce("_skips", F.lit(False)))
    # Numbers of rows of a stem that skips some: one more for each skip up to theirs.
    skips = replayed.select(F.col("base").alias("_base"), F.explode("skips").alias("_value"))
    shifted = count_below(joined.where("_skips").withColumn("_value", F.col("_number") + 1), skips, "_base", "_value", "_passed")
    one = shifted.select(*own, F.when(F.col("_number") == 1, F.col("_base")).otherwise(_slug(F.col("_number") + F.col("_passed"))).alias(name))
    return plain.select(*own, _slug(F.col("_number")).alias(name)).unionByName(one)


def _slug(number: Column) -> Column:
    return F.when(number == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), number.cast("string")))


def totals(expected: Column | int, captured: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: expected, captured, failed, missing (null where the counts agree)."""
    expected = F.lit(expected) if isinstance(expected, int) else expected
    both = captured.agg(F.count(F.lit(1)).alias("captured")).crossJoin(failed.agg(F.count(F.lit(1)).alias("failed")))  # one row each
    out = both.select(expected.cast("long").alias("expected"), "captured", "failed")
    return out.withColumn("missing", T.missing_count(F.col("expected"), F.col("captured"), F.col("failed")))


def progress(events: DataFrame, *, order: str, total: Column, status: Column, document: list[str]) -> DataFrame:
    """One row: processed, total, percent, status label and the last document."""
    out = events.agg(F.count(F.lit(1)).alias("processed"), F.max_by(F.struct(*document), order).alias("last_document"))
    out = out.select("processed", total.cast("long").alias("total"), status.alias("status"), "last_document")
    return out.withColumn("percent", T.percent(F.col("processed"), F.col("total"))).withColumn("label", T.state_label(F.col("status")))


def last_rows(rows: DataFrame, order: str, n: int, *, newest_first: bool = False) -> DataFrame:
    """The last ``n`` rows by ``order``. A bounded sort: each task keeps ``n`` rows and one merges these."""
    last = rows.orderBy(F.desc(order)).limit(n)
    return last if newest_first else last.orderBy(order)


def feed(events: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """(key, order) of the ``n`` newest entries of a feed that takes each key once, when it first comes; newest first."""
    return last_rows(events.groupBy(key).agg(F.min(order).alias(order)), order, n, newest_first=True)


def log_line(at: Column, level: Column, message: Column, context: Column) -> Column:
    """Instant, level padded to five, message, and the context where there is one."""
    padded = F.when(F.length(level) < 5, F.rpad(level, 5, " ")).otherwise(level)
    return F.concat(T.iso_instant(at), F.lit(" "), padded, F.lit(" "), message, F.when(context.isNotNull(), F.concat(F.lit(" "), context)).otherwise(""))


def log_text(lines: DataFrame, line: str, order: str) -> DataFrame:
    """One row with the text of a bounded log: lines in order, each with a line end; a lone line end if there are none."""
    rows = lines.agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("r"))
    return rows.select(F.concat(F.array_join(F.transform("r", lambda x: x[line]), "\n"), F.lit("\n")).alias("log"))
