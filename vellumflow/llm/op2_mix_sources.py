"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their identifier. The virtual finish time of a document is the running sum
of its source's words divided by the source's target; a source whose target exceeds its size runs through its documents
again. The queue of all sources is range-sorted by finish time and cut where the total budget is spent.

Targets: a source weighs by its rank in code point order (null last), the weights repeating. Targets share the budget by
weight and stop at ``max_epochs`` times the source's size; what is over is shared again by weight until none is above.

Running sums never need one task for one source: rows are first summed by (source, slice of the hash), the number of slices
grows with the root of the number of rows, and only these sums are added up along a source. The cut is found the same way along ranges.

Defined cases
- null text has no words; such documents are queued and take nothing. Null source: a source of its own, last in order.
- rows that repeat an identifier are separate documents, in the order of a hash of their texts; rows alike in identifier, source
  and text are interchangeable.
- extra columns are ignored by the plan and kept by ``mix_sources``, whatever their names. Empty table, or no words at all: every target and every taken count is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize, release
from ..sources.tables import read_table
from .alike import number_alike

WEIGHTS, BUDGET, MAX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rank_sources(sizes: DataFrame) -> DataFrame:
    """Add ``rank``, 0 for the first source in code point order, null last, without one task for all sources."""
    placed = materialize(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-places"
    )
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = placed.withColumn("inside", inside).join(before, "part")
    return ranked.select("source", "source_size", (F.col("before") + F.col("inside") - 1).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, float]:
    """source, source_size, rank, target for (source, source_size) rows, and the total budget.

    ``level`` is the words that a weight of 1 gets. Each round caps the sources above their limit and shares the rest; only
    three sums reach the driver, and the level rises until no further source is capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(rank_sources(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(max_epochs)), "mix-sources")
    total = budget * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * level
        full, free, n = table.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if not free or n == capped:
            break
        level, capped = (total - full) / free, n
    share = F.when(F.lit(not free), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * level))
    return table.select("source", "source_size", "rank", share.alias("target")), total


def shuffled_place() -> list[Column]:
    """h, id, th: the place of a document in its source's shuffled order, read off the document alone."""
    return [F.xxhash64(F.lit("mix"), "doc_id").alias("h"), F.col("doc_id").alias("id"), F.xxhash64(F.lit("text"), "text").alias("th")]


def _ranked(docs: DataFrame, weights: tuple, budget: float, max_epochs: int) -> tuple[DataFrame, Column]:
    """Documents with their running sums, written once, and the column that says how many copies of each the mix takes."""
    base = materialize(docs.select("source", word_count(F.col("text")).alias("size"), *shuffled_place()), "mix-base")
    targets, total = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    targets = materialize(targets, "mix-targets")
    slices = math.isqrt(base.count()) + 1

    # Slices cut the shuffled order of every source into runs of like numbers of rows; a source of n rows has about the square
    # root of n slices of as many rows, so neither a slice nor the sums along a source become a large task.
    slice_no = F.floor((F.col("h") / 2.0**64 + 0.5) * slices).cast("int")
    rows = base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("slice", slice_no)
    sums = rows.groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    sums = sums.select("rank", "slice", (F.sum("words").over(Window.partitionBy("rank").orderBy("slice")) - F.col("words")).alias("before"))
    order = Window.partitionBy("rank", "slice").orderBy("h", "id", "th")
    rows = rows.withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
    ranked = materialize(rows.join(sums, ["rank", "slice"]).withColumn("upto", F.col("before") + F.col("inside")).drop("before", "inside"), "mix-ranked")

    # What tells queue entries apart, in queue order. Equal finish times go by source, epoch and place in the source.
    def place(epoch: Column) -> Column:
        return F.struct(finish(epoch).alias("t"), F.col("rank").alias("s"), epoch.cast("long").alias("e"), F.col("slice").alias("b"), F.col("row").alias("r"))

    runs = F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    epochs = F.sequence(F.lit(0), F.when(F.col("source_size") > 0, F.least(runs, F.lit(max_epochs))).otherwise(1) - 1)
    queue = ranked.withColumn("epoch", F.explode(epochs)).select(place(F.col("epoch")).alias("at"), "size")
    queue = materialize(queue.repartitionByRange("at.t", "at.s", "at.e", "at.b", "at.r").withColumn("part", F.spark_partition_id()), "mix-queue")
    parts = queue.groupBy("part").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("part"))
    cut = parts.select("part", (upto - F.col("words")).alias("before"), upto.alias("upto")).where(F.col("upto") > total).orderBy("part").first()
    if cut is None:
        inside = [F.lit(True)] * max_epochs
    else:
        order = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        edge = queue.where(F.col("part") == cut["part"]).withColumn("upto", F.sum("size").over(order) + cut["before"])
        first = edge.where(F.col("upto") > total).orderBy("at").first()["at"]
        bound = F.struct(*(F.lit(v).cast(kind).alias(k) for (k, v), kind in zip(first.asDict().items(), ("double", "long", "long", "int", "int"), strict=True)))
        inside = [place(F.lit(e)) < bound for e in range(max_epochs)]
    for df in (base, queue):
        release(df)
    return ranked, sum((((F.size(epochs) > e) & ok).cast("long") for e, ok in enumerate(inside)), F.lit(0).cast("long"))


def finish(epoch: Column | int) -> Column:
    """Virtual finish time of a document's copy in a run through its source."""
    return F.when(F.col("target") > 0, (F.col("upto") + epoch * F.col("source_size")) / F.col("target")).otherwise(0.0)


def mix_plan(docs: DataFrame, *, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken, finish (of its first copy)."""
    ranked, copies = _ranked(docs, weights, budget, max_epochs)
    out = ranked.withColumn("copies", copies)
    return out.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), finish(0).alias("finish"))


def source_cuts(docs: DataFrame, weights: tuple, budget: float, max_epochs: int) -> DataFrame:
    """of (source) and cuts: for each run through the source the first place that is not taken (null: all are), and how many rows at that place are.

    The queue of a source is in the order of its places, so what the mix takes of it is what stands before a place.
    """
    ranked, copies = _ranked(docs, weights, budget, max_epochs)
    narrow = ranked.select(F.col("source").alias("of"), F.struct("h", "id", "th").alias("at"), copies.alias("copies"))
    firsts = narrow.groupBy("of").agg(*(F.min(F.when(F.col("copies") <= e, F.col("at"))).alias(f"at{e}") for e in range(max_epochs)))
    firsts = materialize(firsts, "mix-firsts")
    same = narrow.withColumnRenamed("of", "own").join(firsts, F.col("own").eqNullSafe(F.col("of")))
    counts = [F.count_if((F.col("at") == F.col(f"at{e}")) & (F.col("copies") > e)).alias(f"n{e}") for e in range(max_epochs)]
    counted = same.groupBy("of").agg(*(F.first(f"at{e}").alias(f"at{e}") for e in range(max_epochs)), *counts)
    cuts = materialize(counted.select("of", F.array(*(F.struct(F.col(f"at{e}").alias("at"), F.col(f"n{e}").alias("n")) for e in range(max_epochs))).alias("cuts")), "mix-cuts")
    for df in (ranked, firsts):
        release(df)
    return cuts


def mix_sources(docs: DataFrame, *, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, all their columns, each as often as the mix takes it.

    A document's copies are told from its own place and its source's cuts, so texts are not shuffled.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    cuts = source_cuts(docs.select("doc_id", "source", "text"), weights, budget, max_epochs)
    rows = docs.select(own, F.col("source").alias("own"), F.struct(*shuffled_place()).alias("at"))
    rows = rows.join(cuts, F.col("own").eqNullSafe(F.col("of")))
    before = F.size(F.filter("cuts", lambda c: c["at"].isNull() | (F.col("at") < c["at"])))
    on_cut = F.exists("cuts", lambda c: (F.col("at") == c["at"]) & (c["n"] > 0))
    taken = rows.select("doc", before.alias("copies"), F.coalesce(on_cut, F.lit(False)).alias("shared"), "own", "at", "cuts")
    out = taken.where("not shared and copies > 0").select("doc", "copies")
    if not cuts.where("exists(cuts, c -> c.n > 0)").isEmpty():  # equal rows of which some are taken
        alike = number_alike(taken.where("shared"), ["own", "at"], "mix-alike")
        more = F.size(F.filter("cuts", lambda c: (F.col("at") == c["at"]) & (F.col("n") <= c["n"])))
        out = out.unionByName(alike.select("doc", (F.col("copies") + more).alias("copies")).where("copies > 0"))
    return out.select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("n")).select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")
