"""Rows as values, and numbers for rows that are alike, however many they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def number_alike(rows: DataFrame, keys: list[str], tag: str = "alike") -> DataFrame:
    """``rows`` with n: 1, 2, ... among the rows of equal ``keys``.

    The rows are written once, so that it is settled in which part each lies; they are numbered inside their part, and the counts
    of earlier parts, one row each, are added. So a group of any size is never one task's.
    """
    placed = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("key", F.xxhash64(*keys)), tag)
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("key", "part", (F.sum("rows").over(Window.partitionBy("key").orderBy("part")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("part"))
    return placed.withColumn("inside", inside).join(before, ["key", "part"]).withColumn("n", F.col("before") + F.col("inside")).drop("key", "part", "inside", "before")


def as_struct(columns: list[str], name: str) -> Column:
    """The columns as one struct, which has one more field, so that it may be of none, with a name that is none of theirs."""
    spare = "_"
    while spare in columns:
        spare += "_"
    return F.struct(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias(spare)).alias(name)
