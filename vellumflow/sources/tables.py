"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; a file or a folder of files, in any store Spark reads."""
    return spark.read.parquet(table_path(root, name))


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"
