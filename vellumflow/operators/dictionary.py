"""A dictionary of keys numbered by first appearance that outlives a run.

Each batch adds the keys that no earlier batch had, numbered on after the greatest number so far, in a folder of its own. Documents
in batches one after the other get the numbers that they would get in one. A batch that is run again reads what came before it and
replaces its own folder, so it gives the same numbers; batches are numbered by the caller, and later ones come later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import number_rows
from ..sources.archive import restore

SCHEMA = "key string, n long, batch long"


@dataclass(frozen=True)
class Dictionary:
    """Keys by kind below ``root``, a folder that all executors share."""

    root: str

    def known(self, spark: SparkSession, kind: str, before: int) -> DataFrame:
        """(key, n) of all batches with a number below ``before``."""
        return restore(spark, self.root, kind, SCHEMA).where(F.col("batch") < before).select("key", "n")

    def extend(self, kind: str, places: DataFrame, batch: int, *, order: str = "at") -> DataFrame:
        """(key, n) of all keys up to ``batch``, to which the keys of ``places`` (key, ``order``) are added by their first place.

        New keys are found by an anti-join on distinct keys; the greatest number is one row.
        """
        spark = places.sparkSession
        earlier = self.known(spark, kind, batch)
        firsts = places.groupBy("key").agg(F.min(order).alias("_first"))
        new = number_rows(firsts.join(earlier, "key", "left_anti"), F.col("_first"), tag=f"new-{kind}")
        greatest = earlier.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_last"))
        rows = new.crossJoin(F.broadcast(greatest)).select("key", (F.col("n") + F.col("_last")).alias("n"))  # one row
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch}")
        return self.known(spark, kind, batch + 1)
