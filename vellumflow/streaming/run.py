"""Runs of the streaming operators over a table, to its end."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a batch between Spark and Python: ten thousand pages with their segments, Spark's own limit, are held several times over by each task.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stream_pattern(path: str) -> str:
    """A pattern for a file or a folder: a stream takes a folder or a pattern, and a pattern may stand for one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, and give Python batches of ``BATCH_ROWS`` rows or fewer."""
    before, rows = spark.conf.get(PROVIDER), spark.conf.get(_ROWS)
    spark.conf.set(PROVIDER, ROCKSDB)
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.set(_ROWS, rows)


def run_to_end(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], *, root: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Read what is new at ``path`` as a stream, change it, append it below ``root``, and give all that is there.

    State and progress lie below ``root`` in the shared folder, so a later call goes on where this one ended; every row is
    written once. Rate is limited by ``files_per_batch``.
    """
    root = root or scratch_path(spark, "stream")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = change(reader.parquet(stream_pattern(path)))
    with rocksdb(spark):
        query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
