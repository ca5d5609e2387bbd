"""Exact deduplication as a stateful stream, with DataFrame functions only.

A file stream of documents is grouped by the SHA-256 digest of the text. The state of that grouping lives in RocksDB on
the executors' disks with its log in the shared checkpoint folder and never expires. Per digest it keeps the identifier of
the row that stays, a locator of that row's bytes (file and row number in it) and the number of rows. Each micro-batch
appends the digests it changed to a table of changes. A digest with more than one row is a hit; the full texts of hits are
compared, and texts that differ under one digest are told apart. Rows that are no hits are told by a table of bits of fixed size
and stay where they are; of the rows of a hit each task sends one per text.

Defined cases
- null text counts as empty; texts are compared without any change. Null identifiers are below all others.
- of equal texts the row with the largest identifier stays; rows that repeat an identifier too are told apart by locator,
  so that exactly one row of a group stays.
- extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_path
from ..sources.tables import table_path
from .bits import mark

#: Bytes of input to a partition of the state, and the least number of partitions. Each costs a fixed 4 MB of disk.
STATE_BYTES, STATE_LEAST = 2 << 30, 12
#: Digests with more than this part of all rows, so at most 10,000 of them, are sent to all tasks and their rows stay where they are.
HEAVY = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, digest, at: the locator, which also orders rows that repeat an identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.struct(F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select("doc_id", text.alias("text"), digest(text).alias("digest"), at.alias("at"))


def _read(spark: SparkSession, path: str) -> tuple[str, str]:
    """A pattern that stands for the file or folder at ``path``, and the schema of the two columns that are read."""
    path = path.rstrip("/")
    kinds = dict(spark.read.parquet(path).dtypes)
    # A stream wants a folder or a pattern; a pattern stands for a single file as well.
    return f"{path[:-1]}[{path[-1]}]", f"doc_id {kinds['doc_id']}, text {kinds['text']}"


def _state_partitions(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(STATE_LEAST, -(-size // STATE_BYTES))


def ingest(spark: SparkSession, path: str, root: str, *, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Bring the state below ``root`` up to date with the files at ``path``; files seen before are not read again."""
    pattern, schema = _read(spark, path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = _rows(reader.parquet(pattern), digest)
    groups = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def log(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")

    # A stream keeps the settings it was started with, and a state the number of partitions it was made with.
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.internal.stateStore.partitions": str(_state_partitions(spark, path))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def groups_of(spark: SparkSession, root: str) -> DataFrame:
    """digest, keep, group_size as of the last change to each digest."""
    schema = "digest string, keep struct<id: bigint, file: string, row: bigint>, group_size bigint, batch int"
    changes = spark.read.schema(schema).parquet(f"{root}/changes")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("g"))
    return last.select("digest", "g.keep", "g.group_size")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add keep and group_size by digest. Rows of heavy digests find them in a bounded table and are dealt by their own place."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    heavy = groups.where(F.col("group_size") * HEAVY > total).select("digest", F.col("keep").alias("_keep"), F.col("group_size").alias("_size"))
    light = groups.where(F.col("group_size") * HEAVY <= total).withColumnRenamed("digest", "_digest")
    both = rows.join(F.broadcast(heavy), "digest", "left")
    key = F.when(F.col("_size").isNull(), F.col("digest")).otherwise(F.concat_ws(" ", "at.file", "at.row"))
    both = both.withColumn("_key", key).join(light, F.col("_key") == F.col("_digest"), "left")
    return both.select(*rows.columns, F.coalesce("_keep", "keep").alias("keep"), F.coalesce("_size", "group_size").alias("group_size"))


def exact_dedup(spark: SparkSession, path: str, *, root: str | None = None, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row at ``path``: doc_id, keep_id, group_size, kept, text_sha256. ``root`` keeps the state between calls."""
    root = root or scratch_path(spark, "exact")
    ingest(spark, path, root, digest=digest, files_per_batch=files_per_batch)
    groups = materialize(groups_of(spark, root), "exact-groups")
    pattern, schema = _read(spark, path)
    rows = _rows(spark.read.schema(schema).parquet(pattern), digest)

    # Full bytes on hits: copies collapse before they are dealt by digest and text, so a large group sends one row per task.
    hits = mark(rows, ["digest"], groups.where("group_size > 1")).where("_marked")
    texts = hits.groupBy("digest", "text").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    clashing = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "exact-clash")

    narrow = rows.select("doc_id", "digest", "at", sha256(F.col("text")).alias("text_sha256"))
    if clashing.isEmpty():
        found = _with_groups(narrow, groups)
    else:
        apart = rows.join(clashing, "digest").join(texts, ["digest", "text"])
        apart = apart.select("doc_id", "digest", "at", sha256(F.col("text")).alias("text_sha256"), "keep", "group_size")
        found = _with_groups(narrow.join(clashing, "digest", "left_anti"), groups).unionByName(apart)
    return found.select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table_path(sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
