"""WARC archives: a sink that writes one gzip member per record, and a reader that any byte range can be given to.

``spark.read.format("warc")`` cuts archives into ranges of bytes. A task searches its range for the first bytes of a gzip member,
decodes what follows and takes it for a record only if it begins with a version line and headers that give a length; it owns the
records that start inside its range and reads past its end for the last of them. No index is needed and no file is read by one
task. From a record's end on, members follow each other, so a search is only made at the begin of a range and after damage.

``write_warc`` makes a response of each page, or a revisit where an equal payload is archived under a smaller identifier. Payloads
meet as digests only: texts whose digest no other page has stay where they are.

Defined cases
- null payload: empty. Null address: no address. Control characters and blanks in headers are percent-encoded.
- null identifier: after all others, so such a page is a response only if no page with an identifier has its payload; rows that
  repeat the smallest identifier are all responses. Extra columns are ignored, whatever their names.
- an empty table gives no archives, and none are read back.
- damaged members: what has a readable head is returned with ``error`` and without payload; anything else is passed over up to
  the next record. A member that holds several records gives all of them.
- an archive inside a record that is stored uncompressed looks like records where a range begins in it: ``outermost`` leaves these
  out. Payloads of UTF-8 cannot hold the first bytes of a gzip member.
- a payload is held whole by the task that reads or writes it; batches between Spark and Python are cut by bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.scratch import materialize, scratch_path
from ..sources.staged import Staging, Written, list_files, open_path
from ..sources.tables import read_table
from .bits import mark

#: Payloads below this size are always archived whole.
LEAST_BYTES = 100
#: Bytes of an archive file and of a range that a task reads, unless told otherwise.
FILE_BYTES, SPLIT_BYTES = 1 << 30, 64 << 20
#: Bytes read from a file, and of payloads in a batch, at a time; most bytes of a record's head.
CHUNK, BATCH_BYTES, HEAD = 1 << 20, 4 << 20, 1 << 16
#: First bytes of a gzip member with deflated data; version of the records; profile of a revisit.
MAGIC, VERSION, PROFILE = b"\x1f\x8b\x08", b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Written where pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"

WRITTEN = "record_id string, uri string, date string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
READ = f"file string, offset long, next_offset long, {WRITTEN}, error string"


# --- records -----------------------------------------------------------------------------------------------------------------


def _plain(value: str) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def encode_record(row: dict) -> bytes:
    """A record of a response, with its payload, or of a revisit, with the head of the exchange only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (row["payload"] or b"")
    head = [VERSION, b"WARC-Type: " + _plain(row["record_type"]), b"WARC-Record-ID: <" + _plain(row["record_id"]) + b">", b"WARC-Date: " + _plain(row["date"])]
    if row["uri"] is not None:
        head.append(b"WARC-Target-URI: " + _plain(row["uri"]))
    if row["record_type"] == "revisit":
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <" + _plain(row["refers_to"]) + b">"]
    head += [b"WARC-Payload-Digest: sha256:" + _plain(row["payload_digest"]), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers in lower case and the place after them, or None for what is no head of a record."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    lines = re.sub(rb"\r\n[ \t]+", b" ", data[:end]).split(b"\r\n")[1:]
    found = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}
    return (found, end + 4) if found.get("content-length", "").isdecimal() and "warc-type" in found else None


def _unbracketed(value: str | None) -> str | None:
    return value if value is None else value.strip().removeprefix("<").removesuffix(">")


def decode_records(data: bytes, whole: bool) -> Iterator[dict]:
    """The records of a member; ``whole`` says that the member was decoded to its end."""
    at = 0
    while at < len(data) and (head := _headers(data[at:] if at else data)) is not None:
        found, start = head
        size = int(found["content-length"])
        block = data[at + start : at + start + size]
        payload, sizes = block, None
        if found.get("content-type", "").startswith("application/http"):
            end = block.find(b"\r\n\r\n")
            http, payload = (block, b"") if end < 0 else (block[:end], block[end + 4 :])
            sizes = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        revisit, short = found["warc-type"] == "revisit", len(block) < size or not whole
        yield {
            "record_id": _unbracketed(found.get("warc-record-id")),
            "uri": found.get("warc-target-uri"),
            "date": found.get("warc-date"),
            "record_type": found["warc-type"],
            "refers_to": _unbracketed(found.get("warc-refers-to")),
            "payload_digest": found["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in found else None,
            "payload_bytes": int(sizes[1]) if sizes else len(payload),
            "payload": None if revisit or short else payload,
            "error": "truncated" if short else None,
        }
        at += start + size
        while data[at : at + 2] == b"\r\n":
            at += 2


# --- members of a range ------------------------------------------------------------------------------------------------------


def _find(file, at: int, end: int) -> int | None:
    """First place from ``at`` on, before ``end``, where a member may start."""
    while at < end:
        file.seek(at)
        data = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        if (found := data.find(MAGIC)) >= 0:
            return at + found
        at += CHUNK
    return None


def _member(file, at: int) -> tuple[bytes, int | None] | None:
    """(decoded, place after it) of the member at ``at``; None if no record begins there, no place if it is damaged."""
    file.seek(at)
    inflate, out, size, read, checked = zlib.decompressobj(31), [], 0, 0, False
    while not inflate.eof:
        data = file.read(CHUNK)
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            data = b""
        read += len(data)
        size += len(out[-1]) if out else 0
        if not checked and (size >= HEAD or inflate.eof or not data):
            if _headers(b"".join(out)[:HEAD]) is None:
                return None
            checked = True
        if not data:
            return b"".join(out), None
    return b"".join(out), at + read - len(inflate.unused_data)


def scan_range(file, begin: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, place after the member, record) of the records that start in [begin, end)."""
    at = _find(file, begin, end)
    while at is not None:
        member = _member(file, at)
        if member is not None:
            for r in decode_records(member[0], member[1] is not None):
                yield at, at + 1 if member[1] is None else member[1], r
        following = None if member is None else member[1]
        at = _find(file, at + 1 if following is None else following, end)


# --- data source -------------------------------------------------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int


def _cut(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") + 256
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [_Range(f, at, min(at + self.split, size)) for f, size in list_files(self.path, ".gz") for at in range(0, size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, READ.split(","))])
        with open_path(self.path)[0].open_input_file(partition.path) as file:
            found = scan_range(file, partition.begin, partition.end)
            yield from _cut(({"file": partition.path, "offset": at, "next_offset": following} | r for at, following, r in found), schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.staging, self.most, self.level = Staging(options["path"]), int(options.get("filebytes", FILE_BYTES)), int(options.get("level", 6))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, out, size, task = Written(), None, 0, TaskContext.get().partitionId()
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        out, size = self.staging.create(f"part-{task:06d}-{len(done.files):04d}.warc.gz", done), 0
                    deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                    size += out.write(deflate.compress(encode_record(row)) + deflate.flush())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        self.staging.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.abort()


class WarcSource(DataSource):
    """``spark.read.format("warc")``, and ``df.write.format("warc").mode("append")`` for the columns of ``WRITTEN``.

    Options: path; splitBytes of a task's range; fileBytes after which a task begins another file; level of compression.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


# --- pages ---------------------------------------------------------------------------------------------------------------------


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "^urn:page:(.+)$", 1).try_cast("long")


def plan_records(pages: DataFrame, *, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = DATE, least: int = LEAST_BYTES) -> DataFrame:
    """The records to write for pages: columns of ``WRITTEN``.

    The smallest identifier of each digest that occurs again is found on digests. Pages whose digest a table of bits of fixed size
    clears are not shuffled; the others meet their group's row in a join whose hot keys Spark can split.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null").select("payload_digest", "first"), "warc-groups")
    marked = mark(rows, ["payload_digest"], groups, "again")
    clear = marked.where(~F.col("again")).withColumn("first", F.lit(None).cast(rows.schema["id"].dataType))
    met = marked.where("again").join(groups, "payload_digest", "left").select(*clear.columns)
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return clear.unionByName(met).select(
        record_id(F.col("id")).alias("record_id"),
        "uri",
        F.lit(date).alias("date"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, record_id(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, *, file_bytes: int = FILE_BYTES, **columns) -> None:
    register(pages.sparkSession)
    plan_records(pages, **columns).write.format("warc").mode("append").option("path", path).option("fileBytes", file_bytes).save()


def read_warc(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records with their place: the columns of ``READ``. The payload of a revisit is null; its size and digest are its headers'."""
    register(spark)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def outermost(records: DataFrame) -> DataFrame:
    """Records that are not inside another member of their file."""
    earlier = F.max("next_offset").over(Window.partitionBy("file").orderBy("offset").rangeBetween(Window.unboundedPreceding, -1))
    return records.withColumn("_earlier", earlier).where("_earlier is null or _earlier <= offset").drop("_earlier")


def digests(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes and payload_digest, worked out from payloads as read.

    A revisit has those of the response it refers to; its headers' only where that is missing.
    """
    seen = records.select(
        "record_id",
        "record_type",
        "refers_to",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
    )
    seen = materialize(seen, "warc-read")
    revisits, others = seen.where("record_type = 'revisit'"), seen.where("record_type <> 'revisit' or record_type is null")
    wanted = revisits.select("refers_to").distinct()
    held = others.join(wanted.withColumnRenamed("refers_to", "record_id"), "record_id", "left_semi")
    held = held.groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("held"))
    full = revisits.join(held, "refers_to", "left").select(
        "record_id",
        "record_type",
        "refers_to",
        F.coalesce("held.payload_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("held.payload_digest", "payload_digest").alias("payload_digest"),
    )
    return others.unionByName(full)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    read = digests(read_warc(spark, path))
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


SQL = f"""
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), led AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM led
"""
