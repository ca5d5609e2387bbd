"""Packages of a run: what is captured, pseudonymised, packed, kept and given out.

A run is a key of documents, errors and log lines. Its package holds an index, a log, a text for readers, a page per document
and the PDFs that documents carry. A run with more bytes than a package may have is packed as several, each with the index of
its own documents, so no package is more than one task can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pdf
from ..functions import text as T
from ..functions.timeline import page_count
from ..plans.scratch import materialize
from ..sources.archive import zip_packages
from . import metadata as M
from .anonymize import anonymize, anonymizer_stats
from .corpus import log_line, number_in_groups

#: Bytes of documents to a package.
PACKAGE_BYTES = 256 << 20
LOG_ROWS = 2000
INDEX_NAME = "metadata.json"
# What a run says of a page it could not reach and of attached PDFs.
PAGE_MISSED, PDF_COVERED, PDF_AS_IT_IS = "No se pudo posicionar la página", "PDF adjunto redactado", "Redacción de PDF omitida — adjunto se incluye sin redactar"


def paginated_scan(pages: DataFrame, totals: DataFrame, *, by: str = "package", page: str = "page", html: str = "html", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages that are there, an error for each that is not) for runs with ``total`` records in ``totals``.

    Pages are addressed by number, so a scan is the same whichever page it starts from; a page that is missing or empty is
    passed over with an error, and pages beyond the last are left out.
    """
    wanted = totals.select(by, F.explode(F.sequence(F.lit(1).cast("long"), page_count(F.col("total")))).alias(page))
    there = pages.where(F.length(F.trim(F.coalesce(html, F.lit("")))) > 0)
    scanned = there.join(wanted, [by, page], "left_semi")
    missing = wanted.join(there, [by, page], "left_anti")
    none = F.lit(None).cast("struct<categoria: string, fecha: string, descripcion: string>")
    message = F.concat(F.lit(f"{PAGE_MISSED} "), F.col(page).cast("string"))
    errors = missing.select(by, none.alias("meta"), F.lit(None).cast("string").alias("url"), message.alias("message"), T.iso_instant(F.current_timestamp() if now is None else now).alias("occurredAt"))
    return scanned, errors


def append_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, repeats too; columns that one lacks are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


@dataclass(frozen=True)
class AnonymizedRun:
    docs: DataFrame
    stats: DataFrame
    log: DataFrame  # id, level, message: what happened to attachments


def anonymize_captured(docs: DataFrame, *, order: str, **options) -> AnonymizedRun:
    """Captured documents with identifiers replaced in their pages, hashes made anew and the head of their PDFs covered.

    A PDF that cannot be covered goes on as it is, with a warning in the log.
    """
    result = anonymize(docs, order=order, text="html", markup=True, **options)
    has_pdf = (F.coalesce("attachmentBase64", F.lit("")) != "") & (F.col("attachmentMime") == M.PDF)
    data = F.when(has_pdf, T.base64_bytes(F.col("attachmentBase64")))
    covered = materialize(result.docs.withColumn("_done", pdf.redact_pdf(data)), "covered")
    ok = F.col("_done").isNotNull() & F.col("_done.ok")
    out = covered.withColumn("sha256", T.sha256_hex(F.col("html")))
    out = out.withColumn("attachmentBase64", F.when(ok, T.base64_plain(F.col("_done.data"))).otherwise(F.col("attachmentBase64")))
    out = out.withColumn("attachmentSha256", F.when(ok, F.col("_done.sha256")).otherwise(F.col("attachmentSha256")))
    said = F.when(F.col("_done.ok"), F.lit(PDF_COVERED)).otherwise(F.concat(F.lit(f"{PDF_AS_IT_IS}: "), F.col("_done.reason")))
    log = covered.where(F.coalesce("attachmentBase64", F.lit("")) != "").where(F.col("attachmentMime") == M.PDF)
    log = log.select("id", F.when(F.col("_done.ok"), "INFO").otherwise("WARN").alias("level"), said.alias("message"))
    return AnonymizedRun(out.select(*docs.columns), anonymizer_stats(result), log)


def shard(docs: DataFrame, *, by: str = "package", limit: int = PACKAGE_BYTES) -> DataFrame:
    """``docs`` with ``by`` numbered where its pages and PDFs have more than ``limit`` bytes together."""
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("attachmentBase64", F.lit("")))
    counts = docs.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / F.lit(limit))).alias("_shards"))
    part = F.concat(F.col(by), F.lit("-"), F.lpad((F.pmod(F.xxhash64("id"), F.col("_shards")) + 1).cast("string"), 4, "0"))
    return docs.join(counts, by).withColumn(by, F.when(F.col("_shards") == 1, F.col(by)).otherwise(part)).drop("_shards")


def log_texts(log: DataFrame, *, by: str = "package", order: str = "at", keep: int = LOG_ROWS) -> DataFrame:
    """(``by``, log): the last ``keep`` lines of each run as text. Lines (by, at, level, message, context) in the order of ``order``."""
    newest = number_in_groups(log, by, F.desc(order), name="_n").where(F.col("_n") <= keep)
    lines = newest.select(by, "_n", log_line(F.col("at"), F.col("level"), F.col("message"), F.col("context")).alias("line"))
    rows = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "line"))).alias("r"))
    return rows.select(by, F.concat(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n")).alias("log"))


def log_at_least(log: DataFrame, level: str) -> DataFrame:
    """Log lines of ``level`` and of graver ones."""
    levels = ("DEBUG", "INFO", "WARN", "ERROR")
    return log.where(F.col("level").isin(*levels[levels.index(level) :]))


def _files_beside(docs: DataFrame, log: DataFrame, *, by: str, now: Column, anonymized: bool) -> DataFrame:
    """(``by``, name, data) of all files of all packages but their indexes."""
    there = docs.select(by).distinct()
    logs = there.join(log_texts(log, by=by), by, "left").select(by, F.coalesce("log", F.lit("\n")).alias("log"))
    about = F.replace(F.lit(M.readme("{now}", anonymized=anonymized)), F.lit("{now}"), T.iso_instant(now))
    has_pdf = (F.coalesce("attachmentBase64", F.lit("")) != "") & (F.col("attachmentMime") == M.PDF)
    files = [
        logs.select(by, F.lit("log.txt").alias("name"), F.col("log").cast("binary").alias("data")),
        there.select(by, F.lit("README.txt").alias("name"), about.cast("binary").alias("data")),
        docs.select(by, M.html_path(F.col("id")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("data")),
        docs.where(has_pdf).select(by, F.concat(F.lit("docs/"), "id", F.lit(".pdf")).alias("name"), T.base64_bytes(F.col("attachmentBase64")).alias("data")),
    ]
    return append_all(*files)


def package_entries(docs: DataFrame, errors: DataFrame, log: DataFrame, runs: DataFrame, *, by: str = "package", now: Column, anonymized: bool = False, version: str = "1.0.0") -> DataFrame:
    """(package, name, data) of all files of all packages.

    ``runs`` has a row per package: ``by``, expected, startedAt and, where pseudonymised, stats. Packages without a document
    have no files.
    """
    index = M.metadata_by(docs, errors, runs, by=by, order="id", now=now, anonymized=anonymized, version=version)
    index = index.select(by, F.lit(INDEX_NAME).alias("name"), F.col("json").cast("binary").alias("data"))
    return append_all(index, _files_beside(docs, log, by=by, now=now, anonymized=anonymized)).withColumnRenamed(by, "package")


def package_parts(docs: DataFrame, errors: DataFrame, log: DataFrame, runs: DataFrame, *, by: str = "package", now: Column, anonymized: bool = False, version: str = "1.0.0") -> DataFrame:
    """(package, name, part, data) as ``package_entries``, with a row for each line of an index, for ``write_packages``: packages of any size."""
    lines = M.metadata_lines(docs, errors, runs, by=by, order="id", now=now, anonymized=anonymized, version=version)
    part = F.shiftleft(F.col("section").cast("long"), 48) + F.col("n")
    index = lines.select(by, F.lit(INDEX_NAME).alias("name"), part.alias("part"), F.concat("line", F.lit("\n")).cast("binary").alias("data"))
    return append_all(index, _files_beside(docs, log, by=by, now=now, anonymized=anonymized)).withColumnRenamed(by, "package")


def build_packages(docs: DataFrame, errors: DataFrame, log: DataFrame, runs: DataFrame, *, by: str = "package", now: Column, owner: str = "paciente", **options) -> DataFrame:
    """(package, filename, data, entries): a ZIP per package, held by one task; ``write_packages`` of ``package_parts`` holds none."""
    packed = zip_packages(package_entries(docs, errors, log, runs, by=by, now=now, **options))
    return packed.select("package", T.archive_name(F.lit(owner), now).alias("filename"), "data", "entries")


def index_digests(parts: DataFrame) -> DataFrame:
    """(package, sha256) of what the manifest of each index lists, joined by spaces: its files in order, then its tokens.

    ``parts``: (package, part, data), whole lines of indexes. Of each only a digest is held as the lines stream by in order.
    """
    lines = parts.select("package", "part", F.posexplode(F.split(F.col("data").cast("string"), "\n")).alias("n", "line"))
    file = F.when(F.col("line").rlike('^,?".*"$'), F.from_json(F.concat(F.lit("["), F.regexp_replace("line", "^,", ""), F.lit("]")), "array<string>")[0])
    begin = F.when(F.col("line").startswith(',"anonymized":'), F.from_json(F.concat(F.lit("{"), F.expr("substring(line, 2)"), F.lit("]}}")), "anonymization STRUCT<tokens: ARRAY<STRING>>")["anonymization"]["tokens"])
    said = lines.select("package", F.when(begin.isNotNull(), 1).otherwise(0).alias("last"), "part", "n", F.coalesce(file, F.array_join(begin, " ")).alias("text")).where("text is not null")
    ordered = said.repartition("package").sortWithinPartitions("package", "last", "part", "n").select("package", "text")
    return ordered.mapInArrow(_digests, "package string, sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, at, digest = [], None, None
    for batch in batches:
        for package, text in zip(batch.column("package").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if digest is None or package != at:
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = package, hashlib.sha256(text.encode())
            else:
                digest.update(b" " + text.encode())
    if digest is not None:
        done.append((at, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], ["package", "sha256"])


def data_url(data: Column, mime: str = "application/zip") -> Column:
    """Bytes as a URL that holds them."""
    return F.concat(F.lit(f"data:{mime};base64,"), T.base64_plain(data))
