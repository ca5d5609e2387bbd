"""The index of a packaged corpus: typed rows and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import iso_instant
from .corpus import number_in_groups

SCHEMA_VERSION = "1.0"
PDF = "application/pdf"


def html_path(doc_id: Column) -> Column:
    return F.concat(F.lit("docs/"), doc_id, F.lit(".html"))


def file_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Add file: the one in the index for ``id``, or the usual path."""
    known = documents.select("id", F.col("file").alias("_file"))
    return ids.join(known, "id", "left").withColumn("file", F.coalesce("_file", html_path(F.col("id")))).drop("_file")


#: Columns of an index row.
INDEX = ("id", "file", "categoria", "fecha", "prestador", "profesional", "descripcion", "visualizarUrl", "captureUrl", "capturedAt", "sha256", "attachmentFile", "attachmentMime", "attachmentSha256")


def document_rows(docs: DataFrame, *keys: str, redact: bool = False) -> DataFrame:
    """Index rows of captured documents, after ``keys``; optional fields are null where absent, so ``to_json`` leaves them out.

    Attachment fields are there only for an attachment that is a PDF. With ``redact`` the free texts that may name a person
    (professional, description) are left out, and addresses end before their query.
    """
    if redact:
        none = F.lit(None).cast("string")
        docs = docs.withColumns({"profesional": none, "descripcion": none} | {c: F.regexp_replace(c, r"[?#].*$", "") for c in ("visualizarUrl", "captureUrl")})
    pdf = F.col("attachmentBase64").isNotNull() & (F.col("attachmentBase64") != "") & (F.col("attachmentMime") == PDF)
    return docs.select(
        *keys,
        "id",
        html_path(F.col("id")).alias("file"),
        *("categoria fecha prestador profesional descripcion visualizarUrl captureUrl capturedAt sha256".split()),
        F.when(pdf, F.concat(F.lit("docs/"), "id", F.lit(".pdf"))).alias("attachmentFile"),
        F.when(pdf, F.lit(PDF)).alias("attachmentMime"),
        F.when(pdf & (F.col("attachmentSha256") != ""), F.col("attachmentSha256")).alias("attachmentSha256"),
    )


def error_rows(errors: DataFrame, *keys: str) -> DataFrame:
    """Index rows of errors (meta struct, url, message, occurredAt), after ``keys``."""
    return errors.select(*keys, "meta.categoria", "meta.fecha", "meta.descripcion", "url", "message", "occurredAt")


def manifest(*, by: str, version: str, stats: Column, tokens: tuple[str, ...] = pii.LISTED_TOKENS) -> Column:
    """What was pseudonymised, and how; the files follow in the index."""
    return F.struct(F.lit(by).alias("by"), F.lit(version).alias("version"), F.lit("basic").alias("scope"), F.array(*map(F.lit, tokens)).alias("tokens"), stats.alias("stats"))


def check_manifest(files: DataFrame) -> DataFrame:
    """Files (file, html, declared) that are declared as pseudonymised and hold no token."""
    return files.where(F.col("declared") & ~F.col("html").rlike(r"\[[A-Z_0-9]+\]"))


#: Sections of an index: its head with the totals, the files that were pseudonymised, documents, errors, and what stands before each.
HEAD, FILES_BEGIN, FILES, FILES_END, DOCUMENTS_BEGIN, DOCUMENTS, ERRORS_BEGIN, ERRORS, END = range(9)


def metadata_lines(
    docs: DataFrame, errors: DataFrame, runs: DataFrame, *, by: str, order: str, now: Column, anonymized: bool = False, version: str = "1.0.0", patient: str = "paciente",
    document_hash: str | None = None, portal: str = "", base_url: str = "", redact: bool = False, export_id: Column | None = None,
) -> DataFrame:
    """(``by``, section, n, line): the index of each package of captured documents, line by line, so that a package may have any size.

    Lines in the order of section and n are its JSON: one for each document, error and pseudonymised file, from the second on with a
    comma before it. ``runs``: ``by``, expected, startedAt and, where pseudonymised, stats. Documents are in ``order``, errors by time,
    then message, address and kind.
    """
    rows = number_in_groups(document_rows(docs, F.col(order).alias("_at"), F.col(by).alias("_by"), redact=redact), "_by", F.col("_at"))
    fields = ("categoria", "fecha", "descripcion", "url", "message", "occurredAt")
    per = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_captured"))
    bad = error_rows(errors, F.col(by).alias("_of"))
    bad = number_in_groups(bad.join(per, F.col("_of").eqNullSafe(F.col("_by")), "left_semi"), "_of", *(F.col(c) for c in ("occurredAt", "message", "url", "categoria", "fecha", "descripcion")))
    failed = bad.groupBy("_of").agg(F.count(F.lit(1)).alias("_failed"))
    both = per.join(failed, F.col("_by").eqNullSafe(F.col("_of")), "left").join(runs, F.col("_by").eqNullSafe(F.col(by)), "left")
    head = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), (F.uuid() if export_id is None else export_id).alias("exportId"), iso_instant(now).alias("exportedAt"), F.col("startedAt"),
        F.struct(F.lit(portal).alias("portal"), F.lit(base_url).alias("baseUrl")).alias("source"),
        F.struct(F.lit(patient).alias("displayName"), F.lit(document_hash).cast("string").alias("documentHash")).alias("patient"),
        F.struct(F.col("expected").cast("long").alias("expected"), F.col("_captured").alias("captured"), F.coalesce("_failed", F.lit(0)).cast("long").alias("failed")).alias("totals"),
    )
    fixed = [(HEAD, F.regexp_replace(F.to_json(head), r"\}$", "")), (DOCUMENTS_BEGIN, F.lit(',"documents":[')), (ERRORS_BEGIN, F.lit('],"errors":[')), (END, F.lit("]}"))]
    if anonymized:
        said = F.struct(F.lit(True).alias("anonymized"), F.lit("basic").alias("anonymizationScope"), manifest(by="vellumflow", version=version, stats=F.col("stats")).alias("anonymization"))
        fixed += [(FILES_BEGIN, F.concat(F.lit(","), F.regexp_replace(F.to_json(said), r"^\{|\}\}$", ""), F.lit(',"files":['))), (FILES_END, F.lit("]}"))]
    lines = both.select(F.col("_by").alias(by), F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit(0).cast("long").alias("n"), line.alias("line")) for k, line in fixed))).alias("l")).select(by, "l.*")

    def listed(rows: DataFrame, key: str, section: int, json: Column) -> DataFrame:
        return rows.select(F.col(key).alias(by), F.lit(section).alias("section"), F.col("n").cast("long").alias("n"), F.concat(F.when(F.col("n") > 1, ",").otherwise(""), json).alias("line"))

    lines = lines.unionByName(listed(rows, "_by", DOCUMENTS, F.to_json(F.struct(*INDEX)))).unionByName(listed(bad, "_of", ERRORS, F.to_json(F.struct(*fields))))
    if anonymized:
        lines = lines.unionByName(listed(rows, "_by", FILES, F.regexp_replace(F.to_json(F.array("file")), r"^\[|\]$", "")))
    return lines


def read_lines(lines: DataFrame, *, by: str = "package") -> DataFrame:
    """(``by``, totals, exportedAt, place, d): the documents that the lines of indexes list, by their place from 0."""
    kinds = ", ".join(f"{c}: STRING" for c in INDEX)
    head = F.from_json(F.concat("line", F.lit("}")), "STRUCT<totals: STRUCT<expected: BIGINT, captured: BIGINT, failed: BIGINT>, exportedAt: STRING>")
    heads = lines.where(F.col("section") == HEAD).select(F.col(by).alias("_of"), head.alias("h")).select("_of", "h.*")
    document = F.from_json(F.regexp_replace("line", "^,", ""), f"STRUCT<{kinds}>")
    rows = lines.where(F.col("section") == DOCUMENTS).select(by, (F.col("n") - 1).alias("place"), document.alias("d"))
    return rows.join(heads, F.col(by).eqNullSafe(F.col("_of"))).drop("_of")


def metadata_by(docs: DataFrame, errors: DataFrame, runs: DataFrame, *, by: str, indent: bool = True, **options) -> DataFrame:
    """(``by``, json): the whole index of each package in a row, for packages bounded by ``package.shard``. Otherwise as ``metadata_lines``."""
    lines = metadata_lines(docs, errors, runs, by=by, **options)
    whole = F.array_sort(F.collect_list(F.struct("section", "n", "line")))
    return lines.groupBy(by).agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n" if indent else "").alias("json"))


def metadata(documents: DataFrame, errors: DataFrame, *, order: str, expected: int, started_at: Column, now: Column, **options) -> DataFrame:
    """One row, ``json``: the index of one package of captured documents."""
    one = documents.sparkSession.range(1).select(F.lit("").alias("package"), F.lit(expected).alias("expected"), iso_instant(started_at).alias("startedAt"))
    key = {"package": F.lit("")}
    return metadata_by(documents.withColumns(key), errors.withColumns(key), one, by="package", order=order, now=now, **options).select("json")


def readme(now: str, *, anonymized: bool) -> str:
    """Text that goes with a package."""
    state = (
        "Anonimización: activada (nivel básico).\n  Se sustituyeron nombre del paciente, cédula, teléfono y correo electrónico en los HTML;\n"
        "  en los PDF adjuntos se cubrió una banda del cabezal, sin borrar el texto que hay debajo.\n"
        if anonymized
        else "Anonimización: desactivada. El paquete contiene datos personales en claro.\n"
    )
    return f"Corpus exportado\n\nContenido:\n  metadata.json  índice de la corrida (schema v{SCHEMA_VERSION})\n  log.txt        log de operación\n  docs/          un HTML por registro y, si lo hay, su PDF\n\n{state}\nGenerado: {now}\n"


def require_exportable(captured: int, status: str, *, partial: bool = False) -> None:
    """Raise unless a run may be packaged: completed or asked for in part, and not empty."""
    if status != "completed" and not partial:
        raise ValueError(f"the run is {status}; pass partial=True to package what there is")
    if not captured:
        raise ValueError("nothing was captured")
