"""Named queries over the driver's tables and the SQL that gives the same rows.

Several inputs that the operators need (listing rows, phones, header cells, attachments) do not occur in the tables; they are
put together from columns by the same recipe in Spark and in SQL.
"""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as H
from .functions import pdf, pii, regex, routes
from .functions import text as T
from .functions import timeline as L
from .operators import anonymize as A
from .operators import corpus as C
from .operators import metadata as M
from .operators import package as K
from .operators.dictionary import Dictionary
from .plans.scratch import materialize, scratch_path
from .sources.archive import read_packages, zip_packages
from .sources.listing import list_records, read_details, scan_pages
from .sources.sinks import read_archives, write_files, write_packages
from .sources.tables import read_table, table_path
from .streaming.control import Run
from .streaming.run import run_to_end
from .streaming.tokens import drop_captured, tokenize_stream

NOISY = (*L.CATEGORIES, "Siguiente", "nosotros")
NAMES = ("Juan Pérez", "María Rodríguez", "José Núñez", "Ana Gómez", "Luis de la Rosa", "Juan José")


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words: tuple[str, ...], number: str):
    return F.element_at(F.array(*map(F.lit, words)), (F.col(number) % len(words) + 1).cast("int"))


# --- recipes: in Spark, and as common table expressions --------------------------------------------------------------------


def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" "), _pick(NOISY, "o_orderkey"), F.lit(" Prestador: Prov "), (F.col("o_custkey") % 7).cast("string"))
    cells = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), _pick(NOISY, "o_orderkey"), F.concat(F.lit("Consulta "), F.col("o_orderpriority")), F.concat(F.lit("Prestador: Prov "), (F.col("o_custkey") % 7).cast("string")), F.lit("ver"))
    return read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), row.alias("row"), cells.alias("cells"))


ROWS = f"""listing AS (SELECT o_orderkey, o_custkey AS custkey,
  strftime(o_orderdate, '%d/%m/%Y') || ' ' || ({_sql_list(NOISY)})[o_orderkey % {len(NOISY)} + 1] || ' Prestador: Prov ' || (o_custkey % 7) AS "row",
  [strftime(o_orderdate, '%d/%m/%Y'), ({_sql_list(NOISY)})[o_orderkey % {len(NOISY)} + 1], 'Consulta ' || o_orderpriority, 'Prestador: Prov ' || (o_custkey % 7), 'ver'] AS cells
  FROM orders)"""
CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(\"row\"), '{c.lower()}') THEN '{c}'" for c in L.CATEGORIES) + " END"
DATE = r"""CASE WHEN regexp_matches("row", '\b\d{2}/\d{2}/\d{4}\b') THEN regexp_replace(regexp_extract("row", '\b\d{2}/\d{2}/\d{4}\b', 0), '(\d{2})/(\d{2})/(\d{4})', '\3-\2-\1') END"""


def _sql_slug(x: str) -> str:
    return f"substring(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"


def phone_rows(spark: SparkSession, d: str) -> DataFrame:
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(
        F.lit("Tel 09"), (key % 10).cast("string"), F.lit(" "), three(key % 97), F.lit(" "), three(nation), F.lit(" y 2"), three(key % 50), F.lit(" "), F.lpad(nation.cast("string"), 4, "0"),
        F.lit(" CI 1.234."), three(key % 1000), F.lit("-"), (key % 10).cast("string"), F.lit(" mail C"), (key % 40).cast("string"), F.lit("@Example.com"),
    )
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))


PHONES = """phones AS (SELECT c_custkey AS id, 'Tel 09' || (c_custkey % 10) || ' ' || lpad(CAST(c_custkey % 97 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
  || ' y 2' || lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || ' CI 1.234.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
  || '-' || (c_custkey % 10) || ' mail C' || (c_custkey % 40) || '@Example.com' AS text FROM customer)"""


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    name = _pick(NAMES, "c_custkey")
    html = F.concat(
        F.lit('<table><tr><td class="td_label">Nombre</td><td class="td_header_role_value">'), name, F.lit('</td></tr><tr><td class="td_label">Documento</td><td class="td_header_role_value">'),
        F.when(F.col("c_custkey") % 10 == 0, "***").otherwise((F.col("c_custkey") + 100000).cast("string")), F.lit("</td></tr></table><p>Paciente "), name, F.lit(" refiere dolor.</p>"),
    )
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"), html.alias("html"))


HEADERS = f"""named AS (SELECT c_custkey AS id, ({_sql_list(NAMES)})[c_custkey % {len(NAMES)} + 1] AS name FROM customer),
headers AS (SELECT id, name, '<table><tr><td class="td_label">Nombre</td><td class="td_header_role_value">' || name
  || '</td></tr><tr><td class="td_label">Documento</td><td class="td_header_role_value">' || CASE WHEN id % 10 = 0 THEN '***' ELSE CAST(id + 100000 AS VARCHAR) END
  || '</td></tr></table><p>Paciente ' || name || ' refiere dolor.</p>' AS html FROM named)"""


def attachment_rows(spark: SparkSession, d: str) -> DataFrame:
    data = F.concat(F.lit("%PDF-1.4 "), "text").cast("binary")
    html = F.concat(F.lit('<pre id="b64">'), T.base64_plain(data), F.lit("</pre>"))
    return read_table(spark, d, "documents").select("doc_id", html.alias("html"))


ATTACHMENTS = """attached AS (SELECT doc_id, '<pre id="b64">' || to_base64(encode('%PDF-1.4 ' || text)) || '</pre>' AS html FROM documents),
raw AS (SELECT doc_id, regexp_extract(html, '<pre id="b64">(.*)</pre>', 1) AS b64 FROM attached),
bytes AS (SELECT doc_id, b64, from_base64(b64) AS data FROM raw WHERE length(b64) >= 100)"""

# The identifiers' shapes for DuckDB, whose regular expressions have ASCII word boundaries.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
CEDULA = r"\b(?:\d{1,3}(?:\.\d{3}){1,2}[-/]?\d?|\d{7,8}[-/]?\d?)\b"
PHONE = r"\+598[\s.\-]?\d{1,2}[\s.\-]?\d{3}[\s.\-]?\d{3,4}\b|\b09\d[\s.\-]?\d{3}[\s.\-]?\d{3}\b|\b(?:2|4)\d{3}[\s.\-]?\d{4}\b"
SEGMENT = H.SEGMENT


def _sql_map(x: str, pattern: str, change: str) -> str:
    """SQL that changes every match ``m`` in ``x``."""
    return (
        f"array_to_string([z[1] || CASE WHEN z[2] = '' THEN '' ELSE (SELECT {change} FROM (SELECT z[2] AS m)) END "
        f"FOR z IN list_zip(regexp_split_to_array({x}, '{pattern}'), list_append(regexp_extract_all({x}, '{pattern}', 0), ''))], '')"
    )


def _sql_cedula(x: str) -> str:
    ok = r"length(regexp_replace(z[2], '\D', '', 'g')) BETWEEN 7 AND 8"
    return f"array_to_string([z[1] || CASE WHEN z[2] = '' THEN '' WHEN {ok} THEN '[CI]' ELSE z[2] END FOR z IN list_zip(regexp_split_to_array({x}, '{CEDULA}'), list_append(regexp_extract_all({x}, '{CEDULA}', 0), ''))], '')"


def _sql_cedula_count(x: str) -> str:
    return rf"len(list_filter(regexp_extract_all({x}, '{CEDULA}', 0), lambda m: length(regexp_replace(m, '\D', '', 'g')) BETWEEN 7 AND 8))"


def _sql_tokens(x: str, pattern: str, key: str, table: str, prefix: str) -> str:
    """SQL that replaces matches by numbered tokens from a one-row map in ``table.m``."""
    return (
        f"array_to_string([z[1] || CASE WHEN z[2] = '' THEN '' ELSE '[{prefix}_' || ({table}.m)[{key.format('z[2]')}] || ']' END "
        f"FOR z IN list_zip(regexp_split_to_array({x}, '{pattern}'), list_append(regexp_extract_all({x}, '{pattern}', 0), ''))], '')"
    )


LOWER, DIGITS = "lower({})", r"regexp_replace({}, '[^\d+]', '', 'g')"


def _sql_first_seen(source: str, keys: str, name: str) -> str:
    """Common table expressions: ``name`` (key, n) numbered by first place, and ``name_map`` with one map."""
    return f"""{name}_places AS (SELECT id, unnest({keys}) AS key, generate_subscripts({keys}, 1) AS pos FROM {source}),
{name} AS (SELECT key, row_number() OVER (ORDER BY id, pos) AS n FROM (SELECT key, id, pos, row_number() OVER (PARTITION BY key ORDER BY id, pos) AS k FROM {name}_places) WHERE k = 1),
{name}_map AS (SELECT coalesce(map_from_entries(list((key, n))), MAP {{}}) AS m FROM {name})"""


def _email_keys(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{EMAIL}', 0), lambda e: lower(e))"


STUBBED = f"regexp_replace(text, '{EMAIL}', '[EMAIL_0]', 'g')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- scans, pages ------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS pages FROM documents")
def total_and_pages(spark, d):
    return read_table(spark, d, "documents").agg(F.count(F.lit(1)).alias("total")).select("total", L.page_count(F.col("total")).alias("pages"))


@query("SELECT doc_id, n AS ordinal, CAST(ceil(n / 10.0) AS BIGINT) AS page, (n - 1) % 10 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def page_ordinals(spark, d):
    return C.page_ordinals(read_table(spark, d, "documents").select("doc_id"), F.col("doc_id"))


def _footers(spark, d):
    """Footer of the page that a customer looks at: page o_custkey % 3 + 1 or the last one, ten rows a page."""
    count = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    first = (F.least(F.col("o_custkey") % 3, F.floor((F.col("n") - 1) / 10)) * 10 + 1).cast("long")
    line = F.concat(F.lit("Mostrando del "), first.cast("string"), F.lit(" al "), F.least(first + 9, "n").cast("string"), F.lit("  de "), F.col("n").cast("string"), F.lit(" RESULTADOS"))
    return count.select("o_custkey", line.alias("line"), F.concat(F.lit("Todos los registros ("), F.col("n").cast("string"), F.lit(")")).alias("side"))


FOOTERS = """counts AS (SELECT o_custkey, count(*) AS n, least(o_custkey % 3, (count(*) - 1) // 10) * 10 + 1 AS f FROM orders GROUP BY o_custkey),
footers AS (SELECT o_custkey, f, least(f + 9, n) AS t, n, 'Mostrando del ' || f || ' al ' || least(f + 9, n) || '  de ' || n || ' RESULTADOS' AS line, 'Todos los registros (' || n || ')' AS side FROM counts)"""


@query(f"""WITH {FOOTERS} SELECT o_custkey, CAST(f AS INT) AS first, CAST(t AS INT) AS last, CAST(n AS INT) AS total, CAST(greatest(1, ceil(f / (t - f + 1.0))) AS INT) AS page,
  CAST(greatest(1, ceil(n / (t - f + 1.0))) AS INT) AS pages, CAST(t - f + 1 AS INT) AS page_size, CAST(f // 10 + 1 AS INT) AS nominal FROM footers""")
def pagination_line(spark, d):
    rows = _footers(spark, d).select("o_custkey", L.total_line(F.col("line")).alias("l")).withColumn("p", L.pagination(F.col("l")))
    return rows.select("o_custkey", F.col("l.from").alias("first"), F.col("l.to").alias("last"), "l.total", "p.page", "p.pages", "p.page_size", L.nominal_page(F.col("l.from")).alias("nominal"))


@query(f"WITH {FOOTERS} SELECT o_custkey, CAST(regexp_extract(side, '\\((\\d+)\\)', 1) AS INT) AS n FROM footers")
def sidebar_count(spark, d):
    return _footers(spark, d).select("o_custkey", L.sidebar_count(F.col("side")).alias("n"))


@query(f"WITH {FOOTERS} SELECT o_custkey, CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE CAST(regexp_extract(side, '\\((\\d+)\\)', 1) AS INT) END AS n FROM footers")
def total_fallback(spark, d):
    key = F.col("o_custkey")
    rows = _footers(spark, d)
    return rows.select("o_custkey", L.total_records(F.when(key % 3 == 0, F.col("line")).otherwise("sin datos"), F.when(key % 3 == 1, F.col("side")).otherwise("nada")).alias("n"))


@query(f'WITH {ROWS} SELECT o_orderkey, {CATEGORY} AS categoria FROM listing')
def find_categoria(spark, d):
    return listing_rows(spark, d).select("o_orderkey", L.find_category(F.col("row")).alias("categoria"))


@query(f'WITH {ROWS} SELECT o_orderkey, {DATE} AS fecha FROM listing')
def find_fecha(spark, d):
    return listing_rows(spark, d).select("o_orderkey", L.find_date(F.col("row")).alias("fecha"))


@query(f'WITH {ROWS} SELECT o_orderkey, {CATEGORY} AS categoria, {DATE} AS fecha FROM listing WHERE length(trim("row")) > 0 AND {CATEGORY} IS NOT NULL AND {DATE} IS NOT NULL')
def timeline_filter(spark, d):
    rows = listing_rows(spark, d).where(F.length(F.trim("row")) > 0)
    return rows.select("o_orderkey", L.find_category(F.col("row")).alias("categoria"), L.find_date(F.col("row")).alias("fecha")).where("categoria is not null and fecha is not null")


@query(f"""WITH {ROWS}, r AS (SELECT o_orderkey, o_orderkey // 100 AS page, {DATE} || '_' || {_sql_slug(CATEGORY)} || '_' AS id FROM listing WHERE {CATEGORY} IS NOT NULL)
SELECT page, id, min(o_orderkey) AS o_orderkey FROM r GROUP BY page, id""")
def provisional_dedup(spark, d):
    rows = listing_rows(spark, d).withColumn("c", L.find_category(F.col("row"))).where("c is not null")
    rows = rows.select("o_orderkey", F.floor(F.col("o_orderkey") / 100).alias("page"), L.provisional_id(L.find_date(F.col("row")), F.col("c"), F.lit(None).cast("string")).alias("id"))
    return C.distinct_in_page(rows, "page", "id", "o_orderkey").select("page", "id", "o_orderkey")


@query(f"""WITH {ROWS}, r AS (SELECT o_orderkey, lower({CATEGORY}) AS c, "row", unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM listing WHERE {CATEGORY} IS NOT NULL),
k AS (SELECT o_orderkey, "row", cell, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(cell) DESC, pos) AS n FROM r
  WHERE lower(cell) NOT IN (c, '', 'ver', 'detalle') AND NOT (regexp_matches(cell, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AND length(cell) <= 10))
SELECT o_orderkey, CASE WHEN cell <> "row" THEN cell END AS descripcion FROM k WHERE n = 1""")
def descripcion_pick(spark, d):
    rows = listing_rows(spark, d).withColumn("c", L.find_category(F.col("row"))).where("c is not null")
    return rows.select("o_orderkey", L.pick_description(F.col("cells"), F.col("row"), F.col("c")).alias("descripcion"))


@query("SELECT o_orderkey, 'Prov ' || (o_custkey % 7) AS prestador, CAST(NULL AS VARCHAR) AS profesional FROM orders")
def labelled_cell(spark, d):
    rows = listing_rows(spark, d)
    return rows.select("o_orderkey", L.labelled_cell(F.col("cells"), "Prestador", "Institución").alias("prestador"), L.labelled_cell(F.col("cells"), "Profesional", "Médico").alias("profesional"))


@query(f"""WITH {ROWS}, base AS (SELECT o_orderkey, o_orderkey // 100 AS page, {CATEGORY} AS categoria, {DATE} AS fecha, custkey % 7 AS prov, cells FROM listing WHERE {CATEGORY} IS NOT NULL),
c AS (SELECT o_orderkey, lower(categoria) AS low, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM base),
k AS (SELECT o_orderkey, cell, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(cell) DESC, pos) AS n FROM c WHERE lower(cell) NOT IN (low, '', 'ver', 'detalle') AND NOT (regexp_matches(cell, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AND length(cell) <= 10)),
r AS (SELECT base.*, cell AS descripcion, fecha || '_' || {_sql_slug('categoria')} || '_' || {_sql_slug('cell')} AS id FROM base JOIN k USING (o_orderkey) WHERE n = 1)
SELECT page, id, 'visualizar?' || o_orderkey AS href, categoria, fecha, 'Prov ' || prov AS prestador, CAST(NULL AS VARCHAR) AS profesional, descripcion FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY o_orderkey) AS f FROM r) WHERE f = 1""")
def listing_records(spark, d):
    cells = F.array_join(F.transform(F.slice("cells", 1, 4), lambda c: F.concat(F.lit("<td>"), H.escape_html(c), F.lit("</td>"))), "")
    row = F.concat(F.lit("<tr>"), cells, F.lit('<td><a data-gx-evt="5" href="visualizar?'), F.col("o_orderkey").cast("string"), F.lit('">ver</a></td></tr>'))
    rows = listing_rows(spark, d).select(F.floor(F.col("o_orderkey") / 100).alias("page"), "o_orderkey", row.alias("row"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))).alias("r"))  # a page has a bounded number of rows
    html = F.concat(F.lit("<table><tbody>"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("</tbody></table>"))
    return list_records(pages.select("page", html.alias("html"))).select("page", "id", "href", "categoria", "fecha", "prestador", "profesional", "descripcion")


@query("""WITH totals AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS package, count(*) AS total FROM orders GROUP BY 1),
wanted AS (SELECT package, unnest(generate_series(1, CAST(greatest(1, ceil(total / 10.0)) AS BIGINT))) AS page FROM totals)
SELECT package, page, CASE WHEN page % 5 IN (3, 4) THEN 'No se pudo posicionar la página ' || page END AS error FROM wanted""")
def paginated_scan(spark, d):
    """Listings of records of ten rows a page. Of every five pages one is missing and one is empty; a page beyond the last is passed over."""
    rows = read_table(spark, d, "orders").select((F.col("o_custkey") % 40).cast("string").alias("package"), "o_orderkey")
    totals = rows.groupBy("package").agg(F.count(F.lit(1)).alias("total"))
    numbers = F.sequence(F.lit(1).cast("long"), L.page_count(F.col("total")) + 1)
    pages = totals.select("package", F.explode(numbers).alias("page")).where("page % 5 <> 3").withColumn("html", F.when(F.col("page") % 5 == 4, " ").otherwise("<table></table>"))
    there, errors = K.paginated_scan(pages, totals)
    return K.append_all(there.select("package", "page"), errors.select("package", F.regexp_extract("message", r"(\d+)$", 1).cast("long").alias("page"), F.col("message").alias("error")))


@query(f"""WITH {ROWS}, numbered AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 + 1 AS page FROM listing),
last AS (SELECT max(page) AS last FROM numbered),
base AS (SELECT o_orderkey, page, {CATEGORY} AS categoria, {DATE} AS fecha, cells FROM numbered, last WHERE {CATEGORY} IS NOT NULL AND page <> (last + 1) // 2),
c AS (SELECT o_orderkey, lower(categoria) AS low, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM base),
k AS (SELECT o_orderkey, cell, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(cell) DESC, pos) AS n FROM c WHERE lower(cell) NOT IN (low, '', 'ver', 'detalle') AND NOT (regexp_matches(cell, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AND length(cell) <= 10)),
r AS (SELECT base.*, fecha || '_' || {_sql_slug('categoria')} || '_' || {_sql_slug('cell')} AS id FROM base JOIN k USING (o_orderkey) WHERE n = 1)
SELECT page, id, 'visualizar?' || o_orderkey AS href, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY o_orderkey) AS f FROM r) WHERE f = 1
UNION ALL SELECT (last + 1) // 2, NULL, NULL, 'No se pudo posicionar la página ' || (last + 1) // 2 FROM last""")
def scanned_records(spark, d):
    """Listing pages as files, scanned as a stream: the page in the middle is missing, the scan fails there, goes on at its offset and reads the rest.

    The second time the missing page is passed over with an error. Records are read from the pages as scanned.
    """
    root = scratch_path(spark, "scan")
    cells = F.array_join(F.transform(F.slice("cells", 1, 4), lambda c: F.concat(F.lit("<td>"), H.escape_html(c), F.lit("</td>"))), "")
    row = F.concat(F.lit("<tr>"), cells, F.lit('<td><a data-gx-evt="5" href="visualizar?'), F.col("o_orderkey").cast("string"), F.lit('">ver</a></td></tr>'))
    numbered = C.page_ordinals(listing_rows(spark, d).select("o_orderkey", row.alias("row")), F.col("o_orderkey"), size=500)
    pages = numbered.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))).alias("r"))  # of 500 rows
    html = F.concat(F.lit("<table><tbody>"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("</tbody></table>"))
    last = numbered.agg(F.max("page").alias("last"))
    files = pages.join(F.broadcast(last), F.col("page") != F.floor((F.col("last") + 1) / 2))  # one row
    write_files(files.select(F.concat(F.lit("listing-"), F.col("page").cast("string"), F.lit(".html")).alias("name"), html.cast("binary").alias("data")), f"{root}/pages")
    try:
        scan_pages(spark, f"{root}/pages", root, onMissing="fail", firstWait=0)
    except StreamingQueryException as e:
        if "No se pudo posicionar" not in str(e):
            raise
    scanned = scan_pages(spark, f"{root}/pages", root, firstWait=0)
    errors = scanned.where("error is not null").select("page", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("href"), "error")
    return list_records(scanned.where("error is null").select("page", "html")).select("page", "id", "href", F.lit(None).cast("string").alias("error")).unionByName(errors)


@query("""SELECT c_custkey AS id, n_chars FROM customer JOIN documents ON doc_id = c_custkey % 2000 WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200 OR doc_id % 9 = 0""")
def listing_details(spark, d):
    """Listed records with their pages where these are ready: by text, or every ninth by an attachment."""
    listing = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2000).alias("key"))
    details = read_table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("html"), F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("A"), 200)).alias("b64"), "n_chars")
    return read_details(listing, details, key="key").select("id", "n_chars")


@query("SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN '<!DOCTYPE html>' ELSE '<!DOCTYPE svg>' END || chr(10) || html) AS sha256 FROM pages")
def serialize_document(spark, d):
    doctype = F.when(F.col("page_id") % 2 == 1, "<!DOCTYPE svg>")
    return read_table(spark, d, "pages").select("page_id", T.sha256_hex(H.serialize_document(doctype, F.col("html"))).alias("sha256"))


@query("SELECT c_custkey AS id, c_custkey % 6 IN (0, 1, 3) AS record, c_custkey % 6 = 4 AS listing, c_custkey % 6 IN (0, 3, 4) AS portal, c_custkey % 6 IN (0, 1, 2, 3, 4) AS host FROM customer")
def route_predicates(spark, d):
    """Addresses of records and listings, at the portal, at its host by another scheme, at none."""
    urls = ("https://portal.example/app/record?7", "http://portal.example/app/RECORD", "https://portal.example:8443/app/records", "https://u:p@portal.example:443/app/record", "https://PORTAL.example/app/list?all=1#x", "about:blank")
    hosts = F.when(F.col("c_custkey") % 6 == 2, routes.on_host(F.col("url"), "portal.example:8443")).otherwise(routes.on_host(F.col("url"), "portal.example"))
    rows = read_table(spark, d, "customer").select("c_custkey", _pick(urls, "c_custkey").alias("url"))
    return rows.select(F.col("c_custkey").alias("id"), routes.has_route(F.col("url"), "/app/record").alias("record"), routes.has_route(F.col("url"), "/app/list").alias("listing"), routes.at_portal(F.col("url"), "https://portal.example").alias("portal"), hosts.alias("host"))


# --- names of records and files ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_sql_slug('text')} AS slug FROM documents")
def slugify(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"""WITH named AS (SELECT p_partkey, {_sql_slug('p_brand')} || CASE WHEN p_partkey % 7 = 0 THEN '-2' WHEN p_partkey % 11 = 0 THEN '-3' ELSE '' END AS b FROM part),
n AS (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS n, min(p_partkey) OVER (PARTITION BY b) AS first FROM named),
stems AS (SELECT DISTINCT b, first, regexp_extract(b, '^(.+)-([23])$', 1) AS stem, CAST(regexp_extract(b, '^(.+-[0-9]+)-([23])$', 2) AS VARCHAR) AS k FROM n),
lits AS (SELECT b, stem, CAST(k AS INT) AS k, first, (SELECT count(*) FROM n WHERE n.b = stem AND n.p_partkey < stems.first) AS before FROM stems WHERE k <> '' AND stem IN (SELECT b FROM n)),
two AS (SELECT *, k <= before AS late FROM lits WHERE k = 2),
three AS (SELECT lits.*, 3 <= lits.before + CASE WHEN two.late = false AND two.first < lits.first AND lits.before >= 2 THEN 1 ELSE 0 END AS late FROM lits LEFT JOIN two ON two.stem = lits.stem WHERE lits.k = 3),
lit AS (SELECT b, stem, k, late FROM two UNION ALL SELECT b, stem, k, late FROM three),
taken AS (SELECT stem, list_sort(list(k)) AS ks FROM lit WHERE NOT late GROUP BY stem),
m AS (SELECT n.p_partkey, n.b, n.n + CASE WHEN coalesce(late, false) THEN 1 ELSE 0 END AS m, coalesce(ks, []) AS ks FROM n LEFT JOIN lit ON lit.b = n.b LEFT JOIN taken ON taken.stem = n.b)
SELECT p_partkey, CASE WHEN m = 1 THEN b ELSE b || '-' || (m + CASE WHEN list_contains(ks, 2) AND m >= 2 THEN 1 ELSE 0 END
  + CASE WHEN list_contains(ks, 3) AND m + CASE WHEN list_contains(ks, 2) AND m >= 2 THEN 1 ELSE 0 END >= 3 THEN 1 ELSE 0 END) END AS slug FROM m""")
def unique_slug(spark, d):
    """Brands as names; some parts are named by another brand's second or third name outright."""
    key = F.col("p_partkey")
    literal = F.when(key % 7 == 0, "-2").when(key % 11 == 0, "-3").otherwise("")
    rows = read_table(spark, d, "part").select("p_partkey", F.concat(T.slugify(F.col("p_brand")), literal).alias("base"))
    return C.unique_slugs(rows, "base", key).select("p_partkey", "slug")


EVENT_NAME = f"{DATE} || '_' || {_sql_slug(CATEGORY)} || CASE WHEN custkey % 5 = 0 THEN '' WHEN custkey % 5 = 1 THEN '_sin-descripcion' ELSE '_consulta-' || (custkey % 5) END"


@query(f"""WITH {ROWS}, r AS (SELECT o_orderkey, {EVENT_NAME} AS b FROM listing WHERE {CATEGORY} IS NOT NULL)
SELECT o_orderkey, 'docs/' || b || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.html' AS file FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o_orderkey) AS n FROM r)""")
def event_file_name(spark, d):
    rows = listing_rows(spark, d).withColumn("c", L.find_category(F.col("row"))).where("c is not null")
    key = F.col("custkey") % 5
    description = F.when(key == 0, "***").when(key == 1, F.lit(None)).otherwise(F.concat(F.lit("Consulta "), key.cast("string")))
    base = T.event_base_name(L.find_date(F.col("row")), F.col("c"), description)
    return C.unique_slugs(rows.withColumn("base", base), "base", F.col("o_orderkey")).select("o_orderkey", M.html_path(F.col("slug")).alias("file"))


@query(f"""SELECT c_custkey, 'export_' || CASE WHEN c_custkey % 4 = 0 THEN 'paciente' ELSE {_sql_slug(f'({_sql_list(NAMES)})[c_custkey % {len(NAMES)} + 1]')} END || '_' || strftime(TIMESTAMP '2026-04-20 10:30:00' + to_minutes(CAST(c_custkey AS INT)), '%Y-%m-%d_%H%M') || '.zip' AS file FROM customer""")
def zip_file_name(spark, d):
    owner = F.when(F.col("c_custkey") % 4 == 0, "***").otherwise(_pick(NAMES, "c_custkey"))
    at = F.expr("timestamp'2026-04-20 10:30:00' + make_interval(0, 0, 0, 0, 0, cast(c_custkey as int), 0)")
    return read_table(spark, d, "customer").select("c_custkey", T.archive_name(owner, at).alias("file"))


# --- hashes and duplicates ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_sha256(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.sha256_hex(F.col("text")).alias("sha256"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY 2")
def sha_dedup(spark, d):
    return C.keep_first_by_hash(doc_sha256(spark, d), "sha256", "doc_id")


@query("SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def sha_duplicates(spark, d):
    return C.duplicate_groups(doc_sha256(spark, d), "sha256")


@query("SELECT doc_id FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def incremental_anti(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", T.sha256_hex(F.col("text")).alias("sha256"))
    return C.not_yet_captured(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), "sha256").select("doc_id")


# --- identifiers -------------------------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"


@query(f"WITH {DOCS}, {_sql_first_seen('docs', _email_keys('text'), 'emails')} SELECT key, n FROM emails")
def email_tokens(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return A.first_seen(A.token_places(docs, "doc_id", "text", "email"))


@query(f"WITH {DOCS}, {_sql_first_seen('docs', _email_keys('text'), 'emails')} SELECT id AS doc_id, {_sql_tokens('text', EMAIL, LOWER, 'emails_map', 'EMAIL')} AS text FROM docs, emails_map")
def email_replace(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    places = A.token_places(docs, "doc_id", "text", "email")
    per = places.select("doc_id", "key").distinct().join(A.first_seen(places), "key").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("m"))
    return docs.join(per, "doc_id", "left").select("doc_id", A.replace_from_dictionary(F.col("text"), pii.EMAIL, pii.email_key, F.col("m"), "EMAIL").alias("text"))


@query(f"SELECT doc_id, {_sql_cedula('text')} AS text FROM documents")
def cedula_replace(spark, d):
    return read_table(spark, d, "documents").select("doc_id", pii.rewrite_national_ids(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_sql_cedula_count('text')} AS n FROM documents")
def cedula_count(spark, d):
    return read_table(spark, d, "documents").select("doc_id", pii.count_national_ids(F.col("text")).alias("n"))


LEFT = f"lefts AS (SELECT id, {_sql_cedula(STUBBED)} AS text FROM phones)"
PHONE_KEYS = rf"list_transform(regexp_extract_all(text, '{PHONE}', 0), lambda e: regexp_replace(e, '[^\d+]', '', 'g'))"


@query(f"WITH {PHONES}, {LEFT}, {_sql_first_seen('lefts', PHONE_KEYS, 'tels')} SELECT key, n FROM tels")
def phone_tokens(spark, d):
    return A.first_seen(A.token_places(phone_rows(spark, d), "id", "text", "tel"))


ANON_PHONES = f"""WITH {PHONES}, {LEFT}, {_sql_first_seen('lefts', PHONE_KEYS, 'tels')}, {_sql_first_seen('phones', _email_keys('text'), 'emails')},
step AS (SELECT id, {_sql_tokens('text', EMAIL, LOWER, 'emails_map', 'EMAIL')} AS text FROM phones, emails_map),
step2 AS (SELECT id, {_sql_cedula('text')} AS text FROM step)
SELECT id, {_sql_tokens('text', PHONE, DIGITS, 'tels_map', 'TEL')} AS text FROM step2, tels_map"""


@query(ANON_PHONES)
def phone_replace(spark, d):
    return A.anonymize(phone_rows(spark, d), order="id", text="text", markup=False, names=False).docs


# --- pages -------------------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, unnest(s) AS segment, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '{SEGMENT}', 0) AS s FROM pages)")
def html_segments(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.posexplode(H.segments(F.col("html"))).alias("p", "segment")).select("page_id", "segment", F.col("p").cast("long").alias("pos"))


@query(f"""WITH s AS (SELECT unnest(regexp_extract_all(html, '{SEGMENT}', 0)) AS s FROM pages)
SELECT CASE WHEN NOT starts_with(s, '<') THEN 'text' WHEN starts_with(lower(s), '<script') THEN 'script' WHEN starts_with(lower(s), '<style') THEN 'style' WHEN starts_with(s, '<!--') THEN 'comment' ELSE 'tag' END AS zone,
  count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM s GROUP BY 1""")
def html_zone_counts(spark, d):
    rows = read_table(spark, d, "pages").select(F.explode(H.segments(F.col("html"))).alias("s"))
    return rows.groupBy(H.zone(F.col("s")).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).cast("long").alias("chars"))


TEXT_SQL = f"""WITH {DOCS}, {_sql_first_seen('docs', _email_keys('text'), 'emails')}, lefts AS (SELECT id, {_sql_cedula(STUBBED)} AS text FROM docs), {_sql_first_seen('lefts', PHONE_KEYS, 'tels')},
step AS (SELECT id, {_sql_tokens('text', EMAIL, LOWER, 'emails_map', 'EMAIL')} AS text FROM docs, emails_map), step2 AS (SELECT id, {_sql_cedula('text')} AS text FROM step)
SELECT id AS doc_id, sha256({_sql_tokens('text', PHONE, DIGITS, 'tels_map', 'TEL')}) AS sha256 FROM step2, tels_map"""


@query(TEXT_SQL)
def anonymize_text(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return A.anonymize(docs, order="doc_id", text="text", markup=False).docs.select("doc_id", T.sha256_hex(F.col("text")).alias("sha256"))


@query(TEXT_SQL)
def anonymize_batches(spark, d):
    """Documents in three batches by number, with a dictionary that is kept between them; the second is run twice."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    kept, last = Dictionary(scratch_path(spark, "dictionary")), docs.agg(F.max("doc_id")).first()[0]
    done = []
    for batch in (0, 1, 1, 2):
        part = docs.where(F.floor(F.col("doc_id") * 3 / (last + 1)) == batch)
        result = A.anonymize(part, order="doc_id", text="text", markup=False, names_scope="cumulative", dictionary=kept, batch=batch)
        done.append(materialize(result.docs.select("doc_id", T.sha256_hex(F.col("text")).alias("sha256")), "batch"))
    return K.append_all(done[0], done[2], done[3])


PAGE_PARTS = f"""pg AS (SELECT page_id AS id, html FROM pages),
seg AS (SELECT id, regexp_extract_all(html, '{SEGMENT}', 0) AS s FROM pg),
texts AS (SELECT id, list_filter(s, lambda x: NOT starts_with(x, '<')) AS s FROM seg)"""
PAGE_EMAILS = f"flatten(list_transform(s, lambda x: {_email_keys('x')}))"


PAGE_STEPS = f"""{_sql_first_seen('texts', PAGE_EMAILS, 'emails')}, parts AS (SELECT id, unnest(s) AS text, generate_subscripts(s, 1) AS pos FROM seg),
lefts AS (SELECT id, pos, CASE WHEN starts_with(text, '<') THEN '' ELSE {_sql_cedula(STUBBED)} END AS text FROM parts),
places AS (SELECT id, pos, unnest({PHONE_KEYS}) AS key, generate_subscripts({PHONE_KEYS}, 1) AS k FROM lefts),
tels AS (SELECT key, row_number() OVER (ORDER BY id, pos, k) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, pos, k) AS f FROM places) WHERE f = 1),
tels_map AS (SELECT coalesce(map_from_entries(list((key, n))), MAP {{}}) AS m FROM tels),
step AS (SELECT id, pos, text AS raw, {_sql_tokens('text', EMAIL, LOWER, 'emails_map', 'EMAIL')} AS text FROM parts, emails_map), step2 AS (SELECT id, pos, raw, {_sql_cedula('text')} AS text FROM step),
step3 AS (SELECT id, pos, raw, CASE WHEN starts_with(raw, '<') THEN raw ELSE {_sql_tokens('text', PHONE, DIGITS, 'tels_map', 'TEL')} END AS text FROM step2, tels_map)"""


@query(f"""WITH {PAGE_PARTS}, {PAGE_STEPS}
SELECT id AS page_id, sha256(string_agg(text, '' ORDER BY pos)) AS sha256 FROM step3 GROUP BY id""")
def anonymize_pages(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "html")
    return A.anonymize(pages, order="page_id", text="html", markup=True).docs.select("page_id", T.sha256_hex(F.col("html")).alias("sha256"))


def named_pages(pages: DataFrame) -> DataFrame:
    """Every fifth page begins with a name after a label, every second ends with a mention of one."""
    name, key = _pick(NAMES, "page_id"), F.col("page_id")
    label = F.when(key % 5 == 0, F.concat(F.lit("<p>Paciente: "), name, F.lit(";</p>"))).otherwise("")
    mention = F.when(key % 2 == 0, F.concat(F.lit("<p>firma "), name, F.lit("</p>"))).otherwise("")
    return pages.select("page_id", F.concat(label, F.col("html"), mention).alias("html"))


_PICKED = f"({_sql_list(NAMES)})[page_id % {len(NAMES)} + 1]"
NAMED_PAGES = f"""pg AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN '<p>Paciente: ' || {_PICKED} || ';</p>' ELSE '' END || html
  || CASE WHEN page_id % 2 = 0 THEN '<p>firma ' || {_PICKED} || '</p>' ELSE '' END AS html FROM pages),""" + PAGE_PARTS.split("FROM pages),", 1)[1]


def contact_rows(spark, d) -> DataFrame:
    """Phone rows of which every seventh names a person after a label, and every fifth mentions one."""
    key, name = F.col("id"), _pick(NAMES, "id")
    label = F.when(key % 7 == 0, F.concat(F.lit("Paciente: "), name, F.lit("; "))).otherwise("")
    mention = F.when(key % 5 == 0, F.concat(F.lit(", firma "), name)).otherwise("")
    return phone_rows(spark, d).select("id", F.concat(label, F.col("text"), mention).alias("text"))


CONTACTS = f"""{PHONES}, contacts AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Paciente: ' || ({_sql_list(NAMES)})[id % {len(NAMES)} + 1] || '; ' ELSE '' END || text
  || CASE WHEN id % 5 = 0 THEN ', firma ' || ({_sql_list(NAMES)})[id % {len(NAMES)} + 1] ELSE '' END AS text FROM phones)"""


@query(f"""WITH {CONTACTS}, lefts AS (SELECT id, {STUBBED} AS text FROM contacts), after AS (SELECT id, {_sql_cedula('text')} AS text FROM lefts)
SELECT CAST((SELECT sum({_sql_cedula_count('text')}) FROM lefts) AS BIGINT) AS cedulas, (SELECT count(DISTINCT k) FROM (SELECT unnest({PHONE_KEYS}) AS k FROM after)) AS telephones,
  (SELECT count(DISTINCT k) FROM (SELECT unnest({_email_keys('text')}) AS k FROM contacts)) AS emails,
  (SELECT count(DISTINCT lower(strip_accents(regexp_extract(text, 'Paciente: ([^;]+);', 1)))) FROM contacts WHERE starts_with(text, 'Paciente: ')) AS patient_names""")
def anonymizer_stats(spark, d):
    return A.anonymizer_stats(A.anonymize(contact_rows(spark, d), order="id", text="text", markup=False))


@query(f"""WITH {CONTACTS} SELECT count(*) AS rows, count_if(NOT regexp_matches(text, '(?i)paciente|firma')) AS without_names, CAST(0 AS BIGINT) AS changed, count_if(contains(text, 'Juan José')) AS left_over FROM contacts""")
def anonymize_idempotent(spark, d):
    """A second run changes nothing, and no address, number or name is left but the one that ends in an accented letter."""
    once = A.anonymize(contact_rows(spark, d), order="id", text="text", markup=False).docs
    twice = A.anonymize(once, order="id", text="text", markup=False).docs.withColumnRenamed("text", "again")
    left = F.col("text").rlike("@|" + pii.PHONE + "|1\\.234\\.") | (F.col("text").rlike("Paciente|firma") & ~F.col("text").contains(pii.NAME_TOKEN))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("text").rlike("(?i)paciente|firma")).alias("without_names"), F.count_if(F.col("text") != F.col("again")).alias("changed"), F.count_if(left).alias("left_over")]
    return once.join(twice, "id").agg(*counts)


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?i)</td\s*>\s*<td\b[^>]*>', ': ', 'g'), '(?i)</tr\s*>', chr(10), 'g'),
  '(?i)<br\s*/?\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10))) AS sha256 FROM pages""")
def strip_tags(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.sha256_hex(pii.readable_text(F.col("html"))).alias("sha256"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<meta charset="utf-8">', '<META charset=ISO-8859-1 />') WHEN page_id % 3 = 1 THEN replace(html, '<meta charset="utf-8">', '') ELSE html END AS h FROM pages),
q AS (SELECT page_id, regexp_replace(h, '(?i)<meta\s+charset\s*=\s*["\x27]?[^"\x27>\s]+["\x27]?\s*/?>', '<meta charset="utf-8">', 'g') AS h FROM p)
SELECT page_id, sha256(CASE WHEN regexp_matches(h, '(?i)charset\s*=\s*["\x27]?utf-?8') THEN h ELSE regexp_replace(h, '(?i)<head(\b[^>]*)>', '<head\1>' || chr(10) || '<meta charset="utf-8">') END) AS sha256 FROM q""")
def charset_rewrite(spark, d):
    h, key = F.col("html"), F.col("page_id") % 3
    h = F.when(key == 0, F.replace(h, F.lit('<meta charset="utf-8">'), F.lit("<META charset=ISO-8859-1 />"))).when(key == 1, F.replace(h, F.lit('<meta charset="utf-8">'), F.lit(""))).otherwise(h)
    return read_table(spark, d, "pages").select("page_id", T.sha256_hex(H.rewrite_charset(h)).alias("sha256"))


ROUTES = r"""SELECT page_id, parse_host AS host, regexp_matches(url, '/en/\d+') AS detail, contains(url, '?') AS with_query FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS parse_host FROM pages)"""


@query(ROUTES)
def url_routes(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), F.col("url").rlike(r"/en/\d+").alias("detail"), F.col("url").contains("?").alias("with_query"))


def _samples(tag: str, most: int, chars: int, plain: bool) -> str:
    x = "regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')" if plain else "x"
    return f"array_to_string(list_transform(regexp_extract_all(html, '(?is)<{tag}[ >].*?</{tag}>')[1:{most}], lambda x: substring({x}, 1, {chars})), chr(10))"


@query(r"""WITH t AS (SELECT page_id, html, list_filter(regexp_extract_all(html, 'SEGMENT', 0), lambda s: regexp_matches(s, '^<[A-Za-z]')) AS tags FROM pages),
names AS (SELECT page_id, array_to_string(list_sort(list_distinct(flatten(list_transform(tags, lambda s: list_transform(regexp_extract_all(s, '\s([A-Za-z][A-Za-z0-9_-]*)=', 1), lambda n: lower(n)))))), ' ') AS attributes FROM t)
SELECT page_id, len(regexp_extract_all(html, '(?i)<a[ >]')) AS n_a, len(regexp_extract_all(html, '(?i)<tr[ >]')) AS n_tr, len(regexp_extract_all(html, '(?i)<iframe[ >]')) AS n_iframe,
  len(regexp_extract_all(html, '(?i)<form[ >]')) AS n_form, len(regexp_extract_all(html, '(?i)<li[ >]')) AS n_li, attributes, CAST(least(3, len(regexp_extract_all(html, '(?is)<tr[ >].*?</tr>'))) AS BIGINT) AS row_samples,
  array_to_string(list_transform(regexp_extract_all(html, '(?is)<a[ >].*?</a>')[1:10], lambda a: substring(a, 1, 120)), chr(10)) AS anchors, ROWS AS rows, ROWTEXTS AS row_texts, ATEXTS AS anchor_texts FROM t JOIN names USING (page_id)""".replace("SEGMENT", SEGMENT).replace("ROWTEXTS", _samples("tr", 3, 200, True)).replace("ROWS", _samples("tr", 3, 600, False)).replace("ATEXTS", _samples("a", 10, 80, True)))
def dom_diagnostics(spark, d):
    return read_table(spark, d, "pages").select("page_id", *H.diagnostics(F.col("html")))


# --- names, header cells -----------------------------------------------------------------------------------------------------


def _sql_name(x: str) -> str:
    """SQL of a canonical name."""
    parts = f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z\\s'']', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda p: length(p) >= 2)"
    return f"CASE WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda p: length(p) >= 3)) >= 2 THEN array_to_string({parts}, ' ') ELSE '' END"


@query(f"WITH {HEADERS} SELECT id, {_sql_name('name')} AS name FROM headers")
def normalize_name(spark, d):
    return header_rows(spark, d).select("id", pii.normalize_name(F.col("name")).alias("name"))


@query(f"WITH {HEADERS} SELECT {_sql_name('name')} AS name, min(id) AS first, row_number() OVER (ORDER BY min(id)) AS n FROM headers GROUP BY 1")
def extract_names(spark, d):
    return A.find_names(header_rows(spark, d), "id", "html")


def _fuzzy(name: str) -> str:
    both = {"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uú]", "n": "[nñ]"}
    parts = ["".join(both.get(c, c) for c in p) for p in name.split()]
    return r"(?i)\b(?:" + r",?\s+".join(parts) + "|" + r",?\s+".join(reversed(parts)) + r")\b"


_PLAIN = ("juan perez", "maria rodriguez", "jose nunez", "ana gomez", "luis de la rosa", "juan jose")
_REPLACED = "x"
for _name in _PLAIN:
    _REPLACED = f"regexp_replace({_REPLACED}, '{_fuzzy(_name)}', '[PACIENTE]', 'g')"
HEADER_SQL = r"CASE WHEN id % 10 = 0 THEN html ELSE regexp_replace(html, '<td class=\"td_label\">Documento</td><td( class=\"td_header_role_value\")>\d+</td>', '<td class=\"td_header_role_name\"><span class=\"td_label\">Documento</span></td><td\1>[ID]</td>') END".replace('\\"', '"')


@query(f"WITH {HEADERS} SELECT id, {HEADER_SQL} AS html FROM headers")
def header_id(spark, d):
    return header_rows(spark, d).select("id", pii.rewrite_header_id(F.col("html")).alias("html"))


@query(f"""WITH {HEADERS}, h AS (SELECT id, {HEADER_SQL} AS html FROM headers), seg AS (SELECT id, regexp_extract_all(html, '{SEGMENT}', 0) AS s FROM h)
SELECT id, array_to_string(list_transform(s, lambda x: CASE WHEN starts_with(x, '<') THEN x ELSE {_REPLACED} END), '') AS html FROM seg""")
def replace_names(spark, d):
    return A.anonymize(header_rows(spark, d).select("id", "html"), order="id", text="html", markup=True).docs


@query("SELECT c_custkey AS id, c_custkey % 6 <> 4 AND c_custkey % 6 <> 5 AS redacted FROM customer")
def redacted_values(spark, d):
    values = ("[ID]", "", "***", "XXX", "AB-12345", "122437")
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), pii.is_redacted(_pick(values, "c_custkey")).alias("redacted"))


# --- attachments -------------------------------------------------------------------------------------------------------------


@query(f"WITH {ATTACHMENTS} SELECT doc_id, b64 AS base64, 'application/pdf' AS mime, sha256(data) AS sha256 FROM bytes")
def attachment_extract(spark, d):
    return attachment_rows(spark, d).select("doc_id", H.attachment_struct(F.col("html")).alias("a")).where("a is not null").select("doc_id", "a.*")


PAGE = "'<!DOCTYPE html>' || chr(10) || '<html lang=\"es\">' || chr(10) || '<head><meta charset=\"utf-8\"><title>' || t || '</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>' || t || '</h1>' || chr(10) || '<dl>' || chr(10) || CASE WHEN d <> '' THEN '<dt>Descripción</dt><dd>' || d || '</dd>' || chr(10) ELSE '' END || '<dt>Archivo</dt><dd><a href=\"./' || f || '\">' || f || '</a></dd>' || chr(10) || '<dt>SHA-256</dt><dd><code>' || s || '</code></dd>' || chr(10) || '</dl>' || chr(10) || '<embed src=\"./' || f || '\" type=\"application/pdf\">' || chr(10) || '</body>' || chr(10) || '</html>'"


@query(f"""SELECT doc_id, {PAGE} AS html FROM (SELECT doc_id, 'Laboratorio — 2026-01-02' AS t, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS d, 'd' || doc_id || '.pdf' AS f, sha256(text) AS s FROM documents)""")
def attachment_html(spark, d):
    docs, none = read_table(spark, d, "documents"), F.lit(None).cast("string")
    page = H.attachment_page(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("Laboratorio"), F.lit("2026-01-02"), T.sha256_hex(F.col("text")), F.col("text"), none, none)
    return docs.select("doc_id", page.alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'base64 decode falló' WHEN doc_id % 3 = 1 THEN 'No es un PDF válido (magic number incorrecto)' END AS problem FROM documents")
def pdf_validate(spark, d):
    """Of every document: no base64, base64 of the text alone, and of the text as a PDF."""
    key, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    data = F.when(key == 0, F.concat(F.lit("!"), text)).when(key == 1, T.base64_plain(F.concat(F.lit("hola "), text).cast("binary"))).otherwise(T.base64_plain(F.concat(F.lit("%PDF-1.4 "), text).cast("binary")))
    return read_table(spark, d, "documents").select("doc_id", pdf.pdf_problem(T.base64_bytes(data)).alias("problem"))


@query("SELECT doc_id, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 7 = 0 THEN 'No es un PDF válido (magic number incorrecto)' END AS reason, doc_id % 7 <> 0 AS changed, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 3 + 1 END AS pages FROM documents")
def pdf_redact(spark, d):
    """Files of one to three pages with the document as their contents, covered; every seventh is no PDF. Each page gets contents of its own."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    numbers = F.sequence(F.lit(3), (3 + key % 3).cast("int"))
    kids = F.array_join(F.transform(numbers, lambda i: F.concat(i.cast("string"), F.lit(" 0 R"))), " ")
    page = lambda i: F.concat(i.cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>\nendobj\n"))
    whole = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /MediaBox [0 0 595 842] /Kids ["), kids, F.lit("] >>\nendobj\n"),
        F.array_join(F.transform(numbers, page), ""), F.lit("9 0 obj\n<< /Length "), F.octet_length(text).cast("string"), F.lit(" >>\nstream\n"), text,
        F.lit("\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"),
    )
    data = F.when(key % 7 == 0, "hola").otherwise(whole).cast("binary")
    done = read_table(spark, d, "documents").select("doc_id", data.alias("data"), pdf.redact_pdf(data).alias("r"))
    new = F.expr("substring(r.data, octet_length(data) + 1, octet_length(r.data))").cast("string")
    pages = F.when(F.col("r.ok"), F.regexp_count(new, F.lit(r"/Type\s*/Page\b"))).otherwise(0)
    return done.select("doc_id", "r.ok", "r.reason", (F.col("r.data") != F.col("data")).alias("changed"), pages.cast("long").alias("pages"))


# --- index, totals, logs -----------------------------------------------------------------------------------------------------


def captured(spark, d) -> DataFrame:
    key, text = F.col("doc_id"), F.col("text")
    return read_table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("d"), key.cast("string")).alias("id"), _pick(L.CATEGORIES, "doc_id").alias("categoria"), F.lit("2026-01-02").alias("fecha"),
        F.when(key % 2 == 0, F.col("source")).alias("prestador"), F.when(key % 3 == 0, F.lit("Dra. X")).alias("profesional"), F.when(key % 5 != 0, F.col("text")).alias("descripcion"),
        F.lit("/v").alias("visualizarUrl"), F.lit("/c").alias("captureUrl"), F.lit("2026-01-02T03:04:05.678Z").alias("capturedAt"), T.sha256_hex(text).alias("sha256"),
        F.when(key % 4 == 0, F.lit("JVBERg==")).alias("attachmentBase64"), F.when(key % 8 == 0, M.PDF).when(key % 4 == 0, "text/plain").alias("attachmentMime"), F.when(key % 16 == 0, F.lit("ab")).alias("attachmentSha256"),
    )


DOCUMENTS = f"""SELECT 'd' || doc_id AS id, 'docs/d' || doc_id || '.html' AS file, ({_sql_list(L.CATEGORIES)})[doc_id % {len(L.CATEGORIES)} + 1] AS categoria, '2026-01-02' AS fecha, CASE WHEN doc_id % 2 = 0 THEN source END AS prestador,
  CASE WHEN doc_id % 3 = 0 THEN 'Dra. X' END AS profesional, CASE WHEN doc_id % 5 <> 0 THEN text END AS descripcion, '/v' AS "visualizarUrl", '/c' AS "captureUrl", '2026-01-02T03:04:05.678Z' AS "capturedAt",
  sha256(text) AS sha256, CASE WHEN doc_id % 8 = 0 THEN 'docs/d' || doc_id || '.pdf' END AS "attachmentFile", CASE WHEN doc_id % 8 = 0 THEN 'application/pdf' END AS "attachmentMime", CASE WHEN doc_id % 16 = 0 THEN 'ab' END AS "attachmentSha256" FROM documents"""


@query(DOCUMENTS)
def metadata_documents(spark, d):
    return M.document_rows(captured(spark, d))


@query("SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'archivo/' || doc_id || '.htm' ELSE 'docs/d' || doc_id || '.html' END AS file FROM documents")
def metadata_file_lookup(spark, d):
    """The index names a path of its own for every seventh document; the others have the usual one."""
    index = M.document_rows(captured(spark, d).where("doc_id % 7 = 0")).withColumn("file", F.concat(F.lit("archivo/"), F.substring("id", 2, 20), F.lit(".htm")))
    return M.file_of(captured(spark, d).select("id"), index)


@query("SELECT 2 * (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM documents) AS captured, (SELECT count(*) FROM labels) AS failed, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS missing")
def metadata_totals(spark, d):
    docs, errors = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    both = docs.agg(F.count(F.lit(1)).alias("c"), (2 * F.count(F.lit(1))).alias("e")).crossJoin(errors.agg(F.count(F.lit(1)).alias("f")))
    return both.select(F.col("e").alias("expected"), F.col("c").alias("captured"), F.col("f").alias("failed"), T.missing_count(F.col("e"), F.col("c"), F.col("f")).alias("missing"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'Vacunas' END AS categoria, CASE WHEN doc_id % 3 = 0 THEN '2026-01-02' END AS fecha, CAST(NULL AS VARCHAR) AS descripcion, CASE WHEN doc_id % 5 = 0 THEN '/u' || doc_id END AS url, 'e' || doc_id AS message, 'now' AS \"occurredAt\" FROM labels")
def metadata_errors(spark, d):
    key = F.col("doc_id")
    meta = F.struct(F.when(key % 2 == 0, "Vacunas").alias("categoria"), F.when(key % 3 == 0, "2026-01-02").alias("fecha"), F.lit(None).cast("string").alias("descripcion"))
    errors = read_table(spark, d, "labels").select(meta.alias("meta"), F.when(key % 5 == 0, F.concat(F.lit("/u"), key.cast("string"))).alias("url"), F.concat(F.lit("e"), key.cast("string")).alias("message"), F.lit("now").alias("occurredAt"))
    return M.error_rows(errors)


@query("SELECT source, n + 5 AS expected, n AS captured, n % 3 AS failed, CASE WHEN n + n % 3 < n + 5 THEN 5 - n % 3 END AS missing FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def discrepancy(spark, d):
    rows = read_table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", (F.col("n") + 5).alias("expected"), F.col("n").alias("captured"), (F.col("n") % 3).alias("failed"), T.missing_count(F.col("n") + 5, F.col("n"), F.col("n") % 3).alias("missing"))


def log_rows(spark, d) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return read_table(spark, d, "events").select("event_id", C.log_line(F.col("ts"), level, F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("props"))).alias("line"))


LOG = "log AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' ' || rpad(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, 5, ' ') || ' ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' ' || props ELSE '' END AS line FROM events)"


@query(f"WITH {LOG} SELECT * FROM log ORDER BY event_id DESC LIMIT 2000")
def log_ring(spark, d):
    return C.last_rows(log_rows(spark, d), "event_id", 2000)


@query(f"WITH {LOG}, ring AS (SELECT * FROM log ORDER BY event_id DESC LIMIT 2000) SELECT sha256(string_agg(line, chr(10) ORDER BY event_id) || chr(10)) AS sha256 FROM ring")
def log_serialize(spark, d):
    return C.log_text(C.last_rows(log_rows(spark, d), "event_id", 2000), "line", "event_id").select(F.sha2("log", 256).alias("sha256"))


@query("SELECT event_id, event_type FROM events WHERE value > 50 ORDER BY event_id DESC LIMIT 5")
def errors_last5(spark, d):
    return C.last_rows(read_table(spark, d, "events").where("value > 50").select("event_id", "event_type"), "event_id", 5)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def events_top20(spark, d):
    return C.last_rows(read_table(spark, d, "events").select("event_id", "event_type"), "event_id", 20, newest_first=True)


@query("SELECT count(*) AS processed, CAST(15000 AS BIGINT) AS total, 'running' AS status, 'Extrayendo…' AS label, CAST(least(100, floor(100.0 * count(*) / 15000 + 0.5)) AS BIGINT) AS percent, max_by(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events")
def progress(spark, d):
    out = C.progress(read_table(spark, d, "events"), order="event_id", total=F.lit(15000), status=F.lit("running"), document=["event_id", "event_type"])
    return out.select("processed", "total", "status", "label", "percent", F.col("last_document.event_type").alias("last_type"), F.col("last_document.event_id").alias("last_id"))


_CASES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(T.OVERLAY_LABELS.values()))
_CASES2 = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(T.PANEL_LABELS.values()))


@query(f"SELECT event_id, CASE event_id % 7 {_CASES} END AS overlay, CASE event_id % 7 {_CASES2} END AS panel, event_id % 7 NOT IN (1, 2, 3) AS ended, event_id % 7 IN (1, 2, 3) AS busy, event_id % 5 > 0 OR event_id % 7 = 5 AS downloadable FROM events")
def status_label(spark, d):
    state = _pick(tuple(T.OVERLAY_LABELS), "event_id")
    return read_table(spark, d, "events").select("event_id", T.state_label(state).alias("overlay"), T.state_label(state, T.PANEL_LABELS).alias("panel"), T.polling_ends(state).alias("ended"), T.is_busy(state).alias("busy"), T.can_download(state, F.col("event_id") % 5).alias("downloadable"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.2f MiB', b / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 200) + 1 AS b FROM documents)")
def format_bytes(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.format_bytes(F.col("n_chars") * (F.col("doc_id") % 200) + 1, half_even=True).alias("size"))


@query("SELECT event_id, CAST(least(16000, 1000 * (2 ** (event_id % 6))) AS BIGINT) AS ms FROM events")
def backoff(spark, d):
    return read_table(spark, d, "events").select("event_id", T.backoff_ms(F.col("event_id") % 6).alias("ms"))


NOW = "2026-01-02 03:04:05"


def run_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, errors, log lines and runs, a run per source: an error for each label, a log line for each document."""
    docs = captured(spark, d).join(read_table(spark, d, "documents").select("doc_id", F.col("source").alias("package"), F.col("text").alias("html")), "doc_id")
    key = F.col("doc_id")
    meta = F.struct(F.when(key % 2 == 0, "Vacunas").alias("categoria"), F.lit(None).cast("string").alias("fecha"), F.lit(None).cast("string").alias("descripcion"))
    errors = read_table(spark, d, "labels").join(docs.select("doc_id", "package"), "doc_id")
    errors = errors.select("package", meta.alias("meta"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("e"), key.cast("string")).alias("message"), F.lit("2026-01-01").alias("occurredAt"))
    at = F.timestamp_seconds(key + 1_700_000_000)
    log = docs.select("package", at.alias("at"), F.when(key % 10 == 0, "ERROR").otherwise("INFO").alias("level"), F.concat(F.lit("d"), key.cast("string")).alias("message"), F.lit(None).cast("string").alias("context"))
    runs = docs.groupBy("package").agg((F.count(F.lit(1)) + 5).alias("expected")).select("package", "expected", F.lit("2026-01-01T00:00:00.000Z").alias("startedAt"), F.struct(F.lit(3).alias("emails")).alias("stats"))
    return docs, errors, log, runs


@query(f"""WITH d AS ({DOCUMENTS}), k AS (SELECT d.*, source AS package FROM d JOIN documents ON d.id = 'd' || doc_id),
e AS (SELECT source AS package, count(*) AS failed FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT k.*, n.captured, n.captured + 5 AS expected, coalesce(failed, 0) AS failed, '2026-01-02T03:04:05.000Z' AS "exportedAt", row_number() OVER (PARTITION BY k.package ORDER BY k.id) - 1 AS place
FROM k JOIN (SELECT package, count(*) AS captured FROM k GROUP BY 1) n ON n.package IS NOT DISTINCT FROM k.package LEFT JOIN e ON e.package = k.package""")
def metadata_json(spark, d):
    """The index of each source's package, read back from its JSON."""
    docs, errors, _, runs = run_tables(spark, d)
    rows = M.read_lines(M.metadata_lines(docs, errors, runs, by="package", order="id", now=F.lit(NOW).cast("timestamp")))
    return rows.select(*(F.col(f"d.{c}").alias(c) for c in M.INDEX), "package", "totals.captured", "totals.expected", "totals.failed", "exportedAt", "place")


@query("""SELECT source AS package, name, octet_length(encode(data)) AS bytes, sha256(data) AS sha256 FROM (SELECT source, 'docs/d' || doc_id || '.html' AS name, text AS data FROM documents)""")
def zip_manifest(spark, d):
    """Packages of the documents of each source, cut by size, read back entry by entry."""
    docs = read_table(spark, d, "documents").select(F.col("source").alias("package"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("html"), F.lit(None).cast("string").alias("attachmentBase64"))
    entries = K.shard(docs, limit=1 << 22).select("package", M.html_path(F.col("id")).alias("name"), F.col("html").cast("binary").alias("data"))
    return read_packages(zip_packages(entries)).select(F.regexp_replace("package", r"-\d{4}$", "").alias("package"), "name", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


# What the text of a package has to say, written out.
ABOUT = """Corpus exportado

Contenido:
  metadata.json  índice de la corrida (schema v1.0)
  log.txt        log de operación
  docs/          un HTML por registro y, si lo hay, su PDF

Anonimización: activada (nivel básico).
  Se sustituyeron nombre del paciente, cédula, teléfono y correo electrónico en los HTML;
  en los PDF adjuntos se cubrió una banda del cabezal, sin borrar el texto que hay debajo.

Generado: 2026-01-02T03:04:05.000Z
"""


@query(f"""WITH k AS (SELECT 'd' || doc_id AS id, doc_id, source AS package, text FROM documents),
lines AS (SELECT package, doc_id, strftime(to_timestamp(doc_id + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') || ' ' || CASE WHEN doc_id % 10 = 0 THEN 'ERROR' ELSE 'INFO ' END || ' d' || doc_id AS line, row_number() OVER (PARTITION BY package ORDER BY doc_id DESC) AS n FROM k),
files AS (SELECT package, 'docs/' || id || '.html' AS name, sha256(text) AS sha256 FROM k
  UNION ALL SELECT package, 'docs/' || id || '.pdf', sha256(from_base64('JVBERg==')) FROM k WHERE doc_id % 8 = 0
  UNION ALL SELECT package, 'log.txt', sha256(string_agg(line, chr(10) ORDER BY doc_id) || chr(10)) FROM lines WHERE n <= 2000 GROUP BY package
  UNION ALL SELECT DISTINCT package, 'README.txt', sha256('{ABOUT}') FROM k)
SELECT * FROM files UNION ALL SELECT package, 'metadata.json', sha256(string_agg('docs/' || id || '.html', ' ' ORDER BY id) || ' [PACIENTE] [CI] [TEL_N] [EMAIL_N]') FROM k GROUP BY package""")
def package_files(spark, d):
    """Whole packages of pseudonymised runs, read back; of the index what its manifest lists."""
    docs, errors, log, runs = run_tables(spark, d)
    now = F.lit(NOW).cast("timestamp")
    path = scratch_path(spark, "runs")
    write_packages(K.package_parts(docs, errors, log, runs, now=now, anonymized=True), path)
    read = read_archives(spark, path, cut=K.INDEX_NAME)
    indexes = K.index_digests(read.where(F.col("name") == K.INDEX_NAME)).withColumn("name", F.lit(K.INDEX_NAME))
    return read.where(F.col("name") != K.INDEX_NAME).select("package", "name", F.sha2("data", 256).alias("sha256")).unionByName(indexes)


@query(f"""SELECT source || '-' || lpad(CAST(doc_id % 3 AS VARCHAR), 4, '0') AS package, 'docs/d' || doc_id || '.html' AS name, CAST(strlen(text) AS INTEGER) AS bytes, sha256(text) AS sha256 FROM documents""")
def package_archives(spark, d):
    """Three packages of each source's documents, written as archives and read back entry by entry."""
    path = scratch_path(spark, "packages")
    package = F.concat("source", F.lit("-"), F.lpad((F.col("doc_id") % 3).cast("string"), 4, "0"))
    name = M.html_path(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    write_packages(read_table(spark, d, "documents").select(package.alias("package"), name.alias("name"), F.col("text").cast("binary").alias("data")), path)
    return read_archives(spark, path).select("package", "name", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


@query(r"SELECT doc_id, doc_id % 2 = 0 AND NOT regexp_matches(CASE WHEN doc_id % 3 = 0 THEN text || ' [CI]' ELSE text END, '\[[A-Z_0-9]+\]') AS missing FROM documents")
def manifest_check(spark, d):
    """Every second file is declared as pseudonymised, every third holds a token."""
    key = F.col("doc_id")
    files = read_table(spark, d, "documents").select(key.alias("file"), F.when(key % 3 == 0, F.concat("text", F.lit(" [CI]"))).otherwise(F.col("text")).alias("html"), (key % 2 == 0).alias("declared"))
    found = M.check_manifest(files).select(F.col("file").alias("doc_id"), F.lit(True).alias("missing"))
    return files.select(F.col("file").alias("doc_id")).join(found, "doc_id", "left").select("doc_id", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("SELECT doc_id, text, CAST(NULL AS INT) AS toxic FROM documents UNION ALL SELECT doc_id, text, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def append_bag(spark, d):
    """Documents, some of them once more, and labels in one bag."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return K.append_all(docs, docs.where("doc_id % 3 = 0"), read_table(spark, d, "labels").select("doc_id", "toxic"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 20")
def feed_of_users(spark, d):
    return C.feed(read_table(spark, d, "events"), "user_id", "event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def log_levels(spark, d):
    """Events as log lines: errors, views as warnings, others as information; those that are warnings at least."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    return K.log_at_least(read_table(spark, d, "events").withColumn("level", level), "WARN").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed FROM customer")
def export_ids(spark, d):
    ids = read_table(spark, d, "customer").select(F.uuid().alias("u"))
    form = F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("different"), F.count_if(form).alias("well_formed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN to_json({'id': event_id, 'type': event_type}) ELSE to_json({'id': event_id, 'type': event_type, 'props': props}) END AS json FROM events")
def json_compact(spark, d):
    fields = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return read_table(spark, d, "events").select("event_id", F.to_json(fields).alias("json"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS sha256 FROM documents")
def escape_pattern(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.sha256_hex(regex.quote(F.col("text"))).alias("sha256"))


@query("SELECT 'data:application/zip;base64,' || to_base64(encode(text)) AS url FROM documents")
def package_url(spark, d):
    return read_table(spark, d, "documents").select(K.data_url(F.col("text").cast("binary")).alias("url"))


# --- streams -----------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT source AS run_id, sha256(text) AS sha256 FROM documents")
def stream_sha_dedup(spark, d):
    hashed = lambda docs: drop_captured(docs.select(F.col("source").alias("run_id"), T.sha256_hex(F.col("text")).alias("sha256")))
    return run_to_end(spark, table_path(d, "documents"), hashed)


@query(f"""WITH docs AS (SELECT source AS run_id, doc_id AS id, text FROM documents),
places AS (SELECT run_id, id, unnest({_email_keys('text')}) AS key, generate_subscripts({_email_keys('text')}, 1) AS pos FROM docs),
numbered AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY id, pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY id, pos) AS k FROM places) WHERE k = 1),
maps AS (SELECT run_id, map_from_entries(list((key, n))) AS m FROM numbered GROUP BY run_id),
lefts AS (SELECT run_id, id, {_sql_cedula(STUBBED)} AS text FROM docs),
tels AS (SELECT run_id, id, unnest({PHONE_KEYS}) AS key, generate_subscripts({PHONE_KEYS}, 1) AS pos FROM lefts),
tel_numbers AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY id, pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY id, pos) AS k FROM tels) WHERE k = 1),
tel_maps AS (SELECT run_id, map_from_entries(list((key, n))) AS m FROM tel_numbers GROUP BY run_id),
step AS (SELECT docs.run_id, id, {_sql_tokens('text', EMAIL, LOWER, 'maps', 'EMAIL')} AS text FROM docs LEFT JOIN maps ON docs.run_id = maps.run_id),
step2 AS (SELECT run_id, id, {_sql_cedula('text')} AS text FROM step),
done AS (SELECT step2.run_id, id, {_sql_tokens('text', PHONE, DIGITS, 'tel_maps', 'TEL')} AS text FROM step2 LEFT JOIN tel_maps ON step2.run_id = tel_maps.run_id)
SELECT run_id, id AS ordinal, sha256(text) AS sha256, row_number() OVER (PARTITION BY run_id, text ORDER BY id) > 1 AS duplicate, CASE WHEN n = 1 THEN 'doc' ELSE 'doc-' || n END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS n FROM done)""")
def stream_tokens(spark, d):
    change = lambda docs: tokenize_stream(docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("ordinal"), "text", F.lit("doc").alias("base")))
    return run_to_end(spark, table_path(d, "documents"), change).select("run_id", "ordinal", "sha256", "duplicate", "slug")


def _name_step(at: int, name: str) -> str:
    """SQL that replaces a name in the pages from the first one that says it after a label."""
    known = f"id >= (SELECT min(page_id) FROM pages WHERE page_id % 5 = 0 AND page_id % {len(NAMES)} = {at})"
    changed = f"CASE WHEN NOT starts_with(raw, '<') AND {known} THEN regexp_replace(text, '{_fuzzy(name)}', '[PACIENTE]', 'g') ELSE text END"
    return f"named{at} AS (SELECT id, pos, raw, {changed} AS text FROM {f'named{at - 1}' if at else 'step3'})"


_NAME_STEPS = "".join(", " + _name_step(at, name) for at, name in enumerate(_PLAIN))


@query(f"""WITH {NAMED_PAGES}, {PAGE_STEPS}{_NAME_STEPS}
SELECT id AS page_id, sha256(string_agg(text, '' ORDER BY pos)) AS sha256 FROM named{len(NAMES) - 1} GROUP BY id""")
def stream_pages(spark, d):
    """Pages as one run, every fifth with a name after a label, of which every second stands in a later page too: the cumulative scope."""
    change = lambda pages: tokenize_stream(named_pages(pages).select(F.lit("run").alias("run_id"), F.col("page_id").alias("ordinal"), F.col("html").alias("text"), F.lit("page").alias("base")), markup=True)
    return run_to_end(spark, table_path(d, "pages"), change).select(F.col("ordinal").alias("page_id"), "sha256")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def controlled_run(spark, d):
    """A run that is started, paused, resumed and read to its end: every document once."""
    run = Run(spark, table_path(d, "documents"), lambda docs: docs.select("doc_id", T.sha256_hex(F.col("text")).alias("sha256")), every=0.05)
    run.start()
    run.pause()
    run.resume()
    if run.poll() != "completed":
        raise RuntimeError("the run ended as " + run.state)
    return run.output()


@query("""WITH said AS (SELECT * FROM (VALUES (0, 'start', 'running'), (1, 'pause', 'paused'), (2, 'resume', 'running'), (3, 'poll', 'completed')) v(number, command, state))
SELECT CAST(number AS BIGINT) AS number, command, state, CASE WHEN number = 3 THEN (SELECT count(*) FROM documents) END AS processed FROM said""")
def run_journal(spark, d):
    """The commands of a run that one object pauses after its first batch and another resumes, and the rows that its journal counts at the end."""
    change = lambda docs: docs.select("doc_id", T.sha256_hex(F.col("text")).alias("sha256"))
    path = scratch_path(spark, "parts")
    read_table(spark, d, "documents").select("doc_id", "text").repartition(6, "doc_id").write.parquet(path)
    first = Run(spark, path, change, every=0.05)
    first.start()
    while not first.progress()["batches"]:
        time.sleep(0.05)
    first.pause()
    second = Run.attach(spark, path, change, first.root, every=0.05)
    second.resume()
    second.poll()
    counted = second.journal.batches(spark).agg(F.sum("rows").alias("processed"))
    rows = second.journal.commands(spark).crossJoin(counted)  # one row
    return rows.select("number", "command", "state", F.when(F.col("state") == "completed", F.col("processed")).alias("processed"))
