"""Operators on small tables, and properties."""

import base64
import hashlib
import io
import json
import random
import re
import time
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import html as H
from vellumflow.operators import anonymize as A
from vellumflow.operators import corpus as C
from vellumflow.operators import metadata as M
from vellumflow.operators import package as K
from vellumflow.plans.ranking import number_rows
from vellumflow.sources import archive
from vellumflow.sources.archive import read_packages, zip_packages
from vellumflow.sources.listing import list_records, read_details
from vellumflow.streaming.control import Run

HTML = "<html><p>Paciente: Juan Pérez Prestador: X</p><p>CI 1.234.567-8, tel 099 123 456 y 2487 1234, mail A@e.com, a@E.com, b@e.com. <a href='mailto:a@e.com'>Perez, Juan</a></p><script>a@e.com</script></html>"


def test_anonymize_page(spark):
    docs = spark.createDataFrame([(1, HTML), (2, "<p>b@e.com 099123456 Juan Perez</p>"), (3, None)], "id long, html string")
    result = A.anonymize(docs, order="id", text="html", markup=True)
    got = {r.id: r.html for r in result.docs.collect()}
    assert got[3] is None
    assert got[2] == "<p>[EMAIL_2] [TEL_1] [PACIENTE]</p>"
    assert "[CI]" in got[1] and "[TEL_1]" in got[1] and "[TEL_2]" in got[1] and got[1].count("[EMAIL_1]") == 2
    assert "mailto:a@e.com" in got[1] and "<script>a@e.com</script>" in got[1] and ">[PACIENTE]</a>" in got[1]
    stats = A.anonymizer_stats(result).first()
    assert (stats.telephones, stats.emails, stats.cedulas, stats.patient_names) == (2, 2, 1, 1)


def test_name_scopes_and_seeds(spark):
    docs = spark.createDataFrame([(1, "<p>Ana Gómez y Luis Sosa</p>"), (2, "<p>Paciente: Ana Gómez</p>"), (3, "<p>ANA GOMEZ</p>")], "id long, html string")
    def run(**options):
        return {r.id: r.html for r in A.anonymize(docs, order="id", text="html", markup=True, **options).docs.collect()}

    assert run()[1] == "<p>[PACIENTE] y Luis Sosa</p>"
    later = run(names_scope="cumulative")
    assert later[1] == "<p>Ana Gómez y Luis Sosa</p>" and later[2] == "<p>Paciente: [PACIENTE]</p>" and later[3] == "<p>[PACIENTE]</p>"
    assert run(seed_names=("Sosa, Luis",), names_scope="cumulative")[1] == "<p>Ana Gómez y [PACIENTE]</p>"


def test_batches_with_a_dictionary_are_one_run(spark, tmp_path):
    from vellumflow.operators.dictionary import Dictionary

    rows = [(1, "b@e.com a@e.com 099 123 456"), (2, "Paciente: Ana Gómez; a@e.com"), (3, None), (4, "c@e.com B@e.com 2487 1234 ana gomez"), (5, "Paciente: Luis Sosa; GOMEZ ANA 099123456"), (6, "d@e.com Luis Sosa a@e.com"), (7, "nobody")]
    docs = spark.createDataFrame(rows, "id long, t string")
    options = {"order": "id", "text": "t", "markup": False, "names_scope": "cumulative"}
    whole = A.anonymize(docs, **options)
    want = {r.id: r.t for r in whole.docs.collect()}
    kept, got = Dictionary(str(tmp_path)), {}
    for batch, ids in ((0, (1, 2)), (1, (3, 4, 5)), (1, (3, 4, 5)), (2, (6,)), (3, (7,)), (4, ())):
        part = A.anonymize(docs.where(F.col("id").isin(*ids)), **options, dictionary=kept, batch=batch)
        got |= {r.id: r.t for r in part.docs.collect()}
    assert got == want and want[4] == "[EMAIL_3] [EMAIL_1] [TEL_2] [PACIENTE]" and want[6] == "[EMAIL_4] [PACIENTE] [EMAIL_2]"
    for one, all_ in ((part.emails, whole.emails), (part.phones, whole.phones)):
        assert sorted(map(tuple, one.select("key", "n").collect())) == sorted(map(tuple, all_.select("key", "n").collect()))
    assert sorted((r.name, r.n) for r in part.names.collect()) == [("ana gomez", 1), ("luis sosa", 2)]


def test_long_text_with_a_name(spark):
    """Twenty thousand words: the work grows with the text, not with its square."""
    docs = spark.createDataFrame([(1, "Paciente: Ana Gómez; " + "palabra " * 20_000 + "ana gomez 099 123 456"), (2, None), (3, "")], "id long, t string")
    began = time.time()
    got = {r.id: r.t for r in A.anonymize(docs, order="id", text="t", markup=False).docs.collect()}
    assert time.time() - began < 60
    assert got[1].startswith("Paciente: [PACIENTE]; ") and got[1].endswith("palabra [PACIENTE] [TEL_1]") and got[2] is None and got[3] == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, html string")
    result = A.anonymize(docs, order="id", text="html", markup=True)
    assert result.docs.count() == result.emails.count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab <>/@.é1-\"'=", max_size=40), min_size=1, max_size=8))
def test_segments_lose_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.array_join(H.segments(F.col("t")), "")).collect()] == texts


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["x@e.com", "Y@e.com", "y@E.com", "1.234.567-8", "099 123 456", "<b>", "palabra", "2487 1234"]), min_size=1, max_size=12))
def test_idempotent_and_tags_kept(spark, words):
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text)], "id long, t string")
    once = A.anonymize(docs, order="id", text="t", markup=True).docs
    twice = A.anonymize(once, order="id", text="t", markup=True).docs
    a, b = once.first().t, twice.first().t
    assert a == b and re.findall("<[^>]*>", a) == re.findall("<[^>]*>", text) and "@" not in a


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = number_rows(df, F.col("x")).collect()
    assert len(got) == 1000 and all(r.n == r.x + 1 for r in got)


def greedy_slugs(bases):
    """Each row takes the first name of base, base-2, base-3, ... that no earlier row has."""
    seen, out = set(), []
    for b in bases:
        b = b or "evento"
        names = (b if n == 1 else f"{b}-{n}" for n in range(1, len(bases) + 2))
        out.append(next(x for x in names if x not in seen))
        seen.add(out[-1])
    return out


def test_a_stem_with_many_rows_and_literal_forms(spark):
    rng = random.Random(1)
    bases = ["x"] * 4000 + [f"x-{k}" for k in rng.sample(range(2, 6000), 600)]
    rng.shuffle(bases)
    seen, numbers, want = set(), {}, []
    for b in bases:  # as greedy_slugs, from the last number of the base on
        n = numbers.get(b, 1)
        while (name := b if n == 1 else f"{b}-{n}") in seen:
            n += 1
        numbers[b] = n
        seen.add(name)
        want.append(name)
    df = spark.createDataFrame([*enumerate(bases)], "i int, b string").repartition(5)
    got = {r.i: r.slug for r in C.unique_slugs(df, "b", F.col("i")).collect()}
    assert [got[i] for i in range(len(bases))] == want


@pytest.mark.parametrize("seed", range(4))
def test_unique_slugs(spark, seed):
    rng = random.Random(seed)
    names = ["x", "x", "x", "x-2", "x-3", "x-2-2", "x-5", "y-2", "y", "y", "", None, "evento-2", "z-02", "x-2-3"]
    bases = ["x", "x", "x-2", "x", "", None, "x-2"] if seed == 0 else [rng.choice(names) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(bases)], "i int, b string").repartition(5)
    got = {r.i: r.slug for r in C.unique_slugs(df, "b", F.col("i")).collect()}
    assert [got[i] for i in range(len(bases))] == greedy_slugs(bases)


def test_hash_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, s string")
    assert sorted(r.i for r in C.keep_first_by_hash(df, "s", "i").collect()) == [1, 3]
    assert [tuple(r) for r in C.duplicate_groups(df, "s").collect()] == [("a", 2)]
    assert [r.i for r in C.not_yet_captured(df, df.where("i = 1"), "s").collect()] == [3]


def test_totals_and_log(spark):
    docs, errors = spark.range(2), spark.range(2)
    assert tuple(C.totals(10, docs, errors).first()) == (10, 2, 2, 6)
    assert C.totals(4, docs, errors).first().missing is None
    empty = spark.createDataFrame([], "n int, line string")
    assert C.log_text(empty, "line", "n").first().log == "\n"


def test_metadata_leaves_out_what_is_absent(spark):
    docs = spark.createDataFrame(
        [("a", "Vacunas", "2026-01-01", None, None, "d", "/v", "/c", "t", "s", None, None, None), ("b", "Otros", "2026-01-02", "p", "q", None, "/v", "/c", "t", "s", "JVBE", "application/pdf", "h")],
        "id string, categoria string, fecha string, prestador string, profesional string, descripcion string, visualizarUrl string, captureUrl string, capturedAt string, sha256 string, attachmentBase64 string, attachmentMime string, attachmentSha256 string",
    )
    kinds = "meta struct<categoria: string, fecha: string, descripcion: string>, url string, message string, occurredAt string"
    errors = spark.createDataFrame([], kinds)
    at = F.lit("2026-04-20 10:30:00").cast("timestamp")
    text = M.metadata(docs, errors, order="id", expected=10, started_at=at, now=at, export_id=F.lit("e"), patient="P").first().json
    import json as j

    got = j.loads(text)
    assert got["totals"] == {"expected": 10, "captured": 2, "failed": 0} and "anonymized" not in got and got["patient"] == {"displayName": "P"}
    assert "prestador" not in got["documents"][0] and got["documents"][1]["attachmentFile"] == "docs/b.pdf" and "null" not in text
    bad = spark.createDataFrame([((None, None, "b"), None, "m2", "t2"), (("Otros", None, None), "/u", "m1", "t1"), ((None, None, "a"), None, "m2", "t2")], kinds)
    again = [M.metadata(docs, e, order="id", expected=10, started_at=at, now=at, export_id=F.lit("e"), redact=True, indent=False).first().json for e in (bad, bad.repartition(3))]
    assert again[0] == again[1] and "\n" not in again[0] and "descripcion" not in j.loads(again[0])["documents"][0]
    assert [e["message"] for e in j.loads(again[0])["errors"]] == ["m1", "m2", "m2"]
    assert got["exportedAt"] == "2026-04-20T10:30:00.000Z"
    assert "activada" in M.readme("x", anonymized=True) and "desactivada" in M.readme("x", anonymized=False)
    with pytest.raises(ValueError):
        M.require_exportable(0, "completed")
    with pytest.raises(ValueError):
        M.require_exportable(3, "cancelled")
    M.require_exportable(3, "cancelled", partial=True)


def test_zip_round_trip(spark):
    rows = [("p", "docs/a.html", b"<p>1"), ("p", "log.txt", b"\n"), ("q", "docs/a.html", b"2")]
    packed = zip_packages(spark.createDataFrame(rows, "package string, name string, data binary"))
    assert sorted((r.package, r.name, bytes(r.data)) for r in read_packages(packed).collect()) == sorted(rows)
    data = {r.package: bytes(r.data) for r in packed.collect()}
    assert {i.compress_type for i in zipfile.ZipFile(io.BytesIO(data["p"])).infolist()} == {zipfile.ZIP_DEFLATED}
    assert {r.package: bytes(r.data) for r in packed.collect()} == data


LISTING = """<table><tbody>
<tr><td>01/02/2024</td><td>Laboratorio</td><td>Hemograma completo</td><td>Prestador: Uno</td><td><a data-gx-evt="5" href="visualizar?1">ver</a></td></tr>
<tr><td>01/02/2024</td><td>Laboratorio</td><td>Hemograma completo</td><td>Prestador: Dos</td><td><a data-gx-evt="5" href="visualizar?2">ver</a></td></tr>
<tr><td>sin fecha</td><td>Vacunas</td><td><a data-gx-evt="5">ver</a></td></tr></tbody></table>
<div id="CONTENTGRID_3"><span>03/02/2024</span> <span>Vacunas</span> <span>Médico: Dra. X</span> <a href="visualizar?3">ver</a></div>"""
FALLBACK = '<table><tbody><tr><td>05/02/2024 Otros</td><td>Nota breve del caso</td><td><a onclick="go()">ver</a></td></tr></tbody></table>'


def test_listing(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, FALLBACK), (3, None), (4, "<p>nada</p>")], "page long, html string")
    got = sorted(tuple(r) for r in list_records(pages).select("page", "id", "href", "prestador", "profesional", "descripcion").collect())
    assert got == [
        (1, "2024-02-01_laboratorio_hemograma-completo", "visualizar?1", "Uno", None, "Hemograma completo"),
        (1, "2024-02-03_vacunas_medico-dra-x", "visualizar?3", None, "Dra. X", "Médico: Dra. X"),
        (2, "2024-02-05_otros_nota-breve-del-caso", "", None, None, "Nota breve del caso"),
    ]
    details = spark.createDataFrame([(got[0][1], "x" * 200, None), (got[1][1], "x", " " * 300)], "id string, html string, b64 string")
    assert [r.id for r in read_details(list_records(pages), details).collect()] == [got[0][1]]


def test_rows_of_many_pages_are_given_in_small_batches():
    import pyarrow as pa

    from vellumflow.sources import listing

    pages = pa.RecordBatch.from_pydict({"page": list(range(3000)), "html": [LISTING] * 3000})
    sizes = [(b.num_rows, b.nbytes) for b in listing._read_pages("visualizar")(iter([pages]))]
    assert sum(n for n, _ in sizes) == 3000 * 7 and max(n for n, _ in sizes) <= listing.ROWS_OUT and max(b for _, b in sizes) < 2 << 20


def test_rows_of_deep_and_broken_pages():
    import tracemalloc

    from vellumflow.sources.listing import read_rows

    record = "<table><tbody><tr id=r><td>01/02/2024</td><td><span>Consulta</span></td><td><a href='visualizar?1'>ver</a></td></tr></tbody></table>"
    want = [(0, "visualizar?1", "01/02/2024 Consulta ver", ["01/02/2024", "Consulta", "Consulta", "ver"])]
    sizes = []
    for depth in (10_000, 20_000):
        page = "<div>" * depth + "text " + record + "</p></b>" * depth + "<a>x</a>" * depth
        tracemalloc.start()
        got = list(read_rows(page, "visualizar"))
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert [r[:4] for r in got if not r[4]] == want == [r[:4] for r in got if r[4]]
    assert sizes[1] < 2.5 * sizes[0] < 100 << 20
    marked = "<div data-gx-row=1><div id=CONTENTGRID_1>a<script>no</script><br>b<a data-gx-evt=5>go</a></div> c</div>"
    assert [(r[2], r[3]) for r in read_rows(marked, "visualizar")] == [("a bgo c", ["a bgo"])]
    assert [r[2] for r in read_rows("<div id=GRIDX></div><div id=RIGTH_1>t<a onclick='visualizar(1)'>x", "visualizar")] == ["tx"]
    assert list(read_rows(None, "visualizar")) == [] and list(read_rows("</tr></div><a href=visualizar>x</a>", "visualizar")) == []


def test_paged_source(spark, tmp_path):
    from vellumflow.sources.paged import ListingPages

    for n in (1, 2):
        (tmp_path / f"{n}.html").write_text(f"<p>{n}</p>")
    spark.dataSource.register(ListingPages)
    df = spark.read.format("listing_pages").option("paths", "\n".join(str(tmp_path / f"{n}.html") for n in (1, 2))).load()
    assert sorted(tuple(r) for r in df.collect()) == [(1, "1.html", "<p>1</p>", None, 1), (2, "2.html", "<p>2</p>", None, 1)]
    for n in (1, 2, 5, 12):
        (tmp_path / "all" / f"listing-{n}.html").parent.mkdir(exist_ok=True)
        (tmp_path / "all" / f"listing-{n}.html").write_text(f"<p>{n}</p>" if n != 5 else "  ")
    folder = spark.read.format("listing_pages").option("firstWait", 0).option("pages", 13).option("pagesPerTask", 4).load(f"file://{tmp_path}/all")
    got = {r.page: r for r in folder.collect()}
    assert sorted(got) == list(range(1, 14)) and folder.rdd.getNumPartitions() == 4 and got[12].html == "<p>12</p>"
    assert got[5].error.endswith(" 5") and got[5].file == "listing-5.html" and got[5].attempts == 3 and got[13].error.endswith(" 13") and got[13].file is None


def test_paged_stream_goes_on_at_its_page(spark, tmp_path):
    from vellumflow.sources.paged import ListingPages

    folder, root = tmp_path / "pages", str(tmp_path)
    folder.mkdir()
    for n in (1, 2, 3, 4, 6, 7):
        (folder / f"{n}.html").write_text(f"<p>{n}</p>")
    spark.dataSource.register(ListingPages)
    stream = spark.readStream.format("listing_pages").option("pagesPerBatch", 2).option("firstWait", 0.01).option("onMissing", "fail").load(str(folder))

    def begin():
        return stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(processingTime="10 milliseconds").start()

    query = begin()
    with pytest.raises(Exception, match="página 5"):
        query.processAllAvailable()
    assert sorted(r.page for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3, 4]
    (folder / "5.html").write_text("<p>5</p>")
    for more in ((), (8, 9, 10)):  # a query that goes on after a failed batch, and one that goes on after a done one
        for n in more:
            (folder / f"{n}.html").write_text(f"<p>{n}</p>")
        query = begin()
        query.processAllAvailable()
        query.stop()
        assert sorted((r.page, r.html) for r in spark.read.parquet(f"{root}/out").collect()) == [(n, f"<p>{n}</p>") for n in range(1, 8 + len(more))]


def test_packages_as_files(spark, tmp_path):
    from vellumflow.sources.sinks import read_archives, write_files, write_packages

    rows = [(f"p{i % 3}", f"docs/{i}.html", b"x" * 3000 + str(i).encode()) for i in range(60)] + [("p0", "empty", None)]
    entries = spark.createDataFrame([(*r, 1) for r in rows], "package string, name string, data binary, other int").repartition(4)
    for part in ("a", "b"):
        write_packages(entries, f"file://{tmp_path}/{part}")
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["_SUCCESS", "p0.zip", "p1.zip", "p2.zip"]
    for n in range(3):
        data = (tmp_path / "a" / f"p{n}.zip").read_bytes()
        assert data == (tmp_path / "b" / f"p{n}.zip").read_bytes() and zipfile.ZipFile(io.BytesIO(data)).testzip() is None
        assert zipfile.ZipFile(io.BytesIO(data)).namelist() == sorted(name for p, name, _ in rows if p == f"p{n}")
    whole = sorted((p, name, data or b"") for p, name, data in rows)
    assert sorted((r.package, r.name, bytes(r.data)) for r in read_archives(spark, str(tmp_path / "a")).collect()) == whole
    split = spark.read.format("zip_packages").option("splitBytes", 300).load(str(tmp_path / "a"))
    assert split.rdd.getNumPartitions() > 3 and sorted((r.package, r.name, bytes(r.data)) for r in split.collect()) == whole
    with pytest.raises(Exception, match="no more"):
        write_packages(entries.withColumn("data", F.when(F.col("name") == "docs/59.html", F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("data"))), str(tmp_path / "c"))
    assert not (tmp_path / "c").exists() or not list((tmp_path / "c").iterdir())
    write_files(entries.where("package = 'p1'"), str(tmp_path / "files"))
    assert (tmp_path / "files" / "docs" / "1.html").read_bytes() == rows[1][2] and len(list((tmp_path / "files" / "docs").iterdir())) == 20


def test_a_large_package_is_streamed(spark, tmp_path):
    """300 MB into one archive by a writer that is given one entry at a time."""
    import resource

    import pyarrow as pa

    from vellumflow.sources.sinks import ZipSource

    sink = ZipSource({"path": str(tmp_path)}).writer(None, False)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    block = bytes(5 << 20)
    done = sink.write(pa.RecordBatch.from_pylist([{"package": "p", "name": f"{i:03d}", "data": block}]) for i in range(60))
    sink.commit([done])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10  # kilobytes
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert len(z.infolist()) == 60 and sum(i.file_size for i in z.infolist()) == 300 << 20


def small_pdf():
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /MediaBox [0 0 595 842] /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"


def test_anonymize_and_pack_a_run(spark):
    good, odd = (base64.b64encode(x).decode() for x in (small_pdf(), b"hola"))
    kinds = "package string, n int, id string, html string, categoria string, fecha string, prestador string, profesional string, descripcion string, visualizarUrl string, captureUrl string, capturedAt string, sha256 string, attachmentBase64 string, attachmentMime string, attachmentSha256 string"
    rest = ("Otros", "2026-01-02", None, None, None, "/v", "/c", "t", "old")
    docs = spark.createDataFrame([("p", 1, "a", "<p>Paciente: Ana Gómez, a@e.com</p>", *rest, good, "application/pdf", "x"), ("p", 2, "b", "<p>ana gomez b@e.com</p>", *rest, odd, "application/pdf", "y"), ("q", 3, "c", "<p>A@E.com</p>", *rest, None, None, None)], kinds)
    run = K.anonymize_captured(docs, order="n")
    got = {r.id: r for r in run.docs.collect()}
    assert got["a"].html == "<p>Paciente: [PACIENTE], [EMAIL_1]</p>" and got["b"].html == "<p>[PACIENTE] [EMAIL_2]</p>" and got["c"].html == "<p>[EMAIL_1]</p>"
    assert all(r.sha256 == hashlib.sha256(r.html.encode()).hexdigest() for r in got.values())
    new = base64.b64decode(got["a"].attachmentBase64)
    assert new.startswith(small_pdf()) and len(new) > len(small_pdf()) and got["a"].attachmentSha256 == hashlib.sha256(new).hexdigest()
    assert got["b"].attachmentBase64 == odd and got["b"].attachmentSha256 == "y" and got["c"].attachmentBase64 is None
    assert {(r.id, r.level) for r in run.log.collect()} == {("a", "INFO"), ("b", "WARN")} and run.stats.first().emails == 2
    now = F.lit("2026-04-20 10:30:00").cast("timestamp")
    errors = spark.createDataFrame([], "package string, meta struct<categoria: string, fecha: string, descripcion: string>, url string, message string, occurredAt string")
    log = spark.createDataFrame([], "package string, at timestamp, level string, message string, context string")
    runs = spark.createDataFrame([("p", 5, "s", (1,)), ("q", 1, "s", (0,))], "package string, expected long, startedAt string, stats struct<emails: int>")
    packed = K.build_packages(run.docs, errors, log, runs, now=now, anonymized=True, owner="Ana Gómez")
    files = {(r.package, r.name): bytes(r.data) for r in read_packages(packed).collect()}
    assert {n for p, n in files if p == "p"} == {"metadata.json", "log.txt", "README.txt", "docs/a.html", "docs/a.pdf", "docs/b.html", "docs/b.pdf"}
    index = json.loads(files["p", "metadata.json"])
    assert index["totals"] == {"expected": 5, "captured": 2, "failed": 0} and index["anonymization"]["tokens"] == ["[PACIENTE]", "[CI]", "[TEL_N]", "[EMAIL_N]"]
    assert index["anonymization"]["files"] == ["docs/a.html", "docs/b.html"] and files["p", "log.txt"] == b"\n" and files["p", "docs/a.pdf"] == new
    assert {r.filename for r in packed.collect()} == {"export_ana-gomez_2026-04-20_1030.zip"}


def test_an_index_of_any_size_goes_by_lines(spark, tmp_path):
    """An index of 30 MB: written, read and hashed with no row of more than a document or a few lines."""
    from vellumflow.sources.sinks import read_archives, write_packages

    none = F.lit(None).cast("string")
    empty = {c: none for c in "prestador profesional visualizarUrl captureUrl capturedAt sha256 attachmentBase64 attachmentMime attachmentSha256".split()}
    docs = spark.range(300).select(F.lit("p").alias("package"), F.concat(F.lit('d"'), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.lit("x").alias("html"), F.lit("Otros").alias("categoria"), F.lit("2026-01-02").alias("fecha"), F.repeat(F.lit("á\n"), 33_000).alias("descripcion")).withColumns(empty)
    errors = spark.createDataFrame([("p", (None, None, None), None, m, "t") for m in ("m2", "m1")], "package string, meta struct<categoria: string, fecha: string, descripcion: string>, url string, message string, occurredAt string")
    log = spark.createDataFrame([], "package string, at timestamp, level string, message string, context string")
    runs = spark.createDataFrame([("p", 305, "s", (1,))], "package string, expected long, startedAt string, stats struct<emails: int>")
    now = F.lit("2026-04-20 10:30:00").cast("timestamp")
    parts = K.package_parts(docs, errors, log, runs, now=now, anonymized=True)
    assert parts.agg(F.max(F.octet_length("data"))).first()[0] < 300_000
    write_packages(parts, str(tmp_path / "zip"))
    whole = {r.name: bytes(r.data) for r in read_archives(spark, str(tmp_path / "zip")).collect()}
    index = json.loads(whole["metadata.json"])
    assert len(whole) == 303 and len(whole["metadata.json"]) > 30_000_000 and index["totals"] == {"expected": 305, "captured": 300, "failed": 2}
    files = [f'docs/d"{i:04d}.html' for i in range(300)]
    assert index["anonymization"]["files"] == files == [d["file"] for d in index["documents"]] and [e["message"] for e in index["errors"]] == ["m1", "m2"]
    read = read_archives(spark, str(tmp_path / "zip"), cut="metadata.json").where("name = 'metadata.json'")
    cut = [bytes(r.data) for r in read.orderBy("part").collect()]
    assert len(cut) > 5 and b"".join(cut) == whole["metadata.json"] and all(c.endswith(b"\n") for c in cut)
    said = " ".join([*files, *index["anonymization"]["tokens"]])
    assert K.index_digests(read).first().sha256 == hashlib.sha256(said.encode()).hexdigest()
    again = M.read_lines(M.metadata_lines(docs, errors, runs, by="package", order="id", now=now))
    assert [r.file for r in again.orderBy("place").select("d.file").collect()] == files


def test_shards_are_bounded_and_lose_nothing(spark):
    docs = spark.range(400).select(F.lit("p").alias("package"), F.concat(F.lit("d"), "id").alias("id"), F.repeat(F.lit("x"), 1000).alias("html"), F.lit(None).cast("string").alias("attachmentBase64"))
    got = K.shard(docs.union(docs.limit(1).withColumn("package", F.lit("small"))), limit=20_000)
    sizes = {r.package: r["count"] for r in got.groupBy("package").count().collect()}
    assert sizes.pop("small") == 1 and sum(sizes.values()) == 400 and len(sizes) == 20 and max(sizes.values()) < 50


def test_kept_packages(spark, tmp_path):
    packages = spark.createDataFrame([("p", b"1", 1)], archive.SCHEMA)
    root = str(tmp_path / "kept")
    assert archive.package_to_give(archive.restore(spark, root, "zip"), lambda: packages).count() == 1
    archive.keep(packages, root, "zip")
    assert archive.package_to_give(archive.restore(spark, root, "zip"), lambda: packages.limit(0)).count() == 1
    archive.clear(spark, root, "zip")
    assert archive.restore(spark, root, "zip").count() == 0


def test_run_control(spark, tmp_path):
    for n in range(4):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    spark.read.parquet(*(str(tmp_path / "in" / f"{n}") for n in range(4))).repartition(4).write.parquet(str(tmp_path / "flat"))
    run = Run(spark, str(tmp_path / "flat"), lambda df: df, every=0.01)
    with pytest.raises(ValueError):
        run.pause()
    run.start()
    run.pause()
    done = run.progress()["processed"]
    assert run.progress()["state"] == "paused" and run.poll() == "paused"
    run.resume()
    assert run.poll() == "completed" and sorted(r.id for r in run.output().collect()) == list(range(40))
    assert run.progress()["processed"] == 40 >= done and run.progress()["batches"] == 4
    run.start()
    run.cancel()
    assert run.poll() == "cancelled"
    with pytest.raises(ValueError):
        run.resume()


def test_another_driver_resumes_a_run(spark, tmp_path):
    """More batches than Spark's own list of them keeps, over a pause, another object, and a driver that goes away."""
    spark.range(130).repartitionByRange(130, "id").write.parquet(str(tmp_path / "in"))
    change = lambda df: df
    first = Run(spark, str(tmp_path / "in"), change, every=0.001)
    first.start()
    while first.progress()["batches"] < 3:
        time.sleep(0.05)
    first.pause()
    done = first.progress()
    assert done["state"] == "paused" and 3 <= done["batches"] == done["processed"] < 130 and first.output().count() == done["processed"]
    second = Run.attach(spark, str(tmp_path / "in"), change, first.root, every=0.001)
    assert second.state == "paused" and second.progress() == done
    second.resume()
    while second.progress()["batches"] < done["batches"] + 3:
        time.sleep(0.05)
    second.query.stop()  # its driver goes away without a word
    third = Run.attach(spark, str(tmp_path / "in"), change, first.root, every=0.001)
    assert third.state == "paused"
    third.resume()
    assert third.poll() == "completed"
    assert third.progress()["processed"] == 130 == third.progress()["batches"] and sorted(r.id for r in third.output().collect()) == list(range(130))
    assert [r.command for r in third.journal.commands(spark).orderBy("number").collect()] == ["start", "pause", "resume", "pause", "resume", "poll"]
    with pytest.raises(ValueError):
        Run.attach(spark, str(tmp_path / "in"), change, str(tmp_path / "none"))


def test_run_tries_again_and_gives_up(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    waits = []
    fail = F.raise_error(F.lit("no"))
    run = Run(spark, str(tmp_path / "in"), lambda df: df.withColumn("x", F.when(F.col("id") >= 0, fail).cast("string")), every=0.01, wait=waits.append)
    run.start()
    assert run.poll() == "error" and waits == [1.0, 2.0] and run.progress()["processed"] == 0


def test_stream_tokens(spark, tmp_path):
    from vellumflow.streaming.tokens import drop_captured, tokenize_stream

    kinds = "run_id string, ordinal long, text string, base string"
    for n, rows in enumerate(([("r", 1, "a@e.com b@e.com", "x"), ("r", 2, "A@e.com", "x")], [("r", 3, "b@e.com c@e.com", "x"), ("r", 4, "A@e.com", ""), ("s", 1, "b@e.com", "x")])):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = tokenize_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.run_id, r.ordinal): (r.text, r.slug, r.duplicate) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["r", 1] == ("[EMAIL_1] [EMAIL_2]", "x", False) and got["r", 2] == ("[EMAIL_1]", "x-2", False)
    assert got["r", 3] == ("[EMAIL_2] [EMAIL_3]", "x-3", False) and got["r", 4] == ("[EMAIL_1]", "evento", True) and got["s", 1] == ("[EMAIL_1]", "x", False)
    texts = [("r", 1, "CI 1.234.567-8 tel 099 123 456, 2487 1234 Ana Gómez"), ("r", 2, "Paciente: Ana Gómez; 099-123-456"), ("r", 3, "GOMEZ, Ana y 2024-2025 +598 99 123 456")]
    spark.createDataFrame([(*t, "x") for t in texts], kinds).coalesce(1).write.parquet(str(tmp_path / "names"))
    from vellumflow.streaming.run import run_to_end

    streamed = {r.ordinal: r.text for r in run_to_end(spark, str(tmp_path / "names"), tokenize_stream).collect()}
    docs = spark.createDataFrame(texts, "run_id string, ordinal long, text string")
    batch = {r.ordinal: r.text for r in A.anonymize(docs, order="ordinal", text="text", markup=False, names_scope="cumulative").docs.collect()}
    assert streamed == batch and streamed[1].endswith("Ana Gómez") and streamed[2] == "Paciente: [PACIENTE]; [TEL_1]" and streamed[3].startswith("[PACIENTE] y [TEL_3]")
    assert drop_captured(spark.createDataFrame([("r", "h"), ("r", "h")], "run_id string, sha256 string")).count() == 1


def test_stream_of_one_run_is_shared_by_tasks(spark, tmp_path):
    """Texts of one run are rewritten by several tasks, with numbers, slugs and repeats in the order of the run over two batches."""
    from vellumflow.streaming.run import run_to_end
    from vellumflow.streaming.tokens import tokenize_stream

    bases = ["x", "x", "x-2", "x-2", "x", "x-5", "x", "x-02"]
    rows = [("r", n, f"{'Paciente: Ana Gómez; ' if n == 25 else ''}u{n % 3}@e.com 099 123 {n % 2:03d} CI 1.234.567-8 gomez, ana {'y' * (n % 3)}", bases[n % 8]) for n in range(60)]
    docs = spark.createDataFrame(rows, "run_id string, ordinal long, text string, base string")
    for part in (docs.where("ordinal < 30"), docs.where("ordinal >= 30")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = run_to_end(spark, str(tmp_path / "in"), tokenize_stream, files_per_batch=1).select("*", F.input_file_name().alias("file")).orderBy("ordinal").collect()
    batch = {r.ordinal: r.text for r in A.anonymize(docs.select("ordinal", "text"), order="ordinal", text="text", markup=False, names_scope="cumulative").docs.collect()}
    assert {r.ordinal: r.text for r in out} == batch and batch[24].endswith("gomez, ana ") and "[PACIENTE]" in batch[26]
    slugs, texts = set(), set()
    for r, (_, _, _, base) in zip(out, rows, strict=True):
        slug = next(s for s in (base if n == 1 else f"{base}-{n}" for n in range(1, 99)) if s not in slugs)
        assert r.slug == slug and r.duplicate == (r.text in texts)
        slugs.add(slug)
        texts.add(r.text)
    assert len(texts) < 60 and len({r.file for r in out if r.ordinal < 30}) > 1 < len({r.file for r in out if r.ordinal >= 30})


def test_streams_give_python_small_batches(spark, tmp_path):
    from vellumflow.streaming.run import run_to_end

    spark.range(2500).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    out = run_to_end(spark, str(tmp_path / "in"), lambda df: df.mapInPandas(lambda frames: (f.head(1).assign(id=len(f)) for f in frames), df.schema)).collect()
    assert sum(r.id for r in out) == 2500 and max(r.id for r in out) <= 1000 and spark.conf.get(rows) == before


def test_state_of_a_run_is_read_and_written_through_memory(monkeypatch):
    """A thousand documents of one run take few calls of the state, and with few entries in memory give the same."""
    import pandas as pd

    from vellumflow.streaming import tokens

    class State(dict):
        calls = 0

        def getValue(self, key):  # noqa: N802
            State.calls += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            State.calls += 1
            self[key] = value

        def containsKey(self, key):  # noqa: N802
            State.calls += 1
            return key in self

    class Value(list):
        get = lambda self: self[-1] if self else None
        exists, update = list.__len__, list.append

    class Handle:
        getMapState, getValueState = lambda *_: State(), lambda *_: Value()

    def numbered(held):
        monkeypatch.setattr(tokens, "HELD", held)
        run, State.calls = tokens.RunTokens(), 0
        run.init(Handle())
        for start in (0, 500):
            rows = [(n, "page", "t", ["ana gomez"], [f"EMAIL {n % 9}@e.com", "TEL 099123456"], tokens._find(False).func(pd.Series([["Ana Gómez"]]))["keys"][0]) for n in range(start, start + 500)]
            yield from pd.concat(run.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=tokens._ROWS.names)]), None)).values.tolist()

    many = list(numbered(1 << 16))
    assert State.calls < 200 and many[999] == ["r", 999, "t", [1, 1], ["ana gomez"], "page-1000"] and many[8][3] == [9, 1]
    assert list(numbered(2)) == many


def test_rows_of_a_run_are_sorted_on_disk(tmp_path, monkeypatch):
    """80 MB of rows in batches, out of order, with 8 MB of them in memory."""
    import tempfile

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from vellumflow.streaming.tokens import in_order

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    rng = np.random.default_rng(1)
    order = rng.permutation(8000)

    def frames():
        for i in range(0, 8000, 200):
            part = order[i : i + 200]
            yield pd.DataFrame({"base": "x", "ordinal": part, "parts": [[f"{n} ", "y" * 10_000] if n % 7 else None for n in part], "names": [["Ana"] if n % 5 == 0 else [] for n in part], "markup": True})

    before, most = pa.total_allocated_bytes(), 0
    for n, r in enumerate(in_order(frames(), 8 << 20)):
        assert r["ordinal"] == n and r["parts"] == ([f"{n} ", "y" * 10_000] if n % 7 else None) and r["names"] == (["Ana"] if n % 5 == 0 else [])
        most = max(most, pa.total_allocated_bytes() - before)
    assert n == 7999 and most < 40 << 20 and not list(tmp_path.iterdir())


def test_stream_of_pages_is_the_cumulative_scope(spark, tmp_path):
    """Header, segments and names over two batches, as in one batch job."""
    from vellumflow.streaming.run import run_to_end
    from vellumflow.streaming.tokens import tokenize_stream

    header = '<table><tr><td class="td_label">Documento</td><td class="td_header_role_value">1234567</td></tr></table>'
    rows = [(1, "<p title='Ana Gómez'>Ana Gómez a@e.com</p><script>a@e.com</script>"), (2, f"{header}<p>Paciente: Ana Gómez; y <b>GOMEZ, ANA</b> 099 123 456 a@e.com</p>"), (3, "<p>Nombre: Thị Nguyễn; b@e.com 1.234.567-8 Ana<br>Gómez</p>"), (4, "<p>nguyễn  thị y ana gómez, 099123456</p>"), (5, None), (6, "")]
    docs = spark.createDataFrame([("r", i, t, "x") for i, t in rows], "run_id string, ordinal long, text string, base string")
    for part in range(2):
        docs.where(F.col("ordinal").between(part * 3 + 1, part * 3 + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for strict in (False, True):
        streamed = {r.ordinal: r.text for r in run_to_end(spark, str(tmp_path / "in"), lambda d: tokenize_stream(d, markup=True, strict_labels=strict), files_per_batch=1).collect()}
        batch = {r.ordinal: r.text or "" for r in A.anonymize(docs.select("ordinal", "text"), order="ordinal", text="text", markup=True, names_scope="cumulative", strict_labels=strict).docs.collect()}
        assert streamed == batch
    assert streamed[1].startswith("<p title='Ana Gómez'>Ana Gómez [EMAIL_1]") and "[ID]" in streamed[2] and "<b>[PACIENTE]</b>" in streamed[2] and streamed[4] == "<p>[PACIENTE] y [PACIENTE], [TEL_1]</p>"
