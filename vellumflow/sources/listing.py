"""Listings as HTML pages: rows of records, by the anchors that open them."""

from __future__ import annotations

import bisect
import operator
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeline
from ..functions.regex import trim
from .paged import ListingPages

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div tr li td th h1 h2 h3 h4 h5 h6 ul ol table section article br".split())
_GRID = re.compile(r"(CONTENTGRID_|RIGTH_|TABLEACCION_)")


class _Node:
    """An element: its place among all elements and in the text, each as an interval, and the rows that it stands in or is."""

    __slots__ = ("attributes", "begin", "end", "last", "number", "parent", "rows", "tag", "tree")

    def __init__(self, tree: _Tree, tag: str, attributes: dict[str, str], parent: _Node | None):
        self.tree, self.tag, self.attributes, self.parent = tree, tag, attributes, parent
        self.number = self.last = len(tree.nodes) if parent else -1
        self.begin, self.end = len(tree.pieces), None
        near = parent.rows if parent else (None, None, None)
        # The nearest table row, marked row and grid container.
        own = (tag == "tr", bool({"data-gx-row", "data-gx-evtrow"} & attributes.keys()), tag == "div" and bool(_GRID.match(attributes.get("id", ""))))
        self.rows = tuple(self if is_row else above for is_row, above in zip(own, near, strict=True))

    def close(self) -> None:
        self.end, self.last = len(self.tree.pieces), len(self.tree.nodes) - 1

    def text(self) -> str:
        return " ".join("".join(self.tree.pieces[self.begin : self.end]).split())

    def below(self, nodes: list[_Node]) -> list[_Node]:
        """Those of ``nodes``, which are in document order, that this one holds."""
        return nodes[bisect.bisect_right(nodes, self.number, key=_number) : bisect.bisect_right(nodes, self.last, key=_number)]


_number = operator.attrgetter("number")


class _Tree(HTMLParser):
    """Elements in document order, and the text of all of them once; what one holds are slices of both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.cells, self.pieces, self.raw, self.open = [], [], [], 0, {}
        self.root = self.at = _Node(self, "", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.handle_data(" ")
        node = _Node(self, tag, {k: v or "" for k, v in attrs}, self.at)
        self.nodes.append(node)
        if tag in ("td", "span", "div"):
            self.cells.append(node)
        if tag in _VOID:
            node.end = node.begin
        else:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1
            self.raw += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while True:
                node, self.at = self.at, self.at.parent
                node.close()
                self.open[node.tag] -= 1
                if node.tag == tag:
                    break
            self.raw -= tag in ("script", "style")
        if tag in _BLOCK:
            self.handle_data(" ")

    def finish(self) -> None:
        self.close()
        while self.at is not None:
            self.at.close()
            self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.pieces.append(data)


def _opens_record(node: _Node, route: str) -> bool:
    a = node.attributes
    return node.tag == "a" and (
        a.get("data-gx-evt") == "5" or route in a.get("href", "").lower() or route in a.get("onclick", "").lower() or ("gx.evt" in a.get("onclick", "").lower() and "data-gx-evtrow" in a)
    )


def _row_of(anchor: _Node) -> _Node | None:
    """The nearest table row, else the nearest marked row, else the nearest grid container."""
    return next((row for row in anchor.parent.rows if row is not None), None)


def _is_row(node: _Node) -> bool:
    a = node.attributes
    return node.tag == "tr" and ({"data-gx-evtrow", "data-gx-row", "onclick"} & a.keys() or a.get("role") == "row" or node.parent.tag == "tbody")


def _anchor_of_row(node: _Node, route: str) -> bool:
    a = node.attributes
    return node.tag == "a" and ("onclick" in a or route in a.get("href", "").lower() or "data-gx-evt" in a or "data-gx-evtrow" in a)


def read_rows(html: str | None, route: str) -> Iterator[tuple[int, str, str, list[str], bool]]:
    """(place, href, row text, cells, found by a row) of what may be records; rows only where no anchor opens one."""
    tree = _Tree()
    tree.feed(html or "")
    tree.finish()

    def out(anchors: list[_Node], fallback: bool) -> Iterator[tuple[int, str, str, list[str], bool]]:
        for place, a in enumerate(anchors):
            row = _row_of(a)
            if row is not None and (text := row.text()):
                yield place, a.attributes.get("href", ""), text, [n.text() for n in row.below(tree.cells)], fallback

    yield from out([n for n in tree.nodes if _opens_record(n, route)], False)
    anchors = [n for n in tree.nodes if _anchor_of_row(n, route)]
    firsts = ([*r.below(anchors)[:1]] for r in tree.nodes if _is_row(r))
    yield from out([a for f in firsts for a in f], True)


#: Rows, and characters of rows and cells, that a task gives at a time.
ROWS_OUT, CHARS_OUT = 1024, 1 << 20
_RAW = pa.schema([("page", pa.int64()), ("place", pa.int32()), ("href", pa.string()), ("row", pa.string()), ("cells", pa.list_(pa.string())), ("fallback", pa.bool_())])


def _read_pages(route: str):
    """Reads (page, html); gives rows in small batches, as those of a batch of pages take many times the memory of their pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            for page, html in zip(batch.column("page"), batch.column("html"), strict=True):
                number = page.as_py()
                for place, href, row, cells, fallback in read_rows(html.as_py(), route):
                    held.append({"page": number, "place": place, "href": href, "row": row, "cells": cells, "fallback": fallback})
                    chars += len(row) + sum(map(len, cells))
                    if len(held) >= ROWS_OUT or chars >= CHARS_OUT:
                        yield pa.RecordBatch.from_pylist(held, _RAW)
                        held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _RAW)

    return read


def list_records(pages: DataFrame, *, page: str = "page", html: str = "html", route: str = "visualizar") -> DataFrame:
    """Records of listing pages: page, place, id, categoria, fecha, prestador, profesional, descripcion.

    A row counts if it names a category and a date; of rows with one provisional id on a page the first counts. Rows found by
    table structure are used only on pages where no anchor gave a record. A page reads on its own, in one Arrow pass.
    """
    source = pages.select(F.col(page).cast("long").alias("page"), F.col(html).cast("string").alias("html"))
    raw = source.mapInArrow(_read_pages(route), "page long, place int, href string, row string, cells array<string>, fallback boolean")
    category, date = timeline.find_category(F.col("row")), timeline.find_date(F.col("row"))
    rows = raw.withColumn("categoria", category).withColumn("fecha", date).where("categoria is not null and fecha is not null")
    rows = rows.withColumn("descripcion", timeline.pick_description(F.col("cells"), F.col("row"), F.col("categoria")))
    rows = rows.withColumn("id", timeline.provisional_id(F.col("fecha"), F.col("categoria"), F.col("descripcion")))
    rows = rows.withColumn("prestador", timeline.labelled_cell(F.col("cells"), "Prestador", "Institución")).withColumn("profesional", timeline.labelled_cell(F.col("cells"), "Profesional", "Médico"))
    # Per page and id the first row of the preferred kind, then per page that kind only: one aggregate, partial by page.
    firsts = rows.groupBy("page", "id").agg(F.min(F.struct("fallback", "place", "href", "categoria", "fecha", "prestador", "profesional", "descripcion")).alias("r"))
    kind = firsts.groupBy("page").agg(F.min("r.fallback").alias("_kind"))
    return firsts.join(kind, "page").where(F.col("r.fallback") == F.col("_kind")).select("page", "r.place", "r.href", "id", "r.categoria", "r.fecha", "r.prestador", "r.profesional", "r.descripcion")


def scan_pages(spark: SparkSession, path: str, root: str, **options) -> DataFrame:
    """The listing pages at ``path`` as scanned so far: page, file, html, error, attempts.

    They are read as a stream that keeps its place and its rows below ``root``: a later call reads pages after the last one, and one
    after a failure the pages that failed.
    """
    spark.dataSource.register(ListingPages)
    pages = spark.readStream.format("listing_pages").options(**options).load(path)
    query = pages.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(pages.schema).parquet(f"{root}/out")


def read_details(listing: DataFrame, details: DataFrame, *, key: str = "id", html: str = "html", attachment: str = "b64", least: int = 200) -> DataFrame:
    """Listed records with their detail page where it is ready: enough text, or enough of an attachment."""
    ready = (F.length(trim(F.coalesce(html, F.lit("")))) >= least) | (F.length(trim(F.coalesce(attachment, F.lit("")))) >= least)
    return listing.join(details.where(ready), key)
