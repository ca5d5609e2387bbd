"""A data source of numbered listing pages, for batches and streams.

A page is a file whose name ends in its number. A stream's offset is the number of the last page read, so a query that stops goes on
with the page after it; how many pages make a batch is set by ``pagesPerBatch`` (leave it unset where a stream is to read all that
is there and end). Pages are read by the tasks, with further attempts after growing waits. What is still missing or empty then is a row
with an error, or with ``onMissing=fail`` fails the batch, which is read again when the query goes on.
"""

from __future__ import annotations

import posixpath
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .staged import list_files, open_path

SCHEMA = "page long, file string, html string, error string, attempts int"
#: Pages that a task reads; fixed values: attempts at a page, seconds before the first further one and at most, and what is said.
PAGES_EACH, ATTEMPTS, FIRST_WAIT, MOST_WAIT = 32, 3, 1.0, 16.0
PAGE_MISSED = "No se pudo posicionar la página"


@dataclass
class _Pages(InputPartition):
    """Numbers and, where they were listed, paths."""

    pages: list[tuple[int, str | None]]


class _Pager:
    """What readers of batches and of streams share."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.paths, self.path, self.suffix = [p for p in o.get("paths", "").split("\n") if p], o.get("path"), o.get("suffix", ".html")
        self.expected, self.each, self.per_batch = int(o.get("pages", 0)), int(o.get("pagespertask", PAGES_EACH)), int(o.get("pagesperbatch", 0))
        self.attempts, self.first, self.most = int(o.get("attempts", ATTEMPTS)), float(o.get("firstwait", FIRST_WAIT)), float(o.get("mostwait", MOST_WAIT))
        self.fail = o.get("onmissing", "row") == "fail"

    def listed(self) -> dict[int, str]:
        """Path by page number; a list of paths is numbered from 1."""
        if self.paths:
            return dict(enumerate(self.paths, 1))
        scheme = m[0] if (m := re.match(r"[a-z][a-z0-9+.-]*://(?=[^/])", self.path)) else ""
        found = [(re.search(r"(\d+)\D*$", posixpath.basename(f)), f) for f, _ in list_files(self.path, self.suffix)]
        return {int(n[1]): (scheme + f if scheme and not f.startswith("/") else f) for n, f in found if n}

    def last(self) -> int:
        return max([self.expected, *self.listed()])

    def cut(self, first: int, last: int) -> list[_Pages]:
        listed = self.listed()
        numbers = [(n, listed.get(n)) for n in range(first, last + 1)]
        return [_Pages(numbers[i : i + self.each]) for i in range(0, len(numbers), self.each)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for number, path in partition.pages:
            yield self._page(number, path)

    def _page(self, number: int, path: str | None) -> tuple:
        problem = "missing"
        for n in range(self.attempts):
            if n:
                time.sleep(min(self.most, self.first * 2 ** (n - 1)))
            try:
                path = path or self.listed().get(number)
                if path is not None:
                    system, place = open_path(path)
                    with system.open_input_stream(place, compression=None) as f:
                        html = f.read().decode("utf-8", "replace")
                    if html.strip():
                        return number, posixpath.basename(place), html, None, n + 1
                    problem = "empty"
            except OSError as e:
                problem = str(e)
        if self.fail:
            raise OSError(f"{PAGE_MISSED} {number}: {problem}")
        return number, None if path is None else posixpath.basename(path), None, f"{PAGE_MISSED} {number}", self.attempts


class _Reader(_Pager, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.cut(1, self.last()) or [_Pages([])]


class _StreamReader(_Pager, DataSourceStreamReader):
    done = 0  # Spark names the last offset by a call of ``partitions`` when a query goes on

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(self.last(), self.done)
        return {"page": min(last, self.done + self.per_batch) if self.per_batch else last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.done = end["page"]
        return self.cut(start["page"] + 1, end["page"])


class ListingPages(DataSource):
    """``spark.read`` or ``spark.readStream`` of ``listing_pages``: page, file, html, error, attempts.

    Options: ``path`` of a folder on any file system, or ``paths``, one to a line; ``pages``, how many there should be; ``suffix`` of
    their names; ``pagesPerTask``; ``pagesPerBatch``; ``attempts``, ``firstWait``, ``mostWait``; ``onMissing``.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)
