"""What the rows and footers of a paginated listing say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import EDGE, translate_pattern, trim
from .text import slugify

# The categories, in the order in which they are looked for.
CATEGORIES = (
    "Imagenología",
    "Internación",
    "Laboratorio",
    "Policlínica",
    "Procedimientos médicos",
    "Procedimientos quirúrgicos",
    "Urgencia y emergencia",
    "Vacunas",
    "Teleconsulta",
    "Otros",
)
TOTAL_LINE = translate_pattern(r"Mostrando\s+del\s+(\d+)\s+al\s+(\d+)\s+de\s+(\d+)\s+resultados", ignore_case=True)
SIDEBAR = translate_pattern(r"Todos\s+los\s+registros\s*\((\d+)\)", ignore_case=True)
DATE = f"{EDGE}(\\d{{2}})/(\\d{{2}})/(\\d{{4}}){EDGE}"
PAGE_SIZE = 10


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def total_line(text: Column) -> Column:
    """Struct of from, to and total in a footer line, or null."""
    line = F.struct(*(_number(text, TOTAL_LINE, i + 1).alias(n) for i, n in enumerate(("from", "to", "total"))))
    return F.when(text.rlike(TOTAL_LINE), line)


def sidebar_count(text: Column) -> Column:
    return _number(text, SIDEBAR, 1)


def total_records(footer: Column, sidebar: Column) -> Column:
    return F.coalesce(total_line(footer)["total"], sidebar_count(sidebar))


def pagination(line: Column) -> Column:
    """Page, number of pages and page size that a footer line stands for; off on a short last page, as its size is smaller."""
    size = F.greatest(F.lit(1), line["to"] - line["from"] + 1)
    return F.struct(
        F.greatest(F.lit(1), F.ceil(line["from"] / size)).cast("int").alias("page"),
        F.greatest(F.lit(1), F.ceil(line["total"] / size)).cast("int").alias("pages"),
        size.cast("int").alias("page_size"),
    )


def nominal_page(first: Column, size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1), F.ceil(first / size)).cast("int")


def page_count(expected: Column, size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1), F.ceil(expected / size)).cast("long")


def find_category(text: Column) -> Column:
    """The first category, in their order, whose name stands anywhere in the text, whatever the case."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(c.lower()), c) for c in CATEGORIES))


def is_category(text: Column) -> Column:
    return F.trim(text).isin(*CATEGORIES)


def find_date(text: Column) -> Column:
    """First dd/mm/yyyy as yyyy-mm-dd, with no look at the calendar; null if there is none."""
    day = F.concat_ws("-", *(F.regexp_extract(text, DATE, g) for g in (3, 2, 1)))
    return F.when(text.rlike(DATE), day)


def provisional_id(date: Column, category: Column, description: Column) -> Column:
    return F.concat(date, F.lit("_"), slugify(category), F.lit("_"), slugify(F.coalesce(description, F.lit(""))))


def pick_description(cells: Column, row_text: Column, category: Column) -> Column:
    """The longest cell that may describe the record, the first of equals; null if none, or if it is the whole row."""
    plain = F.transform(cells, trim)
    fit = F.filter(
        plain,
        lambda c: (F.length(c) > 0)
        & (F.length(c) < 300)
        & ~F.lower(c).isin("ver", "detalle")
        & (F.lower(c) != F.lower(category))
        & ~(find_date(c).isNotNull() & (F.length(c) <= 10)),
    )
    best = F.aggregate(fit, F.lit(None).cast("string"), lambda a, c: F.when(a.isNull() | (F.length(c) > F.length(a)), c).otherwise(a))
    return F.when(best != trim(row_text), best)


def labelled_cell(cells: Column, *hints: str) -> Column:
    """What follows ``hint:`` in the first cell that begins so and has something there; cells first, then hints."""
    def value(c: Column, hint: str) -> Column:
        text = trim(c)
        return F.when(F.lower(text).startswith(f"{hint.lower()}:"), F.nullif(trim(F.substring(text, len(hint) + 2, 1 << 30)), F.lit("")))

    values = F.filter(F.transform(cells, lambda c: F.coalesce(*(value(c, h) for h in hints))), lambda v: v.isNotNull())
    return F.get(values, F.lit(0))
