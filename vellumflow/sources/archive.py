"""ZIP packages of a corpus.

Here a package is a row, so its documents are held by one task; a large run is packed as several packages of bounded size first
(``operators.package.shard``). ``sinks`` writes packages as files without holding them. Archives are made with fixed dates and sorted names, so equal input gives equal bytes. Packages and
the progress of runs can be kept in a folder that all executors share, read back, and cleared before a run starts anew.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import delete_path

SCHEMA = "package string, data binary, entries long"
#: Date of all entries, and how hard they are deflated.
_DATE, LEVEL = (1980, 1, 1, 0, 0, 0), 6


def zip_entry(name: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name, _DATE)
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


def zip_bytes(entries: list[tuple[str, bytes]], level: int = LEVEL) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, data in sorted(entries):
            z.writestr(zip_entry(name), data, compresslevel=level)
    return out.getvalue()


def zip_packages(entries: DataFrame) -> DataFrame:
    """(package, data, entries) from (package, name, data binary). A package must fit in a worker's memory."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, bytes(d)) for n, d in zip(pdf["name"], pdf["data"], strict=True)]
        return pd.DataFrame({"package": [pdf["package"].iloc[0]], "data": [zip_bytes(rows)], "entries": [len(rows)]})

    return entries.groupBy("package").applyInPandas(pack, SCHEMA)


def read_packages(packages: DataFrame) -> DataFrame:
    """(package, name, data) of the entries of packages (package, data)."""
    def read(batches):
        for batch in batches:
            rows = [(p, i.filename, z.read(i)) for p, d in zip(batch["package"], batch["data"], strict=True) for z in [zipfile.ZipFile(io.BytesIO(bytes(d)))] for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["package", "name", "data"])

    return packages.select("package", "data").mapInPandas(read, "package string, name string, data binary")


def keep(table: DataFrame, root: str, what: str) -> None:
    """Keep a table of packages or of progress below ``root`` until it is cleared; what was kept under that name is replaced."""
    table.write.mode("overwrite").parquet(f"{root}/{what}")


def restore(spark: SparkSession, root: str, what: str, schema: str = SCHEMA) -> DataFrame:
    """What is kept below ``root``, or no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{what}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{what}")


def clear(spark: SparkSession, root: str, what: str) -> None:
    delete_path(spark, f"{root}/{what}")


def package_to_give(kept: DataFrame, built: Callable[[], DataFrame]) -> DataFrame:
    """The packages that are kept, or where there are none, those that ``built`` makes."""
    return built() if kept.isEmpty() else kept
