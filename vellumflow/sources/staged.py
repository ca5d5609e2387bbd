"""Files on any file system that Arrow can open, written aside and put in place when all tasks are done.

A sink's tasks write below a hidden folder of the target. The driver moves what the winning attempts have written to its final
names and then writes ``_SUCCESS``; a failed job deletes the hidden folder, so it leaves nothing behind. Names hold the number of
the partition, not of the attempt: a task that runs again after a lost executor takes the same final names.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

#: Files moved at a time by the driver.
MOVES = 16


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a URI or a plain path."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path``, in order; names that begin with ``_`` or ``.`` are left out."""
    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not re.search(r"/[_.]", f.path[len(root) :])]
    return sorted((f.path, f.size) for f in shown)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: place aside and final name of each file."""

    files: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Staging:
    """One job's files below ``path``."""

    path: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def aside(self) -> str:
        return f"_staged-{self.job}"

    def create(self, name: str, done: Written):
        """A stream to write the file ``name`` to, noted in ``done``."""
        system, root = open_path(self.path)
        folder = posixpath.join(root, self.aside)
        system.create_dir(folder, recursive=True)
        place = f"{uuid.uuid4().hex}-{name.replace('/', '-')}"  # attempts of a task never share a place
        done.files.append((place, name))
        return system.open_output_stream(posixpath.join(folder, place), compression=None)  # bytes as given, whatever the name says

    def commit(self, messages: Iterable[Written | None]) -> None:
        system, root = open_path(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        for folder in sorted({posixpath.dirname(posixpath.join(root, name)) for _, name in files} | {root}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: system.move(posixpath.join(root, self.aside, f[0]), posixpath.join(root, f[1])), files))
        self._drop(system, root)
        system.open_output_stream(posixpath.join(root, "_SUCCESS")).close()

    def abort(self) -> None:
        self._drop(*open_path(self.path))

    def _drop(self, system: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, self.aside)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
