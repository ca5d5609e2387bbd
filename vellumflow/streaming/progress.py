"""What a run says of itself, kept beside its checkpoint, where another driver finds it.

Each command and each end of a run is a small file, named by its number, so the last one is the run's state. Each batch is one
too, written when Spark reports it and named by the batch's number: a batch that is reported again after a restart replaces its own
entry, and any number of batches counts right. Entries are read by Spark, as rows.
"""

from __future__ import annotations

import json
import posixpath
import threading
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..sources.staged import open_path

BATCH = "batch long, rows long, at string, seconds double"
COMMAND = "number long, command string, state string, at double"


class Journal:
    """Entries below ``root``/journal."""

    def __init__(self, root: str) -> None:
        self.root = f"{root}/journal"

    def _put(self, kind: str, number: int, entry: dict) -> None:
        system, root = open_path(self.root)
        folder = posixpath.join(root, kind)
        system.create_dir(folder, recursive=True)
        aside = posixpath.join(folder, f"_{uuid.uuid4().hex}")  # hidden until it is whole
        with system.open_output_stream(aside) as out:
            out.write(json.dumps(entry).encode())
        system.move(aside, posixpath.join(folder, f"{number:012d}.json"))

    def _names(self, kind: str) -> list[str]:
        system, root = open_path(self.root)
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, kind), allow_not_found=True))
        return sorted(f.path for f in found if not posixpath.basename(f.path).startswith("_"))

    def say(self, command: str, state: str) -> None:
        number = len(self._names("commands"))
        self._put("commands", number, {"number": number, "command": command, "state": state, "at": time.time()})

    def state(self) -> str | None:
        """The state after the last command, or None where there was none."""
        names = self._names("commands")
        if not names:
            return None
        with open_path(self.root)[0].open_input_stream(names[-1]) as f:
            return json.loads(f.read())["state"]

    def note(self, batch: int, rows: int, at: str, seconds: float) -> None:
        self._put("batches", batch, {"batch": batch, "rows": rows, "at": at, "seconds": seconds})

    def has(self, batch: int) -> bool:
        system, root = open_path(self.root)
        return system.get_file_info(posixpath.join(root, "batches", f"{batch:012d}.json")).type == fs.FileType.File

    def batches(self, spark: SparkSession) -> DataFrame:
        """batch, rows, at, seconds of each batch that read something."""
        return self._read(spark, "batches", BATCH)

    def commands(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "commands", COMMAND)

    def _read(self, spark: SparkSession, kind: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(f"{self.root}/{kind}") if self._names(kind) else spark.createDataFrame([], schema)

    def summary(self, spark: SparkSession) -> dict:
        """Rows, batches and the time of the last one."""
        row = self.batches(spark).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("processed"), F.count(F.lit(1)).alias("batches"), F.max_by("at", "batch").alias("last")).first()
        return row.asDict()


class Recorder(StreamingQueryListener):
    """Notes the batches of one query in a journal: those of its identifier, which stays when it goes on; ``run`` is this start of it."""

    def __init__(self, journal: Journal, query: str, run: str) -> None:
        self.journal, self.query, self.run, self.ended = journal, query, run, threading.Event()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        if str(p.id) == self.query and p.numInputRows:
            self.journal.note(p.batchId, p.numInputRows, p.timestamp, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if str(event.runId) == self.run:  # events come in order, so all batches have been noted
            self.ended.set()
