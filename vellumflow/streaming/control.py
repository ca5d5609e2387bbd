"""Control of a run: start, pause, resume, cancel, and what it says of itself.

A run is a stream over a folder. Pausing stops the query and keeps its checkpoint and state, so that resuming goes on with the
first document that was not written; cancelling stops it for good. Rate is limited by files to a batch and by the time between
batches; a batch that fails is tried again after a growing delay.

The run's commands and batches are kept beside its checkpoint (``progress``), so that another driver can take it up with ``attach``
and resume it where it stands.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scratch import scratch_path
from .progress import Journal, Recorder
from .run import rocksdb, stream_pattern

# Which commands a state allows, and the state after them.
COMMANDS = {
    "start": {"idle": "running", "completed": "running", "cancelled": "running", "error": "running"},
    "pause": {"running": "paused"},
    "resume": {"paused": "running"},
    "cancel": {"running": "cancelled", "paused": "cancelled"},
}
# Seconds between batches, attempts at a batch, and seconds before the first further attempt and at most.
EVERY, ATTEMPTS, FIRST_WAIT, MOST_WAIT = 0.8, 3, 1.0, 16.0
#: Seconds to wait for what a stopped query still has to report.
REPORTED = 30.0


def after(state: str, command: str) -> str:
    """State after a command; raises where the state does not allow it."""
    allowed = COMMANDS.get(command)
    if allowed is None:
        raise ValueError(f"no such command: {command}")
    if state not in allowed:
        raise ValueError(f"a run that is {state} cannot {command}")
    return allowed[state]


@dataclass
class Run:
    """A controlled run over the files at ``path``; what ``change`` makes of them is appended below ``root``."""

    spark: SparkSession
    path: str
    change: Callable[[DataFrame], DataFrame]
    root: str = ""
    files_per_batch: int = 1
    every: float = EVERY
    wait: Callable[[float], None] = time.sleep
    state: str = "idle"
    query: StreamingQuery | None = None
    recorder: Recorder | None = None

    @classmethod
    def attach(cls, spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], root: str, **options) -> Run:
        """A run that another object or driver began below ``root``, in the state it is in.

        One that was running when its driver went away is paused: nothing runs it any more, and it can be resumed.
        """
        state = Journal(root).state()
        if state is None:
            raise ValueError(f"no run at {root}")
        run = cls(spark, path, change, root=root, state=state, **options)
        if state == "running":
            run._become("pause", "paused")
        return run

    @property
    def journal(self) -> Journal:
        return Journal(self.root)

    def _become(self, command: str, state: str) -> None:
        self.state = state
        self.journal.say(command, state)

    def start(self) -> None:
        """A new run: what an earlier one wrote is left where it is, and nothing of it counts."""
        state = after(self.state, "start")
        self.root = scratch_path(self.spark, "run")
        self._become("start", state)
        self._open()

    def pause(self) -> None:
        state = after(self.state, "pause")
        self._close()
        self._become("pause", state)

    def resume(self) -> None:
        self._become("resume", after(self.state, "resume"))
        self._open()

    def cancel(self) -> None:
        """Stop for good. Documents not reached are no failures."""
        state = after(self.state, "cancel")
        self._close()
        self._become("cancel", state)

    def _rows(self) -> DataFrame:
        reader = self.spark.readStream.schema(self.spark.read.parquet(self.path).schema).option("maxFilesPerTrigger", self.files_per_batch)
        return self.change(reader.parquet(stream_pattern(self.path)))

    def _open(self) -> None:
        writer = self._rows().writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/state")
        with rocksdb(self.spark):
            self.query = writer.trigger(processingTime=f"{max(1, round(self.every * 1000))} milliseconds").start()
        self.recorder = Recorder(self.journal, str(self.query.id), str(self.query.runId))
        self.spark.streams.addListener(self.recorder)
        self._recover()

    def _recover(self) -> None:
        """Note batches that were done before the recorder listened."""
        for p in self.query.recentProgress:
            if p.numInputRows and not self.journal.has(p.batchId):
                self.journal.note(p.batchId, p.numInputRows, p.timestamp, p.batchDuration / 1000)

    def _close(self) -> None:
        if self.query is not None:
            self.query.stop()
            self._recover()
            self.recorder.ended.wait(REPORTED)
            self.spark.streams.removeListener(self.recorder)
            self.query = self.recorder = None

    def poll(self, attempts: int = ATTEMPTS) -> str:
        """State now: ends as completed where all there is has been read, as an error where attempts are used up.

        Only failures of the query count as attempts; errors of this program are raised.
        """
        if self.state != "running":
            return self.state
        for n in range(attempts):
            try:
                self.query.processAllAvailable()
                self._close()
                self._become("poll", "completed")
                return self.state
            except StreamingQueryException:
                self._close()
                if n + 1 < attempts:
                    self.wait(min(MOST_WAIT, FIRST_WAIT * 2**n))
                    self._open()
        self._become("poll", "error")
        return self.state

    def progress(self) -> dict:
        """State, rows read, batches, and the time of the last one."""
        if not self.root:
            return {"state": self.state, "processed": 0, "batches": 0, "last": None}
        if self.query is not None:
            self._recover()
        return {"state": self.state} | self.journal.summary(self.spark)

    def output(self) -> DataFrame:
        """What has been written so far."""
        return self.spark.read.schema(self._rows().schema).parquet(f"{self.root}/out")
