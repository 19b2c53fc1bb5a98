"""Signals of a running job: each phase is noted as it begins, and whoever waits polls until the job no longer runs.

Notes are small files under names of their own in the shared folder, so writers need no lock and readers see whole ones. A listener notes what
the stream itself does (begun, batches with rows, ended or failed); the job notes what it does within a batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quern.streaming.signals import message, running

NOTES = "at long, code string, batch long, n_rows long, error string"
# The codes that a job sends in order, and the two that end it.
BEGUN, SEARCHING, DRAFTING, DONE, ERROR = "10001", "10002", "10003", "DONE", "ERROR"
#: What the listener notes of a batch with rows; it has no message of its own.
BATCH = "BATCH"


def note(spark: SparkSession, folder: str, code: str, batch: int | None = None, n_rows: int | None = None, error: str | None = None) -> None:
    at = time.time_ns()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/signals/{at:020d}-{code}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        out.write(bytearray(json.dumps({"at": at, "code": code, "batch": batch, "n_rows": n_rows, "error": error and error[:4000]}).encode()))
    finally:
        out.close()


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """NOTES with message and running of all that was noted so far; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/signals")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    own = spark.read.schema(NOTES).json(f"{folder}/signals") if there else spark.createDataFrame([], NOTES)
    return own.withColumn("message", message(F.col("code"))).withColumn("running", running(F.col("code")))


def status(spark: SparkSession, folder: str) -> tuple[str, str, bool] | None:
    """(code, message, running) of the last note."""
    last = notes(spark, folder).agg(F.max_by(F.struct("code", "message", "running"), "at").alias("x")).first()["x"]
    return tuple(last) if last else None


def poll(spark: SparkSession, folder: str, every: float = 1.0, most: float = 300.0) -> Iterator[tuple[str, str, bool]]:
    """The job's status each time that it has changed, until it no longer runs; a job that says nothing final within `most` seconds is an error."""
    until, last = time.monotonic() + most, None
    while True:
        now = status(spark, folder)
        if now and now != last:
            yield now
            last = now
        if now and not now[2]:
            return
        if time.monotonic() > until:
            raise TimeoutError(f"still running after {most:g} seconds")
        time.sleep(every)


class Listener(StreamingQueryListener):
    """Notes the life of the one query of this name."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name, self.id = spark, folder, name, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.id = event.id
            note(self.spark, self.folder, BEGUN)

    def onQueryProgress(self, event) -> None:
        if event.progress.id == self.id and event.progress.numInputRows:
            note(self.spark, self.folder, BATCH, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            note(self.spark, self.folder, ERROR if event.exception else DONE, error=event.exception)


def run_noted(stream: DataFrame, search: Callable[[DataFrame], DataFrame], draft: Callable[[DataFrame, int], None], folder: str, name: str, every: float = 0.2, most: float = 300.0) -> list[tuple[str, str, bool]]:
    """Runs what is there of a stream: for each batch search(rows), noted as searching, then draft(found, batch), noted as drafting. Returns
    the statuses that a poller saw; the last is DONE or ERROR, which it has waited for. A batch that is tried again is noted again."""
    spark = stream.sparkSession
    listener = Listener(spark, folder, name)
    spark.streams.addListener(listener)

    def step(rows: DataFrame, batch: int) -> None:
        note(spark, folder, SEARCHING, batch)
        found = search(rows)
        note(spark, folder, DRAFTING, batch)
        draft(found, batch)

    try:
        stream.writeStream.queryName(name).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()
        return list(poll(spark, folder, every, most))
    finally:
        spark.streams.removeListener(listener)
