"""A work queue that a stream drains, with a ledger: what was claimed, tried, done or given up, so that a batch that is tried again handles no row twice.

A batch is dealt into slices by a hash of the row's id. A slice's results are one write, which is there as a whole or not at all;
the ledger then has it as done. A handler that fails ends the stream; started anew, it gets the same batch, in which slices
that are done are passed over. A slice that failed too often is given up: its rows are failed, and the stream goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "id long, status string, attempt int, batch long, slice int"
LEDGER = "batch long, slice int, attempt int, state string, error string"
#: Slices of a batch, and attempts of a slice.
SLICES, ATTEMPTS = 8, 3


def _note(spark: SparkSession, folder: str, batch: int, part: int, attempt: int, state: str, error: str = "") -> None:
    """One small file for each entry, under a name of its own: entries are added, never changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/{batch:08d}-{part:04d}-{attempt:04d}-{state}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps({"batch": batch, "slice": part, "attempt": attempt, "state": state, "error": error[:500]}).encode()))
    finally:
        out.close()


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{folder}/ledger")


def drain(queue: DataFrame, handle: Callable[[DataFrame, int], DataFrame], folder: str, slices: int = SLICES, attempts: int = ATTEMPTS):
    """Hands the pending rows of a streamed queue (id, status, ...) to handle(rows, attempt), which returns (id, status) of each, a slice at a time.
    folder is in the shared folder and holds results, ledger and checkpoint; rows whose ids are null have no state to keep and are left."""
    spark = queue.sparkSession

    def run(rows: DataFrame, batch: int) -> None:
        own = rows.where("status = 'pending' AND id IS NOT NULL").withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        past = ledger(spark, folder).where(F.col("batch") == batch).collect()  # slices times attempts
        for part in range(slices):
            mine = [r for r in past if r["slice"] == part]
            if any(r["state"] in ("done", "given up") for r in mine):
                continue
            attempt = 1 + max((r["attempt"] for r in mine), default=0)
            todo = own.where(F.col("_slice") == part).drop("_slice")
            given_up = attempt > attempts
            _note(spark, folder, batch, part, attempt, "claimed")
            try:
                made = todo.select("id", F.lit("failed").alias("status")) if given_up else handle(todo, attempt).select(F.col("id").cast("long").alias("id"), "status")
                made.select("id", "status", F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{folder}/results/batch={batch}/slice={part}")
            except Exception as e:
                _note(spark, folder, batch, part, attempt, "failed", str(e))
                raise
            _note(spark, folder, batch, part, attempt, "given up" if given_up else "done")

    return queue.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(run).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """RESULTS of all slices, or as they stood behind the batch numbered `version`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/results")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RESULTS)
    done = ledger(spark, folder).where("state IN ('done', 'given up')").select("batch", "slice").distinct()
    found = spark.read.schema(RESULTS).parquet(f"{folder}/results").join(F.broadcast(done), ["batch", "slice"], "left_semi")  # a row for each slice
    return found if version is None else found.where(F.col("batch") <= version)


def states(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the states that results give its rows."""
    own = done.select("id", F.col("status").alias("_new"), "attempt")
    return queue.join(own, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
