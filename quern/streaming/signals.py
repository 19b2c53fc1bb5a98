"""The progress signal: the last code that was sent, as a batch query and as a stream. Last write wins, without checks of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The codes of a running job and what they say.
MESSAGES = {
    "10001": "입력 내용을 특허 문서 구조로 분석 중입니다.",
    "10002": "유사 특허를 검색 중입니다.",
    "10003": "최종 특허 명세서를 생성 중입니다.",
    "DONE": "AI 답변 생성이 완료되었습니다.",
}
OTHER = "AI 작업을 처리 중입니다."


def message(code: Column) -> Column:
    out = F.lit(OTHER)
    for k, v in MESSAGES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def running(code: Column) -> Column:
    return ~code.isin("DONE", "ERROR")


def last_status(signals: DataFrame, keys: list[str] = (), ident: str = "event_id") -> DataFrame:
    """The last signal (ts, code) of each key, ties by id; the same on a batch and, in update mode, on a stream."""
    last = signals.groupBy(*keys).agg(F.max_by(F.struct("code", "ts"), F.struct("ts", ident)).alias("last"))
    return last.select(*keys, F.col("last.code").alias("code"), F.col("last.ts").alias("ts"), message(F.col("last.code")).alias("message"), running(F.col("last.code")).alias("running"))


def start_status(signals: DataFrame, folder: str, keys: list[str] = (), interval: str | None = None):
    """The running state: each batch's changed keys are written to a part of folder/changes, all that is there once with
    interval None, else every `interval`. A batch that is tried again writes its part again; the stream goes on from folder/checkpoint."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    writer = last_status(signals, keys).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_status(spark: SparkSession, folder: str, keys: list[str] = ()) -> DataFrame:
    """The state that start_status has written so far: each key's row of the last batch that changed it."""
    found = spark.read.parquet(f"{folder}/changes")
    own = [c for c in found.columns if c not in (*keys, "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("last")).select(*keys, *[f"last.{c}" for c in own])


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events of each type in event-time windows, late ones within a watermark counted."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def work_through(queue: DataFrame, handle, name: str = "work", checkpoint: str | None = None):
    """Hands each batch of pending rows to `handle(df, batch_id)`, which writes their results and states."""
    writer = queue.where("status = 'pending'").writeStream.foreachBatch(handle).queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def live(rows: DataFrame, now: Column) -> DataFrame:
    """Codes and tokens that haven't expired."""
    return rows.where(F.col("expires_at") > now)
