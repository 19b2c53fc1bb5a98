"""Codes and tokens that expire: a keyed state with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long a verification code and a token are good for, in minutes.
LIFETIMES = {"code": 5, "token": 60}
EXPIRED = "kind string, user_id long, event_id long, expires long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """The one valid grant of each kind that a user has: a new one replaces it; one that nothing replaces in time is emitted as expired, and leaves the state.
    A grant is good up to its last microsecond, as a code is that is sent at the very time of its expiry. All kinds are one state, as each call for
    a key and each frame that it gives costs far more than a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", ", ".join(f"{k}_event long, {k}_expires long" for k in LIFETIMES))

    def _read(self) -> dict[str, tuple[int, int]]:
        found = self.current.get()
        return {k: (found[2 * i], found[2 * i + 1]) for i, k in enumerate(LIFETIMES) if found[2 * i + 1] is not None} if found else {}

    def _write(self, own: dict[str, tuple[int, int]]) -> None:
        self.current.update(tuple(v for k in LIFETIMES for v in own.get(k, (None, None))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, out = self._read(), []
        before = {self._due(e) for _, e in own.values()}
        grants = sorted(((int(t), int(e)) for b in rows for e, t in zip(b["event_id"], b["issued"])))
        for kind, minutes in LIFETIMES.items():
            life, now = minutes * 60_000_000, own.get(kind)
            for issued, event in grants:
                if now and issued + life < now[1]:
                    continue  # older than the one that is valid: late, though within the watermark
                if now and issued > now[1]:
                    out.append((kind, *now))
                now = (event, issued + life)
            own[kind] = now
        self._write(own)
        after = {self._due(e) for _, e in own.values()}
        for due in before - after:
            self.handle.deleteTimer(due)
        for due in after - before:
            self.handle.registerTimer(due)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, upto = self._read(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # all that is over by now in one frame
        over = [k for k, (_, expires) in own.items() if self._due(expires) <= upto]
        if over:
            out = [(k, *own.pop(k)) for k in over]
            if own:
                self._write(own)
            else:
                self.current.clear()
            yield self._frame(key, out)

    @staticmethod
    def _frame(key, out: list) -> pd.DataFrame:
        kinds, events, expires = zip(*out)
        return pd.DataFrame({"kind": kinds, "user_id": int(key[0]), "event_id": events, "expires": expires})

    @staticmethod
    def _due(expires: int) -> int:
        return expires // 1000 + 1  # timers are in milliseconds; the first one behind

    def close(self) -> None:
        pass


def expiries(grants: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(kind, user_id, event_id, expires in microseconds) of a stream of grants (event_id, ts timestamp, user_id): each event grants a code and a token.
    Rows without a user or a time grant nothing."""
    own = grants.where("user_id IS NOT NULL AND ts IS NOT NULL").select("ts", "user_id", "event_id", F.unix_micros("ts").alias("issued"))
    keyed = own.withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(Expiring(), EXPIRED, "Append", "EventTime")


def start_expiries(spark: SparkSession, grants: DataFrame, folder: str, late: str = "0 seconds"):
    """Writes each batch's expiries to a part of folder/expired until what is there is read; the state and timers go on from folder/checkpoint when started anew.
    A batch that is tried again writes its part again."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/expired/batch={batch}")

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        writer = expiries(grants, late).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def read_expiries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EXPIRED).parquet(f"{folder}/expired").select("kind", "user_id", "event_id", F.timestamp_micros("expires").alias("expires_at"))
