"""Expiring states over restarts, the queue's ledger when handlers fail, and retrieval for many queries, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quern.operators import search
from quern.streaming import expiry, phases, queue

EVENTS = "event_id long, ts timestamp, user_id long"


def plain_expiries(events, upto):
    out = set()
    for kind, minutes in expiry.LIFETIMES.items():
        life, by = minutes * 60, {}
        for e, ts, user in events:
            if user is not None and ts is not None:
                by.setdefault(user, []).append((ts, e))
        for user, own in by.items():
            own.sort()
            for (ts, e), nxt in zip(own, [*own[1:], (upto, None)]):
                if nxt[0] > ts + life:
                    out.add((kind, user, e, ts + life))
    return out


def test_expiries_keep_one_state_a_user(spark, tmp_path):
    """Kinds aren't dealt out as keys of their own, and a timer gives all that is over by then; grants of one time and timers of one millisecond lose nothing."""
    plan = expiry.expiries(spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path)))._jdf.queryExecution().logical().toString()
    assert "explode" not in plan.lower()

    class State:
        def __init__(self):
            self.value, self.timers = None, set()

        getValueState = lambda self, *_: self
        get = lambda self: self.value
        exists = lambda self: self.value is not None
        update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)
        registerTimer = lambda self, due: self.timers.add(due)
        deleteTimer = lambda self, due: self.timers.remove(due)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    import pandas as pd

    s, e, minute = State(), expiry.Expiring(), 60_000_000
    e.init(s)
    got = [tuple(r) for f in e.handleInputRows((7,), iter([pd.DataFrame({"event_id": [3, 1, 2], "issued": [6 * minute, 0, 0]})]), At(0)) for r in f.itertuples(index=False)]
    assert got == [("code", 7, 2, 5 * minute)] and s.timers == {11 * 60_000 + 1, 66 * 60_000 + 1}
    got = [tuple(r) for f in e.handleExpiredTimer((7,), At(66 * 60_000 + 1), At(11 * 60_000 + 1)) for r in f.itertuples(index=False)]
    assert got == [("code", 7, 3, 11 * minute), ("token", 7, 3, 66 * minute)] and s.value is None
    assert not list(e.handleExpiredTimer((7,), At(66 * 60_000 + 1), At(66 * 60_000 + 1)))


def test_expiries_over_a_restart(spark, tmp_path):
    r = random.Random(1)
    first = [(i, 1_700_000_000 + r.randrange(4000), r.randrange(6)) for i in range(120)] + [(500, 1_700_000_000, 3), (501, 1_700_000_000, 3), (502, None, 1), (503, 1_700_000_100, None)]
    start = max(t for _, t, _ in first if t)
    later = [(1000 + i, start + r.randrange(9000), r.randrange(6)) for i in range(120)]

    def run(name, rows):
        spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        expiry.start_expiries(spark, stream, str(tmp_path)).awaitTermination()
        return sorted((x["kind"], x["user_id"], x["event_id"], x["s"]) for x in expiry.read_expiries(spark, str(tmp_path)).withColumn("s", F.unix_timestamp("expires_at")).collect())

    assert run("a", first) == sorted(plain_expiries(first, start))
    both = first + later
    assert run("b", later) == sorted(plain_expiries(both, max(t for _, t, _ in both if t)))


ASKED = [(i, "pending" if i % 3 else "completed") for i in range(60)] + [(None, "pending")]


def drained(spark, tmp_path, handle, attempts=3):
    if not (tmp_path / "in").exists():
        spark.createDataFrame(ASKED, "id long, status string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, status string").parquet(f"{tmp_path}/in")
    try:
        queue.drain(stream, handle, str(tmp_path), slices=4, attempts=attempts).awaitTermination()
        return True
    except StreamingQueryException:
        return False


def end(spark, tmp_path):
    asked = spark.createDataFrame(ASKED, "id long, status string")
    return queue.states(asked, queue.results(spark, str(tmp_path))).collect()


def test_no_row_is_handled_twice(spark, tmp_path):
    seen, calls = [], []

    def handle(rows, attempt):
        calls.append(attempt)
        if len(calls) == 3:
            raise RuntimeError("halfway")
        seen.extend(r["id"] for r in rows.collect())
        return rows.select("id", F.when(F.col("id") % 7 == 0, "failed").otherwise("completed").alias("status"))

    assert not drained(spark, tmp_path, handle) and 0 < len(seen) < 40 and drained(spark, tmp_path, handle)
    assert sorted(seen) == [i for i, s in ASKED if s == "pending" and i is not None] and drained(spark, tmp_path, handle) and len(seen) == 40
    want = {i: s if s == "completed" else "failed" if i % 7 == 0 else "completed" for i, s in ASKED if i is not None} | {None: "pending"}
    assert {r["id"]: r["status"] for r in end(spark, tmp_path)} == want
    log = {(r["slice"], r["attempt"], r["state"]) for r in queue.ledger(spark, str(tmp_path)).collect()}
    assert sum(s == "failed" for *_, s in log) == 1 and sum(s == "done" for *_, s in log) == 4 and (2, 2, "done") in log
    assert queue.results(spark, str(tmp_path), -1).count() == 0 and queue.results(spark, str(tmp_path), 0).count() == 40


def test_a_slice_is_given_up(spark, tmp_path):
    def handle(rows, attempt):
        if rows.where("id = 1").head(1):
            raise RuntimeError("never")
        return rows.select("id", F.lit("completed").alias("status"))

    assert [drained(spark, tmp_path, handle, 2) for _ in range(3)] == [False, False, True]
    states = {r["id"]: r["status"] for r in end(spark, tmp_path)}
    assert states[1] == "failed" and {states[i] for i, s in ASKED if i is not None} == {"failed", "completed"} and states[None] == "pending"


@pytest.mark.parametrize("at_once", [4096, 3])
def test_many_queries(spark, at_once):
    g = np.random.default_rng(2)
    x = np.round(g.normal(size=(300, 5)) * 4) / 4  # products are exact, so ties are ties
    x[50:60] = x[49]  # ties
    docs = [(i, int(i % 4), v.tolist()) for i, v in enumerate(x)] + [(900, 1, None), (901, 1, [1.0])]
    df = spark.createDataFrame(docs, "doc_id long, label int, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 40)] + [(7, None)], "query_id long, q array<double>")
    rows = search.top_k_each(df, asked, 12, at_once).collect()
    for i in range(0, 300, 40):
        s = x @ x[i]
        want = sorted(range(300), key=lambda j: (-s[j], j))[:12]
        got = sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in got] == want and np.allclose([r["score"] for r in got], s[want])
    assert len(rows) == 8 * 12 and search.top_k_each(df.where("false"), asked, 3).count() == 0 and search.top_k_each(df, asked.where("false"), 3).count() == 0


def test_gap_by_query(spark):
    own = {1: [0.9, 0.89, 0.88, 0.87, 0.7, 0.69, 0.68, 0.67, 0.66, 0.65, 0.64], 2: [0.9, 0.8, 0.7, 0.65, 0.64, 0.63, 0.62, 0.61, 0.6, 0.59, 0.58], 3: [0.5]}
    hits = spark.createDataFrame([(q, i, s, i + 1) for q, v in own.items() for i, s in enumerate(v)], "query_id long, doc_id long, score double, rank int")
    count = lambda *p: {r["query_id"]: r["count"] for r in search.gap_cutoff_each(hits, *p).groupBy("query_id").count().collect()}
    assert count(3, 0.05) == {1: 4, 2: 10, 3: 1} and count(2, 0.03) == {1: 4, 2: 3, 3: 1}


def test_phases_of_a_run_and_of_a_failed_one(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    seen = phases.run_noted(stream(), lambda rows: rows, lambda found, batch: found.write.parquet(f"{tmp_path}/out"), f"{tmp_path}/good", "good")
    assert seen[-1][0] == "DONE" and not seen[-1][2] and spark.read.parquet(f"{tmp_path}/out").count() == 5
    log = [(r["code"], r["n_rows"]) for r in phases.notes(spark, f"{tmp_path}/good").orderBy("at").collect()]
    assert log == [("10001", None), ("10002", None), ("10003", None), ("BATCH", 5), ("DONE", None)]

    def broken(found, batch):
        raise RuntimeError("no draft")

    seen = phases.run_noted(stream(), lambda rows: rows, broken, f"{tmp_path}/bad", "bad")
    assert seen[-1][0] == "ERROR" and not seen[-1][2] and phases.notes(spark, f"{tmp_path}/bad").where("error LIKE '%no draft%'").count() == 1


def test_a_poller_gives_up(spark, tmp_path):
    phases.note(spark, str(tmp_path), phases.SEARCHING)
    with pytest.raises(TimeoutError):
        list(phases.poll(spark, str(tmp_path), 0.05, 0.5))
    assert phases.status(spark, f"{tmp_path}/none") is None
