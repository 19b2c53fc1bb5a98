"""What only larger tables bring: ids of many digits, values next to a half, rows enough for more than one group of a task."""

import numpy as np

from quern.functions import text as T
from quern.operators import pairs as P
from quern.operators import vectors as O
from quern.plans import app as app_plans
from quern.plans import text as text_plans
from quern.sources.shared import written


def test_fixed_rounds_the_exact_value(spark):
    values = [0.125, 0.375, 1.005, 10.645, 2.675, 99.995, -0.125, 0.0, 1e20, 12.3456, 64.995]
    got = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "x double").select(T.fixed("x", 2).alias("r"), T.fixed("x", 0).alias("s")).collect()
    assert [tuple(r) for r in got] == [(f"{x:.2f}", f"{x:.0f}") for x in values] + [(None, None), ("nan", "nan")]


def test_percent_of_prices_next_to_a_half(spark, tmp_path):
    prices = [50000 + 20 * k + 10.0 for k in range(2000)] + [71290.0, 50002.5]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r[0]: r[1] for r in text_plans.QUERIES["percent_clamp"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{max(0.0, min(100.0, (p / 200000 - 0.25) * 100)):.2f}" for k, p in enumerate(prices)}


def test_codes_of_ids_beyond_six_digits(spark, tmp_path):
    """Two ids of one user that end in the same six digits are two codes."""
    rows = [(5, 1, 0), (1000005, 1, 1), (7, 2, 0), (1234567, 3, 0)]
    spark.createDataFrame(rows, "event_id long, user_id long, minute int").selectExpr("event_id", "user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, minute) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["outcome"]: r["n"] for r in app_plans.QUERIES["verification_outcome"](spark, str(tmp_path)).collect()}
    assert got == {"wrong code": 1, "ok": 3}


def test_wide_sums_of_more_groups_than_a_task_holds(spark, monkeypatch):
    """Groups come back after their sums have left the task; rows without a vector count in n."""
    monkeypatch.setattr(O, "HELD", 4 * 300 * 3)
    rows = [(g, None if k == 3 and g % 5 == 0 else [float(g + k * j % 7) for j in range(300)]) for k in range(6) for g in range(40)]
    got = O.wide_stats(spark.createDataFrame(rows, "g long, v array<double>").coalesce(1), ["g"], "v").collect()
    assert len(got) == 40
    for r in got:
        x = np.array([v for g, v in rows if g == r["g"] and v is not None])
        assert r["n"] == 6 and np.allclose(r["mean"], x.mean(0)) and np.allclose(r["std"], x.std(0), atol=1e-6) and np.allclose(r["most"], x.max(0))


def test_exact_pairs_travel_by_groups_of_blocks(spark, monkeypatch):
    """So many vectors of blocks of 4: a vector is written once for each of 16 groups at most, not once for each block; results are those of all pairs."""
    seen = []
    monkeypatch.setattr(P, "written", lambda df, name="step": seen.append((name, written(df, name))) or seen[-1][1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = P.exact_summary(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", block=4, bins=32, few=500)
    all_ = (x @ x.T)[np.triu_indices(400, 1)]
    assert found["n"] == len(all_) and all(abs(found[k] - v) < 1e-9 for k, v in {"mean": all_.mean(), "std": all_.std(), "min": all_.min(), "max": all_.max()}.items())
    assert all(abs(found[k] - np.quantile(all_, p)) < 1e-9 for k, p in P.QUANTILES.items())
    pairs = dict(seen)["block_pairs"]
    assert pairs.selectExpr("sum(size(v))").first()[0] <= 16 * 400
