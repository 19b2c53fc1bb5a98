"""Pairs by number, and the distribution over drawn and over all pairs, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pairs


def test_numbers_are_all_pairs_once(spark):
    own = {tuple(r) for r in spark.range(45).select(*pairs.unranked(F.col("id"))).collect()}
    assert own == {(i, j) for j in range(10) for i in range(j)}
    far = [(i, j) for j in (2**20, 2**26 + 1, 2**30) for i in (0, 1, j // 2, j - 1)]
    rows = spark.createDataFrame([(j * (j - 1) // 2 + i,) for i, j in far], "r long").select(*pairs.unranked(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == far


def vectors(spark, n, seed=1, dim=6):
    x = np.random.default_rng(seed).normal(size=(n, dim)) + 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)


def test_drawn_pairs_cover_all_vectors(spark):
    x, df = vectors(spark, 80)
    found = pairs.sampled_products(df, "vec_id", "v", 500, 7).toPandas()["x"].to_numpy()
    everything = (x @ x.T)[np.triu_indices(80, 1)]
    assert len(found) == 500 and all(np.abs(everything - f).min() < 1e-12 for f in found) and abs(found.mean() - everything.mean()) < 0.08
    drawn = pairs.drawn_pairs(spark, 80, 500, 7).collect()
    assert len({i for r in drawn for i in r}) == 80 and all(0 <= r["i"] < r["j"] < 80 for r in drawn) and len(set(map(tuple, drawn))) > 450
    assert np.allclose(np.sort(pairs.sampled_products(df, "vec_id", "v").toPandas()["x"]), np.sort(everything))


@pytest.mark.parametrize("n, few", [(2, 10), (3, 10), (150, 20_000), (150, 40), (150, 1)])
def test_exact_is_numpys(spark, n, few):
    x, df = vectors(spark, n)
    x[n // 2 :] = x[0] if n > 100 else x[n // 2 :]  # half of them agree, so products tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    found, want = pairs.exact_summary(df, "vec_id", "v", 32, 16, few), (x @ x.T)[np.triu_indices(n, 1)]
    q = dict(zip(pairs.QUANTILES, np.quantile(want, list(pairs.QUANTILES.values()))))
    want = {"n": len(want), "mean": want.mean(), "std": want.std(), "min": want.min(), "max": want.max()} | q
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want), (found, want)


def test_variants(spark):
    x, df = vectors(spark, 60)
    own = pairs.variants(df, "v", 6)
    c = x - x.mean(0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    top = np.linalg.svd(c, full_matrices=False)[2][:2]
    r = c - c @ top.T @ top
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    for name, want in {"raw": x, "centred": c, "removed": r}.items():
        assert np.allclose(np.array([v["v"] for v in own[name].orderBy("vec_id").collect()]), want, atol=1e-9)


def test_fewer_than_two(spark):
    _, df = vectors(spark, 1)
    assert pairs.exact_summary(df, "vec_id", "v") is None and pairs.sampled_products(df, "vec_id", "v").count() == 0


def steps(monkeypatch):
    """What exact_summary writes, by name."""
    seen = []
    own = pairs.written
    monkeypatch.setattr(pairs, "written", lambda df, name="step": seen.append((name, own(df, name))) or seen[-1][1])
    return seen


def compared(spark, x, **kw):
    """exact_summary of x's rows against NumPy's."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    found, all_ = pairs.exact_summary(df, "vec_id", "v", **kw), (x @ x.T)[np.triu_indices(len(x), 1)]
    want = {"n": len(all_), "mean": all_.mean(), "std": all_.std(), "min": all_.min(), "max": all_.max()} | {k: np.quantile(all_, p) for k, p in pairs.QUANTILES.items()}
    scale = (x * x).sum(1).max()
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < (1e-7 if k == "std" else 1e-14) * scale for k in want), (found, want)


def test_exact_meets_all_pairs_once(spark, monkeypatch):
    """Vectors are dealt into groups once and all groups meet once, whatever the quantiles."""
    seen = steps(monkeypatch)
    compared(spark, vectors(spark, 700, 4)[0], block=16, bins=64, few=50)
    assert [name for name, _ in seen].count("values") == 1 and dict(seen)["block_pairs"].selectExpr("sum(size(v))").first()[0] == 700


def test_exact_counts_equal_vectors(spark, monkeypatch):
    """60 different vectors, up to 40 times each: one of each is met, their pairs all count, those with themselves too."""
    seen = steps(monkeypatch)
    x = vectors(spark, 60, 5)[0]
    times = np.random.default_rng(6).integers(1, 40, 60)
    compared(spark, np.repeat(x, times, 0), block=8, bins=64, few=50)
    assert dict(seen)["block_pairs"].selectExpr("sum(size(v))").first()[0] == 60


def test_exact_holds_where_spans_miss(spark, monkeypatch):
    """Spans without any margin: those that miss their ranks are widened until they hold them."""
    seen = steps(monkeypatch)
    monkeypatch.setattr(pairs, "SURE", 0.0)
    monkeypatch.setattr(pairs, "LOOKED", 100)
    compared(spark, vectors(spark, 500, 7)[0], block=8, bins=4096, few=1)
    assert [name for name, _ in seen].count("values") > 1


@pytest.mark.parametrize("kind", ["close", "one place", "long", "some equal"])
def test_exact_beyond_single_precision(spark, monkeypatch, kind):
    """Products that single precision can't tell apart or that are all 0, lengths from 0 to 1,000, and few values held at a time."""
    monkeypatch.setattr(pairs, "HELD", 40)
    x, rng = vectors(spark, 400, 8)[0], np.random.default_rng(9)
    if kind == "close":
        x = x[:1] + rng.normal(size=x.shape) * 1e-8
    elif kind == "one place":
        x = np.eye(400)
    elif kind == "long":
        x = x * np.linspace(0, 1000, 400)[:, None]
    else:
        x = np.concatenate([x[:200], x[:150], x[:150], np.zeros((5, 6))])
    compared(spark, x, block=16, bins=64, few=30)


@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, float("nan"), 0.0]])
def test_exact_takes_whole_vectors_only(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, bad)], "vec_id long, v array<double>")
    with pytest.raises(Exception):
        pairs.exact_summary(df, "vec_id", "v")
