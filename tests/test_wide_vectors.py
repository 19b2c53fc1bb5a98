"""Means and deviations of long vectors by batches, against NumPy and the plan of one aggregate a dimension."""

import numpy as np
import pytest

from quern.operators import vectors as O


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 300)) * g.random(300) * 5 + g.normal(size=300) * 100
    return [(None if i % 9 == 0 else f"k{i % 4}", int(i % 2), x[i].tolist()) for i in range(400)]


def test_long_vectors_are_numpys(spark, rows):
    rows = [list(r) for r in rows]
    for i in range(0, 400, 7):
        rows[i][2] = [None if j % 5 == 0 else v for j, v in enumerate(rows[i][2])]
    df = spark.createDataFrame([*map(tuple, rows), ("k1", 1, None)], "label string, part int, vector array<double>").repartition(7)
    found = {(r["label"], r["part"]): r for r in O.vector_stats(df, ["label", "part"], "vector", 300).collect()}
    assert set(found) == {(r[0], r[1]) for r in rows}
    for key, r in found.items():
        x = np.array([v for a, b, v in rows if (a, b) == key], float)
        assert r["n"] == len(x) + (key == ("k1", 1)) and np.allclose(r["mean"], np.nanmean(x, 0), rtol=1e-12) and np.allclose(r["std"], np.nanstd(x, 0), atol=1e-6)
    assert O.vector_stats(df.where("false"), ["label"], "vector", 300).count() == 0


def test_both_plans_agree(spark, rows, monkeypatch):
    df = spark.createDataFrame([(a, b, v[:40]) for a, b, v in rows], "label string, part int, vector array<float>").repartition(3)
    get = lambda f, c: {r["label"]: r[c] for r in f.collect()}
    mean, stats = get(O.vector_mean(df, ["label"], "vector", 40), "mean"), get(O.vector_stats(df, ["label"], "vector", 40), "std")
    pooled = get(O.mean_max_pool(df, ["label"], "vector", 40), "pooled")
    z = {tuple(r["vector"]): r["z"] for r in O.zscore_l2(df, ["label"], "vector", 40).collect()}
    monkeypatch.setattr(O, "WIDE", 1)
    for want, got in ((mean, get(O.vector_mean(df, ["label"], "vector", 40), "mean")), (stats, get(O.vector_stats(df, ["label"], "vector", 40), "std")), (pooled, get(O.mean_max_pool(df, ["label"], "vector", 40), "pooled"))):
        assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-6) for k in want)
    for r in O.zscore_l2(df, ["label"], "vector", 40).collect():
        assert np.allclose(r["z"], z[tuple(r["vector"])], atol=1e-6)
