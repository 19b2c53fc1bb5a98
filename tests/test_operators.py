"""Operators on small inputs with known results, and rewrites against the plain form."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import search as S
from quern.operators import vectors as O
from quern.sources import corpus as C
from quern.sources import hooks, sinks
from quern.streaming import signals


def scored(spark, scores):
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "doc_id long, score double")


@pytest.mark.parametrize(
    "scores, a, b",
    [
        ([0.90, 0.89, 0.88, 0.87, 0.70, 0.69, 0.68, 0.67, 0.66, 0.65, 0.64], 4, 4),
        ([0.90, 0.80, 0.70, 0.65, 0.64, 0.63, 0.62, 0.61, 0.60, 0.59, 0.58], 10, 3),
        ([0.9, 0.8], 2, 2),
        ([], 0, 0),
        ([1 - 0.001 * i for i in range(14)] + [0.5, 0.1], 14, 14),
    ],
)
def test_gap_cutoff(spark, scores, a, b):
    assert S.gap_cutoff(scored(spark, scores), 3, 0.05).count() == a
    assert S.gap_cutoff(scored(spark, scores), 2, 0.03).count() == b


def test_few_shots(spark):
    hits = spark.createDataFrame([(i + 1, s) for i, s in enumerate([0.5, 0.04, 0.03, 0.02])], "rank int, score double")
    assert [r["score"] for r in S.few_shots(hits, 5).orderBy("rank").collect()] == [0.5, 0.04]


def test_weights_from_scores(spark):
    given = {"abstract": ([0.65, 0.70], [0.40, 0.45]), "claims": ([0.85, 0.80], [0.30, 0.35]), "description": ([0.55, 0.60], [0.45, 0.50])}
    rows = [(s, side, x) for s, (i, o) in given.items() for side, xs in ((True, i), (False, o)) for x in xs]
    out = {r["section"]: r for r in O.weights_from_scores(spark.createDataFrame(rows, "section string, inside boolean, score double")).collect()}
    for s, (score, weight) in {"abstract": (5.657, 0.0089), "claims": (12.727, 0.9906), "description": (1.414, 0.0005)}.items():
        assert abs(out[s]["S"] - score) < 1e-2 and abs(out[s]["W"] - weight) < 1e-4


@pytest.mark.parametrize("scope", ["global", "domain"])
def test_pair_statistics_without_pairs(spark, scope):
    r = np.random.default_rng(5)
    x = r.standard_normal((60, 7))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [0] * 25 + [1] * 20 + [2] * 14 + [3]
    df = spark.createDataFrame([(lab, v.tolist()) for lab, v in zip(label, x)], "label int, vector array<double>").repartition(5)
    g, label = x @ x.T, np.array(label)
    for row in O.pair_stats(df, "label", "vector", scope=scope).collect():
        own = np.ones(60, bool) if scope == "global" else label == row["label"]
        same = (label[:, None] == label[None, :]) & own[:, None] & ~np.eye(60, dtype=bool)
        other = label[:, None] < label[None, :] if scope == "global" else own[:, None] & (label[:, None] != label[None, :])
        for side, at in (("in", same), ("out", other)):
            pairs = g[at] if at.any() else np.zeros(1)
            assert row[f"count_{side}"] == at.sum()
            assert abs(row[f"mu_{side}"] - pairs.mean()) < 1e-9 and abs(row[f"sigma_{side}"] - pairs.std()) < 1e-7


def test_pair_statistics_of_null_labels_and_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "LANES", 2)
    x = np.random.default_rng(6).standard_normal((40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([0] * 15 + [1] * 12 + [2] * 8 + [-1] * 5)  # -1: none
    rows = [(g, int(lab) if lab >= 0 else None, v.tolist()) for g in ("a", None) for lab, v in zip(label, x)]
    df = spark.createDataFrame(rows, "part string, label int, vector array<double>").repartition(3)
    g = x @ x.T
    same, other = (label[:, None] == label[None, :]) & ~np.eye(40, dtype=bool), (label[:, None] < label[None, :]) & (label[:, None] >= 0)
    found = O.pair_stats(df, "label", "vector", ["part"])
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    found = found.collect()
    assert sorted(r["part"] or "" for r in found) == ["", "a"]
    for r in found:
        assert (r["count_in"], r["count_out"]) == (same.sum(), other.sum())
        assert np.allclose((r["mu_in"], r["mu_out"], r["sigma_in"], r["sigma_out"]), (g[same].mean(), g[other].mean(), g[same].std(), g[other].std()), atol=1e-9)
    own = {r["label"]: r for r in O.pair_stats(df.where("part = 'a'"), "label", "vector", scope="domain").collect()}
    assert own.keys() == {0, 1, 2, None} and (own[None]["count_in"], own[None]["count_out"], own[None]["mu_out"]) == (20, 0, 0.0) and own[2]["count_out"] == 8 * 27
    nothing = df.where("part = 'b'")
    assert O.pair_stats(nothing, "label", "vector", ["part"]).count() == 0 and [tuple(r) for r in O.pair_stats(nothing, "label", "vector").collect()] == [(0.0, 0.0, 0.0, 0.0, 0, 0)]


def test_prototypes_against_plain_products(spark):
    x = np.random.default_rng(7).standard_normal((30, 4))
    field = np.array(["p", "q", "r"])[np.arange(30) % 3]
    df = spark.createDataFrame([(f, s, v.tolist()) for s in ("one", "two") for f, v in zip(field, x * (1 if s == "one" else np.arange(1, 5)))], "field string, section string, v array<double>")
    found = {(r["target"], r["section"]): r for r in O.prototype_weights(df, "field", "section", "v", 4).collect()}
    assert len(found) == 6
    for (target, s), r in found.items():
        own = x * (1 if s == "one" else np.arange(1, 5))
        p, units = own[field == target].mean(axis=0), own / np.linalg.norm(own, axis=1, keepdims=True)
        c = units @ (p / np.linalg.norm(p))
        for side, at in (("in", field == target), ("out", field != target)):
            assert np.allclose((r[f"mu_{side}"], r[f"sigma_{side}"]), (c[at].mean(), c[at].std()))


def test_lengths_near_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([3e-10, 4e-10],)], "v array<double>")
    out = df.select(V.l2_floor("v")[0].alias("floor"), V.l2_added("v")[0].alias("added"), V.l2_or_zero("v")[0].alias("zero"), V.l2_guarded("v")[0].alias("guarded"), V.cosine_or_zero("v", "v").alias("cos")).collect()
    assert [round(x, 6) for x in out[0]] == [0.6, 0.6, 0.6, 0.6, 1.0] and list(out[1]) == [0.0] * 5
    assert np.allclose(out[2], [0.03, 3e-10 / (5e-10 + 1e-8), 0.0, 0.6, 0.0])


def test_leading_components_go(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((50, 5)) * [9, 4, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    got = np.array([a["vector_out"] for a in O.remove_components(df, "vector").orderBy("id").collect()])
    p = np.linalg.svd(x, full_matrices=False)[2][:2]
    want = x - x @ p.T @ p
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-8)


def test_best_mode_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "strong", 0.5), ("b", "x", 0.1), ("b", "strong", 0.2)], "section string, mode string, separation double")
    pick = lambda **k: {r["section"]: r["mode"] for r in O.best_mode(df, ["x", "strong"], **k).collect()}
    assert pick() == {"a": "x", "b": "strong"} and pick(forced={"a": "strong"}) == {"a": "strong", "b": "strong"}


def test_unknown_modes_are_refused():
    with pytest.raises(ValueError):
        T.preprocess_section("x", "claims", "loud")
    with pytest.raises(ValueError):
        T.normalize("x", "ver3")


def test_json_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"clean_text": {"abstract": "x"}, "raw_text": {"abstract": "y", "claims": "z"}}, ensure_ascii=False))
    (tmp_path / "a" / "2.json").write_text(json.dumps({"id": "two", "description": "flat"}))
    rows = {r["doc_id"]: r for r in C.json_corpus(spark, str(tmp_path), ["a", "none"]).collect()}
    assert (rows["1"]["abstract"], rows["1"]["claims"], rows["1"]["domain"], rows["two"]["description"]) == ("x", "z", "a", "flat")
    assert C.json_corpus(spark, str(tmp_path), ["none"]).count() == 0


def test_vector_pack(spark, tmp_path):
    x = np.arange(6, dtype="float64").reshape(3, 2)
    np.savez(tmp_path / "p.npz", vectors=x, labels=np.array(["a", "b", "a"]), doc_ids=np.array(["1", "2", "3"]))
    np.savez(tmp_path / "ict_combined_embeddings.npz", vectors=x, filenames=np.array(["f", "g", "h"]))
    rows = C.npz_pack(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r["label"], r["doc_id"], list(r["vector"])) for r in rows][:2] == [("ict", "f", [0.0, 1.0]), ("ict", "g", [2.0, 3.0])] and rows[5]["doc_id"] == "3"
    assert spark.range(1).select(C.meta(F.lit('{"k": 1}'))["k"].alias("a"), F.size(C.meta(F.lit("bad"))).alias("b")).first()[0] == "1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", "1", [0.5, 0.25], 1 / 3)], "field string, doc_id string, vector array<double>, w double")
    sinks.write_embeddings(df.withColumn("file", F.col("doc_id")), f"{tmp_path}/csv", 2)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["file", "d_0", "d_1"]
    sinks.write_fused(df, f"{tmp_path}/fused", ["w"])
    assert spark.read.parquet(f"{tmp_path}/fused/vectors").where("field = 'f'").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/fused/meta").first()["w"] == "0.33333333"
    sinks.write_weights(df.drop("vector"), f"{tmp_path}/weights")
    sinks.write_records(df, f"{tmp_path}/json")
    sinks.write_calibration(df, f"{tmp_path}/calibration")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/calibration").count() == 1


def test_newest_file(spark, tmp_path):
    import os

    for i, name in enumerate(["b.json", "a.json", "c.txt"]):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + 10 * i, 1000 + 10 * i))
    assert C.newest_file(spark, str(tmp_path)).first()["path"].endswith("/a.json")


def test_hooks_have_stubs(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "x string")
    out = df.select(hooks.embedding_hook(dim=4)("x").alias("v"), hooks.text_hook(lambda xs: [f"<{x}>" for x in xs])("x").alias("t")).collect()
    assert out[1]["v"] == [0.0] * 4 and len(out[0]["v"]) == 4 and out[0]["t"] == "<a>"


def test_status_of_codes(spark):
    df = spark.createDataFrame([(1, 1, "10001"), (2, 2, "10003"), (3, 2, "DONE")], "event_id long, ts long, code string")
    last = signals.last_status(df).first()
    assert (last["code"], last["running"]) == ("DONE", False)
    assert [r[0] for r in df.select(signals.message(F.col("code"))).collect()][0] == signals.MESSAGES["10001"]


def test_streamed_status_is_the_batch_status(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, f"1000{i % 4}", i % 3) for i in range(50)], "event_id long, ts long, code string, user_id long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second goes on behind the first: a later signal of one user
        signals.start_status(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", ["user_id"]).awaitTermination()
        assert sorted(signals.read_status(spark, f"{tmp_path}/state", ["user_id"]).collect()) == sorted(signals.last_status(spark.read.parquet(f"{tmp_path}/in"), ["user_id"]).collect())
        spark.createDataFrame([(99, 9, "DONE", 1)], df.schema).write.mode("append").parquet(f"{tmp_path}/in")


def test_moments_in_levels(spark, monkeypatch):
    monkeypatch.setattr(O, "LANES", 2)
    x = np.random.default_rng(5).standard_normal((60, 3))
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>").repartition(7)
    for r in O.moments(df, ["k"], "v").collect():
        own = x[r["k"] :: 2]
        q = (own * own).sum(axis=1)
        assert r["n"] == 30 and np.allclose(r["s"], own.sum(axis=0)) and np.allclose(np.array(r["g"]).reshape(3, 3), own.T @ own) and np.allclose((r["q2"], r["q4"]), (q.sum(), (q * q).sum()))


def test_first_and_last_of_a_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 5, "u"), (None, 4, "v")], "k string, at int, what string")
    assert sorted((r["k"] or "", r["at"], r["what"]) for r in O.last_wins(df, ["k"], "at").collect()) == [("", 5, "u"), ("a", 3, "x")]
    assert sorted((r["k"] or "", r["what"]) for r in O.first_wins(df, ["k"], "at").collect()) == [("", "v"), ("a", "z")]


def test_shared_folder_is_never_one_machines(spark, monkeypatch):
    from quern.sources import shared

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        shared.shared_folder(Far)
    assert shared.shared_folder(spark)


def test_work_queue(spark, tmp_path):
    spark.createDataFrame([(1, "pending"), (2, "completed")], "id long, status string").write.parquet(f"{tmp_path}/q")
    seen = []
    signals.work_through(spark.readStream.schema("id long, status string").parquet(f"{tmp_path}/q"), lambda df, _: seen.extend(r["id"] for r in df.collect()), checkpoint=f"{tmp_path}/cp").awaitTermination()
    assert seen == [1]


def test_what_is_saved_must_be_whole(spark, tmp_path):
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "field string, W double")
    sinks.write_weights(w, f"{tmp_path}/w")
    for kind in ("parquet", "csv", "json"):
        assert sorted(map(tuple, C.for_fields(C.saved_table(spark, f"{tmp_path}/w", "field string, W double", kind), ["a", "b"]).collect())) == [("a", 0.25), ("b", 0.75)]
    with pytest.raises(FileNotFoundError, match="nothing saved for c"):
        C.for_fields(w, ["a", "c"])
    rows = [("f", 2, s) for s in C.SECTIONS] + [("f", 1, s) for s in C.SECTIONS]
    cache = spark.createDataFrame(rows, "field string, doc_id long, section string")
    assert [r["doc_id"] for r in C.whole_cache(cache).collect()] == [1] * 3 + [2] * 3
    with pytest.raises(FileNotFoundError, match="claims of 1"):
        C.whole_cache(cache.where("NOT (doc_id = 1 AND section = 'claims')"))


def test_pooling_of_states(spark):
    x = np.random.default_rng(2).standard_normal((6, 5, 4))  # layers of tokens
    r = spark.createDataFrame([(x.tolist(), [1, 1, 0, 1, 0], [0] * 5)], "l array<array<array<double>>>, m array<int>, none array<int>")
    got = r.select(V.last_layers("l", 4).alias("s"), "m", "none").select("s", V.token_mean("s", "m").alias("mean"), V.token_mean("s", "none").alias("zero"), V.norm_softmax_pool("s").alias("soft")).first()
    s = x[-4:].mean(axis=0)
    w = np.exp(np.linalg.norm(s, axis=1))
    assert np.allclose(got["s"], s) and np.allclose(got["mean"], s[[0, 1, 3]].mean(axis=0)) and got["zero"] == [0.0] * 4 and np.allclose(got["soft"], (s * w[:, None]).sum(axis=0) / w.sum())


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 3, [1.0])], "doc_id long, label int, vector array<double>").write.parquet(f"{tmp_path}/v")
    q = spark.createDataFrame([([1.0],)], "q array<double>")
    plan = S.domain_search(spark.read.parquet(f"{tmp_path}/v"), q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan


def test_job_arguments():
    assert C.job_arguments(["--text", "x"])["num_fewshots"] == 3
    with pytest.raises(SystemExit):
        C.job_arguments(["--text", "x", "--pdf", "y"])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert 0 < len(rows) <= 15 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
