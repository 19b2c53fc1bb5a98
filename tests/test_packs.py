"""Vector packs: ranges, offsets, compressed members, labels by name, and the filter that the source takes over."""

import numpy as np

from quern.sources import packs


def test_packs_are_read_in_parts(spark, tmp_path):
    g = np.random.default_rng(1)
    x = g.normal(size=(1000, 7)).astype("float32")
    label = np.array([f"l{i % 3}" for i in range(1000)])
    np.savez(tmp_path / "a.npz", vectors=x, labels=label, doc_ids=np.arange(1000))
    np.savez_compressed(tmp_path / "b.npz", vectors=x[:500].astype("float64"), labels=label[:500], doc_ids=np.array([f"é{i}" for i in range(500)]))
    np.savez(tmp_path / "ai_combined_embeddings.npz", vectors=x[:10], filenames=np.array([f"f{i}" for i in range(10)]))
    np.savez(tmp_path / "none.npz", vectors=x[:0], labels=label[:0], doc_ids=label[:0])
    df = packs.read_packs(spark, str(tmp_path), rows="64")
    assert df.rdd.getNumPartitions() == 16 + 8 + 1
    rows = {(r["path"], r["pos"]): r for r in df.collect()}
    assert len(rows) == 1510
    for i in range(1000):
        r = rows["a.npz", i]
        assert (r["label"], r["doc_id"]) == (label[i], str(i)) and np.array_equal(np.float32(r["vector"]), x[i])
    assert rows["b.npz", 499]["doc_id"] == "é499" and np.array_equal(np.float32(rows["b.npz", 499]["vector"]), x[499])
    assert (rows["ai_combined_embeddings.npz", 9]["label"], rows["ai_combined_embeddings.npz", 9]["doc_id"]) == ("ai", "f9")


def test_the_label_filter_reaches_the_source(spark, tmp_path):
    np.savez(tmp_path / "ai_combined_embeddings.npz", vectors=np.ones((4, 2)), filenames=np.arange(4))
    np.savez(tmp_path / "bio_combined_embeddings.npz", vectors=np.ones((5, 2)), filenames=np.arange(5))
    df = packs.read_packs(spark, str(tmp_path)).where("label = 'bio' AND pos > 1")
    assert df.count() == 3 and df.rdd.getNumPartitions() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "label" not in plan.split("Filter", 1)[1].split("\n")[0]  # only pos is left to Spark
    reader = packs.PackReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([packs.EqualTo(("label",), "bio")])) == [] and [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["bio_combined_embeddings.npz"]


def test_written_packs_come_back(spark, tmp_path):
    rows = [(i % 2, i, [float(i), 1.0]) for i in range(50)] + [(None, 60, [1.0, 1.0]), (1, 61, None)]
    df = spark.createDataFrame(rows, "label int, doc_id long, vector array<float>").repartition(3)
    assert packs.write_packs(df, f"{tmp_path}/p", 8) == 50
    assert sorted((r["label"], int(r["doc_id"]), r["vector"]) for r in packs.read_packs(spark, f"{tmp_path}/p").collect()) == sorted((str(a), b, c) for a, b, c in rows[:50])
    assert packs.write_packs(df.where("false"), f"{tmp_path}/q") == 0
