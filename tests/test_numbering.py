"""Consecutive numbers over ranges, with one group that holds most rows."""

from quern.operators.numbering import numbered


def test_one_group_over_many_partitions(spark):
    rows = [("hot" if i % 10 else None if i % 20 else "a", i % 50, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "type string, path long, tie long").repartition(6)
    made = numbered(df, ["type"], ["path", "tie"])
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    found = made.collect()
    for kind in ("hot", "a", None):
        own = sorted((r["id"], r["path"], r["tie"]) for r in found if r["type"] == kind)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted((p, t) for k, p, t in rows if k == kind)


def test_the_whole_table_is_one_group_and_none_is_empty(spark):
    own = numbered(spark.range(500).repartition(4), [], ["id"], "n", 0)
    assert own.where("n <> id").count() == 0 and own.count() == 500
    assert numbered(spark.range(0), [], ["id"], "n").count() == 0
