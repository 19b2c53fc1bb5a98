"""Every operator on empty tables, and on nulls, blanks, repeated rows, ties, a very long text and clashing column names."""

import pytest
from pyspark.sql import functions as F

from quern.llm import (
    best_fit_packing,
    embedding_near_dedup,
    exact_top_k,
    line_dedup,
    lm_scoring,
    quality_classifier,
    sentencepiece_codec,
    simhash_near_dedup,
    substring_dedup,
    toxicity,
)

DOCS = "doc_id long, text string, score double, _dropped string, _covered string, label int, n_chars long"
LABELS = "doc_id long, quality int, toxic int, extra string"
VECTORS = "vec_id long, embedding array<float>, label int, rep long, component string"
BIG = 2**60 + 1
TEXTS = [
    (1, "the cat sat on the mat. it slept all day long and nobody minded it at all in that warm house by the sea of glass."),
    (1, "the cat sat on the mat. it slept all day long and nobody minded it at all in that warm house by the sea of glass."),
    (2, "the cat sat on the mat. it slept all day long and nobody minded it at all in that warm house by the sea of glass."),
    (3, None), (4, ""), (5, " \n\t "), (6, "you are a stupid idiot"), (7, "word " * 30000), (None, "a row without an id"), (BIG, "ünï ▁ \x00 😀 end\r\nof"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 1, len(t) if t is not None else None) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 6), "z") for i, _ in TEXTS if i is not None] + [(None, 1, 1, "z"), (4, None, None, "z")], LABELS)


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (40, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (60, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None),
            (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (BIG, [-1.0, 0.0], 1), (80, [3e38, 3e38], 1)]
    return spark.createDataFrame([(i, v, lab, 7, "c") for i, v, lab in rows], VECTORS)


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_codec(spark, docs):
    rows = by_id(sentencepiece_codec.encode_decode(docs), "n_pieces", "round_trip")
    assert len(rows) == len(TEXTS) and {r[0] for r in rows} == {i for i, _ in TEXTS}
    assert all(r[2] for r in rows if r[0] != BIG) and [r[1] for r in rows if r[0] in (3, 4)] == [0, 0]
    back = dict(by_id(sentencepiece_codec.decode(sentencepiece_codec.encode(docs)), "text"))
    assert back[6] == "you are a stupid idiot" and back[3] == ""
    assert sentencepiece_codec.encode_decode(spark.createDataFrame([], DOCS)).count() == 0


def test_lm(spark, docs):
    rows = by_id(lm_scoring.score(docs), "n_tokens", "held_out")
    assert len(rows) == len(TEXTS) and dict((r[0], r[1]) for r in rows)[7] == 30001
    assert [r[1] for r in rows if r[0] in (3, 4, 5)] == [1, 1, 1] and BIG in {r[0] for r in rows}
    assert [r[2] for r in rows if r[0] is None] == [False]
    assert lm_scoring.score(spark.createDataFrame([], DOCS)).count() == 0


def test_top_k(spark, vectors):
    rows = exact_top_k.top_k(vectors, vectors.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    found = {q: [(r["vec_id"], r["score"]) for r in rows if r["query_id"] == q] for q in {r["query_id"] for r in rows}}
    assert found[20][0][0] == 80 and found[20][1] == (3, 4096) and found[20][2] == (9, 4096) and 60 not in found
    empty = spark.createDataFrame([], VECTORS)
    assert exact_top_k.top_k(empty, empty).count() == 0 and exact_top_k.top_k(vectors, empty).count() == 0


def test_embedding_near_dedup(spark, vectors):
    rows = {r["vec_id"]: r for r in embedding_near_dedup.near_duplicates(vectors, passes=4).collect()}
    assert len(rows) == 15 and (rows[20]["n_links"], rows[40]["component_id"], rows[3]["n_links"]) == (2, 3, 2)
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in (4, 5, 6, 8, 9, 10, 11, 12, 60, BIG))
    assert rows[None]["n_links"] == 0 and not rows[None]["kept"] and rows[3]["kept"] and not rows[40]["kept"]
    assert embedding_near_dedup.near_duplicates(spark.createDataFrame([], VECTORS), passes=2).count() == 0


def test_toxicity(spark, docs, labels):
    rows = by_id(toxicity.score(docs, labels), "score", "predicted")
    assert len(rows) == len(TEXTS) and dict((r[0], r[1]) for r in rows)[6] == max(r[1] for r in rows)
    clean = toxicity.clean(docs, labels, threshold=max(r[1] for r in rows))
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 1
    empty = spark.createDataFrame([], LABELS)
    assert toxicity.score(docs, empty).count() == len(TEXTS) and toxicity.score(spark.createDataFrame([], DOCS), labels).count() == 0


def test_quality(spark, docs, labels):
    rows = by_id(quality_classifier.classify(docs, labels), "score", "predicted", "held_out")
    assert len(rows) == len(TEXTS) and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.7) for r in rows)
    of = {i: [r[1:] for r in rows if r[0] == i] for i, _ in TEXTS}
    assert of[3][0][0] == of[4][0][0] and len(set(of[1])) == 1 and of[1][0][0] == of[2][0][0] and [r[2] for r in of[None]] == [False]
    learner = quality_classifier.classify(docs, labels.where("doc_id <> 7"))
    assert len({r["score"] for r in learner.where("doc_id IN (1, 2)").collect()}) == 1 and learner.where("doc_id = 7 AND score BETWEEN 0 AND 1").count() == 1
    assert {r["score"] for r in quality_classifier.classify(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality_classifier.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_packing(spark, docs):
    rows = best_fit_packing.pack(docs).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] in (3, 4, 5)) == [1, 1, 1] and sum(r["doc_id"] == 7 for r in rows) == 8
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}
    assert best_fit_packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash(spark, docs):
    rows = by_id(simhash_near_dedup.near_duplicates(docs), "fp", "component_id")
    assert [r[1:] for r in rows if r[0] in (3, 4, 5)] == [(0, 3)] * 3 and [r[2] for r in rows if r[0] == 2] == [1]
    kept = simhash_near_dedup.dedup(docs)
    assert kept.columns == docs.columns and [r[0] for r in by_id(kept)] == [1, 1, 3, 6, 7, BIG, None]
    assert simhash_near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("operator", [line_dedup, substring_dedup])
def test_text_dedup(spark, docs, operator):
    out = operator.dedup(docs)
    rows = by_id(out, "text", "n_chars", "_dropped", "_covered")
    assert out.columns == docs.columns and len(rows) == len(TEXTS) and all(r[3:] == ("x", "y") for r in rows)
    texts = {r[0]: r[1] for r in rows}
    assert texts[1] == TEXTS[0][1] and texts[2] == "" and texts[3] is None and texts[BIG] == TEXTS[-1][1]
    assert texts[7] == TEXTS[7][1] if operator is line_dedup else True
    assert all(r[2] == (None if r[1] is None else len(r[1])) for r in rows)
    assert operator.dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hub", [256, 3])
def test_components(spark, monkeypatch, hub):
    from quern.llm import common
    from quern.llm.common import components

    monkeypatch.setattr(common, "HUB", hub)
    n = 300 if hub > 3 else 40
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7000, 7001), (7001, 7000)] + [(3000 + i, 9000) for i in range(50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(n + 1)} == {0} and {found[1000 + i] for i in range(200)} == {1000} and found[7001] == 7000 and found[9000] == found[3049] == 3000 and len(found) == n + 203 + 51
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
