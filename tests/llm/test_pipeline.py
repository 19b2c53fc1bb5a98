"""The pipeline's stages, one behind the other, against plain Python, and each of them on odd tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from test_against_brute_force import jaccard_kept, plain_dedup, roots, texts

import corpus_pipeline
from quern.llm import best_fit_packing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


def tables(spark, folder, docs, labels, schema=DOCS):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def simhash_kept(rows):
    def fingerprint(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [fingerprint(t) for _, t in rows]
    low = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    return [r for i, r in enumerate(rows) if low[i] == i]


def test_stages_are_those_of_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(31)
    own = texts(90, seed=8)
    passage = " ".join(r.choice(own[0].split()) for _ in range(60))
    docs = own + [own[5], own[6] + "\nx"] + [" ".join(t.split()) + f" {passage}" for t in own[10:14]] + ["you are a stupid idiot. " + own[20], "", "\n \n", own[5].upper()]
    docs = list(enumerate(docs))
    labels = [(i, 1, int(t.startswith("you are a"))) for i, t in docs if i % 2 == 0 or t.startswith("you are a")]
    d = tables(spark, tmp_path, [(i, t, "en", "web", len(t)) for i, t in docs], labels)
    found, out = {}, spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = out.columns
        stage(spark, out, d).write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        found[name] = out.collect()
        assert name == NAMES[-1] or out.columns == columns
    grammar = toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scores = grammar.score([t for _, t in docs])
    want = [(i, t) for (i, t), s in zip(docs, scores) if s < toxicity.THRESHOLD]
    assert any(t.startswith("you are a") for i, t in docs if (i, t) not in want)
    for name, plain in zip(NAMES, (lambda x: x, lambda x: jaccard_kept(x)[0], simhash_kept, plain_dedup)):
        before = want
        want = sorted(plain(want))
        assert sorted((x["doc_id"], x["text"]) for x in found[name]) == want, name
        assert name == NAMES[0] or want != before
        assert all(x["n_chars"] == len(x["text"]) for x in found[name])
    encode = Tokenizer.from_file(best_fit_packing.default_tokenizer()).encode
    pieces = sorted((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in found[NAMES[-1]])
    ids = {i: [*encode(t, add_special_tokens=False).ids, 1] for i, t in want}
    assert pieces == sorted((i, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "piece", "length", "ids_crc32").collect())) == pieces


ODD = "doc_id long, text string, score double, label int, lines string, covered string, row int, nth int, doubled string"
ROWS = [(1, "a line of words\nanother one here", 0.5, 1, "x", "y", 2, 3, "z"), (1, "a line of words\nanother one here", 0.5, 1, "x", "y", 2, 3, "z"), (1, "other words under the same id", 0.5, 1, "x", "y", 2, 3, "z"), (2, None, None, 1, "x", "y", 2, 3, "z"),
        (3, "", 0.5, None, "x", "y", 2, 3, "z"), (4, " \n\t ", 0.5, 1, None, "y", 2, 3, "z"), (None, "no id at all", 0.5, 1, "x", None, None, 3, "z"), (5, "word " * 20_000, 0.5, 1, "x", "y", 2, None, None)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_tables(spark, tmp_path, name, stage):
    """Nulls in any column, empty and long texts, rows and ids that repeat, names that stages use themselves, no n_chars; and an empty table."""
    d = tables(spark, tmp_path, ROWS, [(1, 1, 0), (None, 1, 1), (3, None, None)], ODD)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = stage(spark, docs, d)
    rows = out.collect()
    if name == NAMES[-1]:
        assert {x["doc_id"] for x in rows} == {x[0] for x in ROWS}
    else:
        assert out.columns == docs.columns
        kept = [x for x in ROWS if name != NAMES[2] or x[0] not in (3, 4)]  # blank texts have one fingerprint
        assert sorted(map(repr, (tuple(x)[2:] for x in rows))) == sorted(repr(x[2:]) for x in kept)
        texts_ = {(x["doc_id"], x["text"]) for x in rows}
        assert {(1, ROWS[0][1]), (1, ROWS[2][1]), (2, None), (None, "no id at all")} <= texts_
    assert stage(spark, spark.createDataFrame([], ODD), d).count() == 0
