"""Queries over whole tables and whole texts, on small tables against plain Python."""

import hashlib
import re
import unicodedata

import numpy as np

from quern.functions import text as T
from quern.plans import app, vectors
from quern.plans import text as text_plans


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


TEXTS = [
    "plain words of the land and in IN it\r\n\n\n\nend", "é ÉCOLE  of  the straße [0012] - 3 - und Ｆｕｌｌ ①", "", "청구항 1 상기 장치, 제 1 항에 있어서, 등록특허 10-12 나", "ohne\tEnde – äöü and Thé\n\n\n\n  nu",
    "한 " * 320 + "발명의 내용 상기 복수의 장치를 제공한다 " + "나 é " * 20 + "\n끝", "ligne née " * 90 + "\n\n  fin ß",
]


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def plain_basic(t):
    t = unicodedata.normalize("NFKC", t).translate({0xA0: " ", 0: " ", 13: "\n"})
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", t)).strip()


def squeezed(t):
    return re.sub(r"\s+", " ", t).strip()


def plain_clean(t, section):
    t = plain_basic(t)
    for p in [r"\[\d{4}\]", r"등록특허\s*10-\d+", r"-\s*\d+\s*-"] + [r"청구항\s*\d+", r"제\s*\d+\s*항에\s*있어서"] * (section == "claims"):
        t = re.sub(p, " ", t)
    return squeezed(t)


def without(t, phrases):
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        t = re.sub(r"\s*".join(map(re.escape, unicodedata.normalize("NFKC", p).split())), " ", t, flags=re.I)
    return squeezed(t)


def plain_description(t):
    lines = unicodedata.normalize("NFKC", t).translate({0xA0: " ", 0: " ", 13: "\n"}).split("\n")
    lines = "\n".join(x.strip() for x in lines if x.strip())
    found = [m for p in T.DESCRIPTION_STARTS if (m := re.search(p, lines, re.I))]
    own = lines[found[0].start() :].strip() if found else ""
    return own if len(own) >= 30 else lines


def test_text_rules_see_every_document_and_section(spark, tmp_path):
    save(spark, tmp_path, "documents", [(i, t, "fr") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    run = lambda name: {tuple(r)[:-1] if name == "mode_expand" else r["doc_id"]: r["hash"] for r in text_plans.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("text_basic") == {i: md5(plain_basic(t)) for i, t in enumerate(TEXTS)}
    assert run("cleanup_artifacts") == {i: md5(plain_clean(t, "claims")) for i, t in enumerate(TEXTS)}
    assert run("remove_phrases") == {i: md5(without(t, ["of the", "the", "and", "in"])) for i, t in enumerate(TEXTS)}
    want = {}
    for i, t in enumerate(TEXTS):
        for section, own in (("abstract", t[:200]), ("claims", t[200:600]), ("description", t[600:])):
            own = plain_clean(plain_description(own) if section == "description" else own, section)
            for mode in ("x", "conservative", "strong"):
                levels = {"x": [], "conservative": ["conservative"], "strong": ["conservative", "strong"]}[mode]
                phrases = [p for level in levels for p in T.SECTION_PHRASES[section][level]]
                want[section, mode, "fr", i] = md5(without(own, phrases) if levels else own)
    assert run("mode_expand") == want


def test_lookups_see_every_row(spark, tmp_path):
    d = str(tmp_path)
    langs = ["en", "fr", "de", "es", "ko", None]
    docs = [(i, "x", langs[i % 6]) for i in range(240)]
    save(spark, d, "documents", docs, "doc_id long, text string, lang string")
    save(spark, d, "embeddings", [(i, i % 7) for i in range(260)], "vec_id long, label int")
    save(spark, d, "labels", [(i, 1, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    run = lambda name: {tuple(r) for r in app.QUERIES[name](spark, d).collect()}
    assert run("index_scan") == {(i, f"f{i}", i % 7) for i in range(240)}
    assert run("text_lookup") == {(i, 1, 0) if i % 3 == 0 else (i, -1, -1) for i in range(260)}
    assert run("vertical_stack") == {(x, 40) for x in langs}
    known = {r[1:] for r in run("missing_sections") if r[0]}
    assert known == {(i, s) for i in range(240) if langs[i % 6] for s in ("abstract", "claims", "description") if s != ("abstract", "claims")[i % 2]}


def test_element_sets_of_whole_texts(spark, tmp_path):
    texts = ["a b " * 100 + "shared own0 é", "c " * 300 + "shared\nb own1", "shared own2 " + "é " * 200 + "b"]
    save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    w = [set(t.split()) for t in texts]
    got = {r["doc_id"]: (r["both"], r["only"]) for r in app.QUERIES["element_sets"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(w[i] & w[i + 1]), len(w[i] - w[i + 1])) for i in range(2)}


def vectors_table(spark, folder, n=450):
    x = np.random.default_rng(3).standard_normal((n, 64))
    x[400:] += 1.5  # the last ids differ from the first 400
    save(spark, folder, "embeddings", [(i, v.tolist(), i % 6) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    return x


def test_query_fusion_takes_every_vector(spark, tmp_path):
    x = vectors_table(spark, tmp_path)
    got = vectors.QUERIES["query_fusion"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(x)))
    weights = spark.createDataFrame([(i, 1.0, 0.0, 0.0) for i in range(6) if i != 5], "label int, w_abstract double, w_claims double, w_description double")
    fused = {r["doc_id"]: r["first"] for r in vectors.fused_queries(vectors.aligned(spark, str(tmp_path)), weights).collect()}
    parts = []
    for at in vectors.SECTIONS.values():
        p = x[:, at - 1 : at - 1 + vectors.SECTION_DIM]
        parts.append(p[:, 0] / np.linalg.norm(p, axis=1))
    want = [sum(p[i] for p in parts) / 3 if i % 6 == 5 else parts[list(vectors.SECTIONS).index("abstract")][i] for i in range(len(x))]
    assert np.allclose([fused[i] for i in range(len(x))], want, atol=1e-5)


def test_cosine_quantiles_see_every_vector(spark, tmp_path):
    x = vectors_table(spark, tmp_path)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = (u @ u.T)[np.triu_indices(len(u), 1)]
    got = vectors.QUERIES["cosine_quantiles"](spark, str(tmp_path)).first()
    assert abs(got["mean"] - cos.mean()) < 1e-5 and abs(got["std"] - cos.std()) < 1e-5
    assert all(abs((cos <= got[n]).mean() - p) < 0.02 for n, p in (("q01", 0.01), ("q05", 0.05), ("q50", 0.5), ("q95", 0.95), ("q99", 0.99)))
