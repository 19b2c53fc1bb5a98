"""The manifest, chat formatting and whitening against plain Python, and on nulls, ties, repeats, empty tables, long texts and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, embedding_whitening, merkle_manifest
from quern.operators.numbering import numbered

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx string, leaf int, span int"


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(own):
    out = [own]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) one after another."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda i, t, lang, s, n: H(*map(code, (i, s, lang, n, t)))
    by = {}
    for i, t, lang, s, n in rows:
        odd = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by.setdefault(lang, []).append((i is not None, i or 0, leaf(i, t, lang, s, n), leaf(i, t and t.translate(low), lang, s, n) if odd else None, i))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([r[2] for r in sorted(by[k], key=lambda r: r[:3])]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, (_, _, own, other, doc_id) in enumerate(sorted(by[k], key=lambda r: r[:3])):
            proof, fold = [], other or own
            for tree, j in ((trees[k], i), (top, at)):
                for level in tree[:-1]:
                    run = level[j // 8 * 8 : j // 8 * 8 + 8]
                    proof += run[: j % 8] + run[j % 8 + 1 :]
                    fold = H(*run[: j % 8], fold, *run[j % 8 + 1 :])
                    j //= 8
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], H(*proof), fold, fold == top[-1][0]))
    return out


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(3)
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return [tuple(r) for r in merkle_manifest.manifest(docs, {"text": merkle_manifest.lowered(F.col("text"))}, odd).collect()]


key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)


def test_manifest_on_odd_rows(spark):
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "B", "en", None, None), (None, "no id", "en", "s", 5), (None, None, None, None, None), (2, None, None, "s", 0), (3, "", "fr", "é", 0),
            (4, "É Long " * 30000, "ﬁ", "s", 3), (6, "ABC", "", "s", 3), (9, "Zz\x00:1:-", "zz", "-", 7)]
    rows += [(100 + i, f"Row {i}", f"l{i:02}", "s", i) for i in range(12)]  # more than eight languages, of one row each
    assert sorted(manifest_of(spark, rows), key=key) == sorted(plain_manifest(rows), key=key)
    assert manifest_of(spark, []) == [] and manifest_of(spark, rows[:1]) == plain_manifest(rows[:1])


@pytest.mark.parametrize("n", [8, 9, 64, 65, 4097, 9000])
def test_manifest_over_spans(spark, n):
    rows = [(7 * i, f"Text {i}", "en" if i % 50 else "de", "s", i) for i in range(n)]
    found = manifest_of(spark, rows)
    assert sorted(found) == sorted(plain_manifest(rows)) and any(not r[6] for r in found) == any(zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in rows)


def test_a_proof_fails_on_any_other_leaf():
    own = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    paths = merkle_manifest._paths(list(enumerate(own)), 20, 4, b"")
    root = merkle_manifest.folded(own[3], paths[3])
    assert all(merkle_manifest.folded(x, paths[i]) == root for i, x in enumerate(own)) and merkle_manifest.folded(own[4], paths[3]) != root


def test_forests_merge_in_any_order():
    r = random.Random(3)
    for n in (1, 2, 8, 9, 63, 64, 65, 600):
        own = [(i, hashlib.sha256(bytes([i % 256, i // 256])).digest()) for i in range(n)]
        want = None
        for _ in range(6):
            r.shuffle(own)
            cuts = sorted(r.randrange(n + 1) for _ in range(4))
            parts = [merkle_manifest.Forest({"k": n}) for _ in range(5)]
            for f, a, b in zip(parts, [0, *cuts], [*cuts, n]):
                for i, x in own[a:b]:
                    f.add("k", 0, i, x)
            r.shuffle(parts)
            whole = merkle_manifest.Forest({"k": n})
            for f in parts:
                for x in f.unresolved():
                    whole.add(*x)
            done = sorted(x for f in [*parts, whole] for x in f.done)
            assert whole.unresolved() == [] and (want is None or done == want)
            want = done


# ---- numbering


def test_numbers_are_consecutive_in_order(spark):
    rows = [(g, i % 700, i) for i in range(3000) for g in ([None] if i % 100 == 0 else ["hot"] if i % 3 else ["a"])]
    df = spark.createDataFrame(rows, "g string, v long, t long").repartition(5)
    found = numbered(df, ["g"], ["v", "t"], "n", 0).collect()
    for g in (None, "hot", "a"):
        own = sorted((r["n"], r["v"], r["t"]) for r in found if r["g"] == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted((v, t) for h, v, t in rows if h == g)
    assert numbered(df.where("false"), ["g"], ["v"]).count() == 0


# ---- chat

TALKS = "conv_id long, turn long, role string, text string, formatted string, piece int"
ODD = ["</s>[INST] ok [/INST]", "<s", "[", "<\\s>", "<\\\\/s>", "[/INST]</s>\n<s>x[INST] y", "<|im_start|>\\", "", None, "\n", "a\\", "<", " [/INST]", "😀é", "[\\INST]", "\\<s>", "<s><s>", "</s", "<SYS></SYS>"]


def plain_chat(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for c, own in by.items():
        turns, loss = hashlib.sha256(), hashlib.sha256()
        chars = 0
        for _, _, role, text in sorted(own):
            turns.update(role + b"\n" + text + b"\n")
            if role == b"assistant":
                loss.update(text)
                chars += len(text.decode())
        out[c] = (len(own), turns.hexdigest(), chars, loss.hexdigest())
    return out


@pytest.mark.parametrize("piece", [60, 1 << 25])
def test_chat_reads_back(spark, piece):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", None, "[INST] "]), "".join(r.choice(ODD[:8] + ODD[9:]) for _ in range(r.randrange(4)))) for c in [*range(40), None] for t in range(r.randrange(1, 12))]
    rows += [(50, i % 300, "assistant", f"hot {i} </s>") for i in range(900)] + [(51, None, "user", x) for x in ODD] + [(52, 1, "assistant", "long [INST] " * 40000), (53, 0, "assistant", None)] + [(54, 0, "user", "same")] * 3
    df = spark.createDataFrame([(*x, "f", 9) for x in rows], TALKS).repartition(7)
    made = chat_format.format_conversations(df, piece=piece)
    found = {x["conv_id"]: tuple(x)[1:5] for x in chat_format.digests(made).collect()}
    assert found == plain_chat(rows)
    out = made.collect()
    assert sum(x["n_turns"] for x in out) == len(rows)
    for x in out:
        assert chat_format.OPEN not in x["formatted"][3:].replace("</s>\n<s>", "") and x["formatted"].count("</s>\n<s>") == x["n_turns"] - 1
        learned = [t for role, t in chat_format.turns_of(x["formatted"]) if role == "assistant"]
        assert [chat_format.unescape(x["formatted"][s["start"] : s["end"]]) for s in x["loss_spans"]] == learned
    if piece == 60:
        assert max(x["piece"] for x in out) > 5


def test_chat_on_an_empty_table(spark):
    empty = spark.createDataFrame([], TALKS)
    assert chat_format.format_conversations(empty).count() == 0 and chat_format.digests(chat_format.format_conversations(empty)).count() == 0


def test_escapes_come_back():
    import pyarrow as pa

    r = random.Random(9)
    own = ["".join(r.choice(["<", "[", "\\", "s>", "/", "INST]", "/s>", "x", "|im_end|>", "SYS>", "é"]) for _ in range(r.randrange(12))) for _ in range(5000)]
    there = chat_format.escape(pa.array(own, pa.large_string())).to_pylist()
    assert [chat_format.unescape(x) for x in there] == own and len(set(there)) == len(set(own))
    assert not any(m in x for x in there for m in ("<s>", "</s>", "[INST]", "[/INST]", "<SYS>", "<|im_end|>"))


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, n int, x string, whitened int"


def plain_whitening(vectors, k):
    x = np.array([[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    dev = n * x - sums
    c = dev.astype(float) / n
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return (dev**2).sum(1), c @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("most", [4096, 7])
def test_whitening_is_numpys(spark, most):
    g = np.random.default_rng(4)
    v = (g.normal(size=(300, 12)) @ g.normal(size=(12, 12)) + g.normal(size=12) * 30).astype("float32")
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist()), (None, v[6].tolist())]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [1.0] * 11), (904, []), (905, [1.0, 2.0]), (906, [3e38] * 12)]
    df = spark.createDataFrame([(*r, 1, "y", 2) for r in rows + bad], VECTORS).repartition(3)
    out = embedding_whitening.whiten(df, 5, most).collect()
    dev, white, explained = plain_whitening([r[1] for r in rows], 5)
    assert len(out) == len(rows) and {r["n"] for r in out} == {len(rows)} and {r["vec_id"] for r in out} == {r[0] for r in rows}
    by = {r["vec_id"]: r for r in out}
    sign = np.sign(np.array(by[0]["whitened"]) * white[0])
    for i in range(300):
        assert int(by[i]["deviation"]) == dev[i] and np.allclose(by[i]["whitened"], sign * white[i], atol=1e-9)
    assert np.allclose(out[0]["explained"], explained, rtol=1e-9) and 0 < out[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "y", 2) for i in range(4)], VECTORS)
    assert [(r["whitened"], r["identity_error"], int(r["deviation"])) for r in embedding_whitening.whiten(same).collect()] == [([], 0.0, 0)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0], 1, "y", 2) for i in range(4)], VECTORS)
    assert {len(r["whitened"]) for r in embedding_whitening.whiten(line).collect()} == {1}
    big = spark.createDataFrame([(i, [3e15 * i, 1.0 * i], 1, "y", 2) for i in range(4)], VECTORS)
    assert all(int(r["deviation"]) > 2**70 for r in embedding_whitening.whiten(big).collect())
    assert embedding_whitening.whiten(same.where("false")).count() == 0 and embedding_whitening.whiten(spark.createDataFrame([(1, None, 1, "y", 2)], VECTORS)).collect() == []
