"""Operators against plain Python over small inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

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
    words,
)


def texts(n=120, seed=3, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(2, 7))) for _ in range(words)]
    out = []
    for i in range(n):
        if i % 4 == 3 and out:  # a near copy
            w = out[-1].split(" ")
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", " ", ". ", ", ", ".\n"]) for _ in range(r.randrange(5, 160))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")


def roots(n, pairs):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_codec_is_the_librarys():
    import sentencepiece

    path = sentencepiece_codec.default_model()
    own, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    odd = ["".join(r.choice(" abthe\n\tAéß▁😀梦0.,!<s>") for _ in range(r.randrange(30))) for _ in range(800)] + texts() + ["", " ", "     a"]
    ids = own.encode(odd)
    assert [i.tolist() for i in ids] == library.encode(odd)
    assert [own.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]


def test_unigram_ids_are_the_librarys(tmp_path):
    """A unigram vocabulary written by hand: forward scores by Viterbi, ids as the library's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    r, m = random.Random(17), sentencepiece_model_pb2.ModelProto()
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    for piece, t in (("<unk>", kind.UNKNOWN), ("<s>", kind.CONTROL), ("</s>", kind.CONTROL)):
        m.pieces.add(piece=piece, score=0.0, type=t)
    own = dict.fromkeys(["▁", *"abcdé"])
    while len(own) < 200:
        own["".join(r.choice("▁" if k == 0 and r.random() < 0.3 else "abcdé") for k in range(r.randrange(2, 8)))] = None
    for piece in own:
        m.pieces.add(piece=piece, score=-r.uniform(1, 3) - 1.3 * len(piece), type=kind.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 1, 0, 1, 2, -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    (tmp_path / "unigram.model").write_bytes(m.SerializeToString())
    codec, library = sentencepiece_codec.Codec(f"{tmp_path}/unigram.model"), sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/unigram.model")
    assert not codec.merges
    odd = ["".join(r.choice("aabbcdé ") for _ in range(r.randrange(40))) for _ in range(1500)]
    ids = codec.encode(odd)
    assert [i.tolist() for i in ids] == library.encode(odd) and [codec.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]


def test_codec_takes_unigram_scores():
    own = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    own.merges, own.scores = False, {"a": -1.0, "b": -1.0, "ab": -1.5, "abb": -2.6, "bb": -1.2}
    assert dict(own.encode_words(["ab", "abb", "abba"])) == {"ab": ["ab"], "abb": ["a", "bb"], "abba": ["a", "bb", "a"]}


def test_lm_scores(spark, docs, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 9000)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in enumerate(texts())}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in tokens}
    train = [i for i in tokens if fold[i] != 1]

    def counts(own):
        one = Counter(w for i in own for w in tokens[i])
        return one, Counter(p for i in own for p in zip(["start", *tokens[i]], tokens[i])), one[None]

    c, c2, ends = counts(train)
    n, v = sum(c.values()), len(c)
    # the weights: the deleted fold's tokens by the bucket of their context and the cells of both ratios
    k, k2, k_ends = counts([i for i in train if fold[i] != 2])
    k_n, k_v = sum(k.values()), len(k)
    bucket = lambda x: min(int(x).bit_length(), lm_scoring.BUCKETS - 1)
    cell = lambda x: round(math.log(x * (k_v + 1)) / lm_scoring.CELL) if x else -(2**15)
    cells = Counter()
    for i in (i for i in train if fold[i] == 2):
        for u, w in zip(["start", *tokens[i]], tokens[i]):
            context = k_ends if u == "start" else k[u]
            cells[bucket(context), cell(k[w] / k_n), cell(k2[u, w] / context if context else 0)] += 1
    weights = lm_scoring.expect(pd.DataFrame([(*x, m) for x, m in sorted(cells.items())], columns=["b", "one", "two", "n"]))
    for i, ws in tokens.items():
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(w in c for w in ws) and got[i]["train_tokens"] == n and got[i]["held_out"] == (i not in train)
        assert abs(got[i]["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-9
        score = 0
        for u, w in zip(["start", *ws], ws):
            context = ends if u == "start" else c[u]
            a = weights[bucket(context)]
            score += math.log10(a[0] / (v + 1) + a[1] * c[w] / n + (a[2] * c2[u, w] / context if context else 0))
        assert abs(got[i]["score"] - score) < 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_exchange_is_linear(spark, docs, monkeypatch):
    """However small the blocks, they send no more rows than they have distinct n-grams, and each of these once."""
    sent, keys = [], []
    for size in (20_000, 2000, 200):
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", size)
        own, n, _ = lm_scoring.blocks(docs)
        rows = lm_scoring.asked(own, max(3, (n - 1).bit_length())).selectExpr("block", "kind", "length(keys) AS n").collect()
        sent.append(len(rows))
        keys.append(sum(r["n"] for r in rows) // 8)
        assert sent[-1] <= keys[-1] and len({(r["block"], r["kind"]) for r in rows}) * 8 <= 2 * n * 8
    assert keys[-1] <= sum(2 * len(t.split()) + 2 for t in texts())


@pytest.mark.parametrize("below, most", [(1024, 1024), (60, 8)])
def test_top_k(spark, monkeypatch, below, most):
    monkeypatch.setattr(exact_top_k, "CANDIDATES", 300 if below > 60 else 40)
    monkeypatch.setattr(exact_top_k, "QUERIES", 8192 if below > 60 else 20)
    monkeypatch.setattr(exact_top_k, "BELOW", below)
    monkeypatch.setattr(exact_top_k, "PIVOTS", most)
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (900, 6)) / 8.0  # many ties and equal vectors
    x[300:400] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(a["query_id"], a["rank"]): (a["vec_id"], a["score"]) for a in exact_top_k.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()}
    z = np.floor(64 * x).astype(int)
    for q in range(0, 900, 20):
        best = sorted((-int(z[q] @ z[i]), i) for i in range(900) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -s) for s, i in best]


def test_top_k_avoids_products_on_clusters(spark, monkeypatch):
    """On clustered vectors a query goes on to few pivots, and few products are made below these."""
    monkeypatch.setattr(exact_top_k, "BELOW", 100)
    r = np.random.default_rng(3)
    centers = r.standard_normal((40, 16)) * 4
    x = np.floor(64 * (centers[np.arange(4000) % 40] + 0.05 * r.standard_normal((4000, 16))))
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, real = [], exact_top_k.onward
    monkeypatch.setattr(exact_top_k, "onward", lambda *a: sent.append(real(*a)) or sent[-1])
    got = {(a["query_id"], a["rank"]): a["score"] for a in exact_top_k.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()}
    for q in range(0, 4000, 20):
        assert [got[q, k + 1] for k in range(5)] == sorted((np.delete(x, q, 0) @ x[q]).astype(int).tolist(), reverse=True)[:5]
    assert sent[0].count() <= 3 * 200  # of 40 pivots, a query is sent on to three at most on average
    root, work = exact_top_k.build(x, np.arange(len(x)), x.mean(axis=0), np.random.default_rng(7)), [0]
    own = np.arange(0, 4000, 20)
    found = exact_top_k.search_group(root, x.mean(axis=0), x[own], [[i] for i in range(len(x))], own, 5, np.full(200, -np.inf), work)
    assert work[0] < 0.2 * 200 * len(x)
    for q, best in zip(own, found):
        assert sorted(s for s, _ in best) == sorted((np.delete(x, q, 0) @ x[q]).astype(int))[-5:]


def test_top_k_of_groups(monkeypatch):
    """Groups of queries against all rows: ties, ids of several vectors, vectors of several ids, floors, fewer rows than k."""
    monkeypatch.setattr(exact_top_k, "TOGETHER", 7)
    r = np.random.default_rng(9)
    for n, page, k in ((1, 4, 3), (5, 4, 9), (300, 4, 6), (300, 64, 6), (200, 8, 20)):
        x = r.integers(-3, 4, (n, 3)).astype(float)
        x = np.unique(x, axis=0)
        ids = [sorted(r.choice(60, r.integers(1, 4), replace=False).tolist()) for _ in x]
        root = exact_top_k.build(x, np.arange(len(x)), x.mean(axis=0), np.random.default_rng(7), page)
        q, own = r.integers(-3, 4, (40, 3)).astype(float), r.integers(0, 60, 40)
        all_of = [sorted(((int(v @ w), -i) for w, each in zip(x, ids) for i in each if i != o), reverse=True) for v, o in zip(q, own)]
        floors = np.array([-np.inf if j % 2 else (all_of[j][min(k, len(all_of[j])) - 1][0] if all_of[j] else 0) for j in range(40)], float)
        for f in (np.full(40, -np.inf), floors):
            got = exact_top_k.search_group(root, x.mean(axis=0), q, ids, own, k, f)
            for best, every, least in zip(got, all_of, f):
                assert sorted(best, key=lambda y: (-y[0], y[1])) == [(s, -i) for s, i in every if s >= least][:k]


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in simhash_near_dedup.near_duplicates(docs).collect()}

    def brute(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [brute(t) for t in texts()]
    assert all(got[i]["fp"] % 2**64 == f for i, f in enumerate(fp))
    low = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert [got[i]["component_id"] for i in range(len(fp))] == low


@pytest.mark.parametrize("together", [20_000, 64])
def test_pigeonring_finds_every_link(spark, monkeypatch, together):
    monkeypatch.setattr(simhash_near_dedup, "TOGETHER", together)
    r = random.Random(4)
    fps = []
    for _ in range(40):
        base = r.getrandbits(64)
        fps.append(base)
        for _ in range(12):
            x = base
            for _ in range(r.randrange(0, 7)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    dense = r.getrandbits(64)
    fps += [dense ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)][:700]
    fps = list(dict.fromkeys(fps))
    reps = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    from quern.llm.common import components

    found = {a["node"]: a["component"] for a in components(simhash_near_dedup.links(reps)).collect()}
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    low = roots(len(fps), [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))])
    assert [found.get(i, i) for i in range(len(fps))] == low


def apart(rows):
    """(doc_id, nth, text) of rows, as Spark hashes texts."""
    several = {i for i in {i for i, _ in rows} if len({t for j, t in rows if j == i}) > 1}
    return [(i, int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64)) if i in several else 0, t) for i, t in rows]


def jaccard_kept(rows):
    """The rows (doc_id, text) without the lines that match one before them."""
    own = apart(rows)
    lines = sorted({(i, h, k, frozenset(w)) for i, h, t in own for k, w in enumerate(x.split() for x in t.encode().lower().split(b"\n"))}, key=lambda x: x[:3])
    gone = set()
    for at, (i, h, k, s) in enumerate(lines):
        if s and any(q and 5 * len(q & s) >= 4 * len(q | s) for *_, q in lines[:at]):
            gone.add((i, h, k))
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, h, k) not in gone)) for i, h, t in own), gone


@pytest.mark.parametrize("together", [20_000, 32])
def test_line_dedup(spark, monkeypatch, together):
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    monkeypatch.setattr(line_dedup, "CROWDED", line_dedup.CROWDED if together > 64 else 20)
    monkeypatch.setattr(line_dedup, "MERGED", 2)
    r = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(60))]
    base = ["one two three four five six seven eight nine ten eleven", "x y z", "The Red House near the old mill stream"]
    for i in range(150):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(60)}"
        rows.append((1000 + i, " ".join(w) + f"\nown{i} line\n"))
    want, gone = jaccard_kept(rows)
    got = [tuple(a) for a in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == want and len(gone) > 50


def test_line_dedup_in_any_order(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"
    r, c = random.Random(8), [f"v{i}" for i in range(14)]
    rows = [(10, a), (5, f"own words\n{a}"), (7, b)]
    for i in range(20, 140):
        w = list(c)
        w[r.randrange(14)] = f"w{r.randrange(9)}"
        rows.append((i, f"line {i}\n" * r.randrange(3) + " ".join(w)))
    rows += [(200, f"x\n\n{a} twelve"), (200, f"{b} twelve\ny\nnever seen before line here"), (200, "x\ny\nz"), (200, "x\ny\nz")]  # three documents
    want, gone = jaccard_kept(rows)
    assert (5, 0, 1) not in gone and (7, 0, 0) in gone
    for seed in range(2):
        shuffled = rows[:3] + r.sample(rows[3:], len(rows) - 3) if seed == 0 else sorted(rows, reverse=True)
        df = spark.createDataFrame(spark.sparkContext.parallelize(shuffled, 3), "doc_id long, text string")
        assert sorted(tuple(x) for x in line_dedup.dedup(df).collect()) == want


def test_line_tokens():
    """Words, lines and hashes of pieces as plain Python has them, whatever the piece's size; hashes of places as Spark has them."""
    import pyarrow as pa

    odd = ["", "\n", "a", "\n\nA b\x0bB\n", "ünï ▁ \x00 😀 end\r\nof", " x " * 50, "", *texts(40), "tail\n"]
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(odd)), "nth": np.zeros(len(odd), np.int64), "text": odd})
    for size in (1, 300, 1 << 20):
        words.PIECE, was = size, words.PIECE
        try:
            found, at = [], {}
            for p in words.pieces([batch.slice(0, 5), batch.slice(5)]):
                begin, end, h = p.words()
                assert [bytes(p.low[x:y]) for x, y in zip(begin, end)] == [w for x, y in zip(p.begin, p.end) for w in bytes(p.low[x:y]).split()]
                lines = np.searchsorted(p.begin, begin, "right") - 1
                for k in range(len(p.begin)):
                    own = bytes(p.low[p.begin[k] : p.end[k]])
                    assert len(own.split()) == (lines == k).sum() and (p.sigs()[k] != 0) == bool(own.split())
                    found.append((int(p.doc[k]), int(p.line[k]), own))
                    for w, x in zip(own.split(), h[lines == k].tolist()):
                        assert at.setdefault(w, x) == x
            assert len(set(at.values())) == len(at)
            assert found == [(i, k, w) for i, t in enumerate(odd) for k, w in enumerate(t.encode().lower().split(b"\n"))]
        finally:
            words.PIECE = was


def test_place_hashes(spark):
    rows = [(i * 2**40 - 5, -i, i % 7) for i in range(50)]
    want = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c int").selectExpr("xxhash64(a, b, CAST(c AS LONG))").collect()]
    assert words.hash_of(*(np.array(x) for x in zip(*rows))).view(np.int64).tolist() == want


def plain_sentences(text, most=substring_dedup.MOST_WORDS):
    """(first byte, words, number of the sentence) of the pieces of a text's sentences, word by word."""
    t = text.encode()
    found = [(m.start(), m[0].lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
    out, own, nth = [], [], 0
    for k, (at, w) in enumerate(found):
        own.append((at, w))
        end = at + len(w)
        if k + 1 == len(found) or w[-1:] in (b".", b"!", b"?") or b"\n" in t[end : found[k + 1][0]]:
            parts = [own]
            if most is not None and len(own) > most:
                h = [int(words.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[2][0]) for _, w in own]
                n = substring_dedup.WINDOW
                least = {max(range(i, i + n), key=lambda k: (-h[k], k)) for i in range(len(own) - n + 1)} | {len(own) - 1}  # noqa: B023
                bounds = [0, *(k + 1 for k in sorted(least))]
                parts = [own[x:y] for x, y in zip(bounds, bounds[1:])]
            out += [(p[0][0], [w for _, w in p], nth) for p in parts]
            own, nth = [], nth + 1
    return out


def plain_runs(pieces, least=substring_dedup.LEAST):
    """{(first, last): words} by trying all."""
    n, size, found = len(pieces), [len(w) for _, w, _ in pieces], set()
    enough = lambda i, j: sum(size[i:j]) >= substring_dedup.LONG or sum(size[i:j]) >= substring_dedup.WORDS and j - i >= substring_dedup.SENTENCES
    for i in range(n):
        found |= {(i, j) for j in [next((j for j in range(i + 1, n + 1) if enough(i, j)), None)] if j}
        found |= {(k, i + 1) for k in [next((k for k in range(i, -1, -1) if enough(k, i + 1)), None)] if k is not None}
    of = lambda q: [k for k in range(n) if pieces[k][2] in (q, q + 1)]
    pairs = [of(q) for q in range(pieces[-1][2])] if n else []
    found |= {(own[0], own[-1] + 1) for own in pairs if sum(size[k] for k in own) >= least}
    return {(i, j - 1): tuple(w for _, own, _ in pieces[i:j] for w in own) for i, j in found}


def plain_dedup(rows, least=substring_dedup.LEAST, most=substring_dedup.MOST_WORDS):
    own = sorted(set(apart(rows)))
    first, out = {}, {}
    for doc, nth, t in own:
        s = plain_sentences(t, most)
        gone = set()
        for (i, j), key in sorted(plain_runs(s, least).items()):
            if first.setdefault(key, (doc, nth, i)) != (doc, nth, i):
                gone |= set(range(i, j + 1))
        data, bounds = t.encode(), [*(at for at, *_ in s), len(t.encode())]
        kept = data[: bounds[0]] + b"".join(data[bounds[k] : bounds[k + 1]] for k in range(len(s)) if k not in gone)
        out[doc, nth] = kept.decode()
    return sorted((i, out[i, h]) for i, h, _ in apart(rows))


def test_runs_are_those_of_plain_python():
    r = random.Random(21)
    odd = ["", " ", "\n", "a", ".", " lead. " + "w " * 60, "one two. " * 30, "É ü. " * 40, "A b!\n\n c? d\x0be \r\n" * 12]
    odd += ["".join(r.choice(["the ", "of ", "a", "bc ", "d. ", "e\n", "é! ", "f  ", "g\t"]) for _ in range(r.randrange(400))) for _ in range(60)]
    raw = [t.encode() for t in odd]
    off = np.cumsum([0, *map(len, raw)])
    s = substring_dedup.Sentences(words.LOWER[np.frombuffer(b"".join(raw), np.uint8)], off)
    hashes, i, j = s.runs()
    got, at = {}, 0
    for k, t in enumerate(odd):
        want = plain_sentences(t)
        assert [b - off[k] for b, x in zip(s.begin, s.text) if x == k] == [b for b, *_ in want]
        mine = {(int(x) - at, int(y) - at): int(h) for h, x, y in zip(hashes, i, j) if s.text[x] == k}
        plain = plain_runs(want)
        assert mine.keys() == plain.keys()
        for pair, key in plain.items():
            assert got.setdefault(key, mine[pair]) == mine[pair]
        at += len(want)
    assert len(set(got.values())) == len(got)


@pytest.mark.parametrize("runs", [1_000_000, 40])
def test_substring_dedup(spark, monkeypatch, runs):
    monkeypatch.setattr(substring_dedup, "RUNS", runs)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(sentence(n) for n in (9, 14, 6, 12, 11))
    unbroken = " ".join(word() for _ in range(60))
    rows = [(i, f"{sentence(12)} {sentence(9)}\n{p}\n{sentence(8)}") for i, p in enumerate([passage, unbroken, passage, unbroken, passage.upper()])] + [(9, sentence(30) + " The. Of. A."), (10, "The. Of. A.")]
    rows += [(20 + i, " ".join(r.choice([passage, sentence(5), sentence(30), unbroken, "x.\n"]) for _ in range(6))) for i in range(20)]
    rows += [(50, passage), (50, "short. Of. A."), (51, f" {passage}\n{unbroken} é"), (52, sentence(50)), (52, rows[3][1]), (52, rows[3][1])]  # doc_ids with several texts, and one text twice
    got = sorted(tuple(a) for a in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == plain_dedup(rows)
    kept, own = dict(got), {i: t.split("\n") for i, t in rows}
    assert kept[0] == rows[0][1] and kept[1] == rows[1][1] and kept[9] == rows[5][1] and kept[10] == rows[6][1]
    for i in (2, 4):
        assert own[i][1] not in kept[i] and not set(kept[i].split()) & set(own[i][1].split()) and own[i][0] in kept[i] and own[i][2] in kept[i]
    assert len(set(kept[3].split()) & set(unbroken.split())) <= 20 and own[3][0] in kept[3]


@pytest.mark.parametrize(("least", "most"), [(1, 12), (8, None), (20, 12)])
def test_runs_of_whole_sentences(spark, least, most):
    r = random.Random(8)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."
    short, two = [sentence(4) for _ in range(4)], [sentence(25), sentence(2)]
    rows = [(i, " ".join([sentence(7), *short, sentence(9), *two, sentence(6)])) for i in range(3)] + [(3, " ".join([sentence(3), short[1], short[3]])), (4, "Of. Of. Of."), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = dict(substring_dedup.dedup(df, least, most).collect())
    assert sorted((i, t) for i, t in kept.items() if t is not None) == plain_dedup(rows[:-1], least, most) and kept[6] is None
    assert kept[0] == rows[0][1] and kept[3] == rows[3][1] and kept[4] == ("Of. " if least == 1 else rows[4][1])
    for i in (1, 2):
        assert all((s in kept[i]) == (least > 8) for s in short) and not any(s in kept[i] for s in two)


def test_every_long_repeat_shares_a_run():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    for trial in range(1500):
        passage = some(51)
        if trial % 3 == 2:  # sentences of any length
            passage = [w + "." * (r.random() < 0.1) for w in passage]
        gap = "\t" if trial % 3 == 1 else " "
        raw = [gap.join(some(r.randrange(60)) + passage + some(r.randrange(60))).encode() for _ in range(2)]
        s = substring_dedup.Sentences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        h, i, _ = s.runs()
        assert set(h[s.text[i] == 0].tolist()) & set(h[s.text[i] == 1].tolist()), trial
        assert np.diff(s.bound).max() <= 12


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(best_fit_packing.default_tokenizer()).encode
    got = best_fit_packing.pack(docs, capacity=100, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    for doc_id, own in got.sort_values("piece").groupby("doc_id"):
        ids = [*encode(texts()[doc_id], add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == ids and own["start"].tolist() == list(range(0, len(ids), 100))
        assert own["ids_crc32"].tolist() == [zlib.crc32(x) for x in own["ids"]]
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all() and got.groupby("sequence_id")["length"].sum().max() <= 100
    best, rooms = 0, []
    for n in sorted(got["length"], reverse=True):  # best-fit decreasing, piece by piece
        fits = [x for x in rooms if x >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            best += 1
            rooms.append(100 - n)
    assert got["sequence_id"].nunique() == best


def test_tokens_of_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = best_fit_packing.default_tokenizer()
    whole, r = Tokenizer.from_file(path), random.Random(3)
    odd = ["".join(r.choice(" \n\taB'séÉßÑ.,!?|*#0😀́\x1f <>") for _ in range(r.randrange(40))) for _ in range(1500)] + ["<|endoftext|> don't x<|startoftext|>", ""]
    got = best_fit_packing.Vocabulary(path).encode_all(pa.array(odd))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("members", [2048, 12])
def test_embedding_links(spark, monkeypatch, members):
    monkeypatch.setattr(embedding_near_dedup, "MEMBERS", members)
    monkeypatch.setattr(embedding_near_dedup, "ROWS", 16_384 if members > 12 else 100)
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16))
    x[200:300] = x[0] + 0.05 * r.standard_normal((100, 16))  # a dense group
    x[300:350] = x[:50] + 0.02 * r.standard_normal((50, 16))
    x[350:360] = x[1]
    labels = [0 if i < 300 else i % 2 for i in range(400)]
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    got = {a["vec_id"]: a for a in embedding_near_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    links = np.array([got[i]["n_links"] for i in range(400)])
    assert (links <= link.sum(axis=1)).all() and links.sum() >= 0.9 * link.sum()
    assert np.mean([got[i]["component_id"] == c for i, c in enumerate(roots(400, zip(*np.nonzero(np.triu(link)))))]) > 0.95


def test_embedding_counts_in_balls(spark, monkeypatch):
    """Links counted by balls are those of all pairs, whatever is settled by centres and radii."""
    monkeypatch.setattr(embedding_near_dedup, "MEMBERS", 16)
    r = np.random.default_rng(4)
    x = np.concatenate([c + s * r.standard_normal((120, 8)) for c, s in zip(r.standard_normal((4, 8)) * 3, (0.01, 0.3, 0.8, 1.5))])
    copies = r.integers(1, 4, len(x))
    members = spark.createDataFrame([(i // 240, i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, copies))], "component long, rep long, copies long, embedding array<double>")
    got = {a["rep"]: a["others"] for a in embedding_near_dedup.counts(members, 0.93).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] // 240 == np.arange(len(x))[None, :] // 240)
    np.fill_diagonal(link, False)
    assert [got.get(i, 0) for i in range(len(x))] == (link @ copies).tolist()


def test_embedding_recall(spark):
    """Planted pairs that nothing else leads to, near the threshold."""
    r = np.random.default_rng(6)
    x = r.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((500, 64))
    y -= (y * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    cos = r.uniform(0.931, 0.95, 500)[:, None]
    x[500:1000] = cos * x[:500] + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = {(a["a"], a["b"]) for a in embedding_near_dedup.candidates(df.withColumnRenamed("vec_id", "rep").withColumn("label", df["label"].cast("long")), embedding_near_dedup.PASSES, 0.93).collect()}
    found = {(min(p), max(p)) for p in links}
    assert len(found & {(i, 500 + i) for i in range(500)}) >= 485 and all(x[i] @ x[j] >= 0.93 for i, j in found)
    assert embedding_near_dedup.passes_for(20_000) == 16 and embedding_near_dedup.passes_for(10**6) == 30


def labelled(n, mark):
    r = random.Random(9)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(60)]
        y = i % 5 == 0
        out.append((i, mark(r, w) if y else " ".join(w) + ".", int(y)))
    return out


def test_toxicity_learns(spark):
    bad = ["grubnik", "zorfling", "plonker"]
    rows = labelled(600, lambda r, w: " ".join(w[:20] + [r.choice(bad) + r.choice(["", "s"])] + w[20:]))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {a["doc_id"]: a for a in toxicity.score(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.98


def test_toxicity_with_weak_evidence(spark):
    d = spark.createDataFrame([(i, f"word{i % 4} other{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(24)], "doc_id long, toxic int")
    assert toxicity.score(d, labels).count() == 40


def test_toxic_clauses():
    lexicon, machine = toxicity.Lexicon({}), toxicity.Machine()
    kind = lambda t: [k for k, v in zip(toxicity.KINDS, toxicity.matches(t, lexicon, machine)) if v]
    assert kind("you are an idiot") == ["aimed"] and kind("what an idiot you are") == ["aimed"] and kind("an idiot. you came") == ["plain"]
    assert kind("you are not an idiot") == ["denied"] and kind("they said you are an idiot") == ["reported"]
    assert kind("i will kill you") == ["aimed threat"] and kind("the frost may kill roses") == ["threat"] and kind("a fine day") == []


def test_transducers_compose():
    """The composed machine against each mark's rule read off the whole clause."""
    r, machine = random.Random(12), toxicity.Machine()
    classes = ["insult", "threat", "target", "negation", "report", "word", "word", "word"]
    kind_of = {"insult": ("plain", "aimed"), "threat": ("threat", "aimed threat")}
    seen = set()
    for _ in range(6000):
        own = [r.choice(classes) for _ in range(r.randrange(1, 14))]
        back = lambda i, what, reach: any(own[j] == what for j in range(max(0, i - reach), i))  # noqa: E731, B023
        want = []  # (place, kind)
        for i, c in enumerate(own):
            if c in kind_of:
                if "report" in own[:i]:
                    want.append((i, "reported"))
                elif back(i, "negation", toxicity.SCOPE):
                    want.append((i, "denied"))
                else:
                    want.append((i, kind_of[c][back(i, "target", toxicity.REACH)]))
            elif c == "target" and want and want[-1][1] in ("plain", "threat") and i - want[-1][0] <= toxicity.REACH:
                want[-1] = (want[-1][0], {"plain": "aimed", "threat": "aimed threat"}[want[-1][1]])
        got = machine.clause([(c, float(i)) for i, c in enumerate(own)])
        assert got == [(k, float(i)) for i, k in want], own
        seen |= {k for _, k in want}
    assert seen == set(toxicity.KINDS) - {"mild"}


def test_clauses_decide(spark):
    """Every text holds an insult or a threat; only what the clause makes of it tells toxic texts from clean ones."""
    r = random.Random(13)
    toxic = ["you are a {i}", "they are a {i}", "he will {t} you", "you {i}", "he will {t} them"]  # no word that the clean ones lack
    clean = ["you are not a {i}", "she said they are a {i}", "a {i} will win", "he will not {t} you", "they said you are a {i}", "never {t} them", "they said he will {t} them"]
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    rows = []
    for i in range(700):
        y = i % 2
        own = r.choice(toxic if y else clean).format(i=r.choice(["idiot", "moron", "fool"]), t=r.choice(["kill", "hurt", "punch"]))
        filler = [" ".join(r.choice(words) for _ in range(8)) for _ in range(3)]
        rows.append((i, f"{filler[0]}. {own}. {filler[1]}\n{filler[2]}.", y))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {a["doc_id"]: a for a in toxicity.score(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), threshold=0.5).collect()}
    held = [(got[i]["predicted"], got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    lexicon = toxicity.Lexicon({})
    alone = [any((lexicon.symbol(w) or ("", 0))[0] in ("insult", "threat") for w in toxicity.words_of(t)) for _, t, _ in rows]
    assert len(held) > 120 and all(alone)  # so a lexicon alone can tell nothing
    assert np.mean([p == y for p, _, y in held]) >= 0.9
    pairs = [(a > b) + 0.5 * (a == b) for _, a, y in held if y for _, b, z in held if not z]
    assert np.mean(pairs) >= 0.95


def test_quality_learns(spark):
    rows = labelled(600, lambda r, w: " | ".join(x.upper() for x in w))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {a["doc_id"]: a for a in quality_classifier.classify(d, spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, quality int")).collect()}
    held = [(got[i]["predicted"], 1 - y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.98


def test_quality_needs_pairs():
    r = np.random.default_rng(3)
    x = np.zeros((3000, len(quality_classifier.FEATURES)))
    x[:, :2] = r.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_classifier.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}


def test_lines_of_near_lengths_are_of_neighbouring_classes():
    n = np.arange(1, 200_000)
    longest = n * line_dedup.DEN // line_dedup.NUM  # of the lines that may match one of n words
    low, high = (line_dedup.of_length(x).astype(int) for x in (n, longest))
    assert low.min() == 1 and ((high - low >= 0) & (high - low <= 1)).all() and (np.diff(low) >= 0).all()
