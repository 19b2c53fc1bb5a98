"""Line dedup where the tables of repeated lines meet the hashes of many other lines."""

import numpy as np
import pandas as pd
import pyarrow as pa

from quern.llm import line_dedup, words


def test_lines_whose_hash_falls_in_with_a_repeated_one(spark):
    """Of 2,000 pairs of near lines, none of which is repeated, every second line goes, whatever the other lines."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, words(k, 9)) for k in range(2000)] + [(10_000 + k, words(k, 9) + " more") for k in range(2000)]
    rows += [(20_000 + k, f"copy {words(-k - 1, 3)}") for k in range(3000)] + [(30_000 + k, f"copy {words(-k - 1, 3)}") for k in range(3000)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: t if i < 10_000 or 20_000 <= i < 30_000 else "" for i, t in rows}
    assert left == want


def test_packed_rows_hold_no_empty_planes():
    r = np.random.default_rng(3)
    n = 1000
    x = {
        "token": r.integers(0, 1 << 32, n).astype(np.uint32), "doc": r.integers(0, 60_000, n), "nth": np.zeros(n, np.int64), "line": r.integers(0, 200, n), "n": r.integers(1, 300, n),
        "pos": r.integers(0, 50, n), "sketch": r.integers(0, 1 << 64, n, np.uint64), "wide": np.zeros(n, np.uint64),
    }
    small = words.packed(x, line_dedup.FIELDS, slice(None))
    assert len(small) < 20 * n
    x["nth"] = np.where(np.arange(n) % 7 == 0, r.integers(-(1 << 63), 1 << 63, n), 0)
    x["doc"] = x["doc"] - 30_000
    x["wide"][5] = 1 << 63
    blobs = [words.packed(x, line_dedup.FIELDS, np.arange(a, b)) for a, b in ((0, 7), (7, 7), (7, 500), (500, n))]
    assert [words.rows_in(b) for b in blobs] == [7, 0, 493, 500]
    for only in ((), line_dedup.PLACED):
        got = words.unpacked(blobs, line_dedup.FIELDS, only)
        assert set(got) == set(only or line_dedup.FIELDS) and all((got[f] == x[f]).all() and got[f].dtype == kind for f, kind in line_dedup.FIELDS.items() if f in got)
    assert all(len(y) == 0 for y in words.unpacked([], line_dedup.FIELDS).values())


def test_letters_and_white_space_are_those_of_ascii():
    every = bytes(range(128)).decode() + "".join(map(chr, range(128, 2000)))
    for text in (every, every[::-1], "@[`{ AZaz\x08\x09\x0d\x0e\x1f\x20\x21"):
        ((_, _, low, off),) = words.cut_up(pa.array([text]))
        assert low.tobytes() == text.encode().lower()
        begin, end, _ = words.words(low, off)
        assert [low[a:b].tobytes() for a, b in zip(begin, end)] == low.tobytes().split()


def test_lines_of_far_lengths_are_not_tried(spark, monkeypatch):
    """Of 300 lines of 10 to 309 words that share a word each, only those of near lengths are compared; the pairs found are the same whatever is tried at once."""

    class Groups:
        def groupBy(self, *_):
            return self

        def applyInPandas(self, compare, _):
            self.compare = compare
            return self

        def agg(self, *_):
            return self

    r, n, tried = np.random.default_rng(4), 300, []
    length = r.permutation(np.arange(10, 10 + n))
    x = {f: np.zeros(2 * n, kind) for f, kind in line_dedup.FIELDS.items()}
    x |= {"token": np.repeat([7, 9], n), "doc": np.tile(np.arange(n), 2), "n": np.tile(length, 2), "sketch": np.tile(r.choice(r.integers(0, 1 << 64, 3, np.uint64), n), 2)}
    group = pd.DataFrame({"part": 0, "sub": 0, "one": 0, "two": 0, "block": 0, "blob": [words.packed(x, line_dedup.FIELDS, slice(None))]})
    count, probes = np.bitwise_count, line_dedup.Table(np.full(1 << 12, 255, np.uint8))

    def counted(y):
        tried.append(y.size)
        return count(y)

    monkeypatch.setattr(np, "bitwise_count", counted)
    for most in (2, 10_000):
        found = []
        for few, at_once in ((512, 1 << 18), (512, 100), (32, 100)):
            monkeypatch.setattr(line_dedup, "FEW", few)
            monkeypatch.setattr(line_dedup, "TRIED", at_once)
            tried.clear()
            groups = Groups()
            line_dedup.candidates(groups, most, probes)
            found.append({tuple(p) for p in groups.compare(group)[["a_doc", "b_doc", "more"]].itertuples(index=False)})
            assert few < n or max(tried) < n * n / 4  # at first all pairs of both words in one step
        near = {(a, b) for a in range(n) for b in range(a) if 5 * min(length[a], length[b]) >= 4 * max(length[a], length[b])}
        assert found[0] == found[1] == found[2] and {p[:2] for p in found[0]} <= near and len(found[0]) > n / 2
    assert len(found[0]) > 3000 and not any(p[2] for p in found[0])
