"""Quality as a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting: round after round, one shallow tree is
fitted to one feature's gradients, a small step of it added to the table, then the next feature's. The
pairs whose bins explain most of what is left get tables of two features the same way. A score is the sum of
a document's entries, so scoring is one gather for each table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import held_out, sample

#: Labelled documents learned from at most.
MOST = 20_000
THRESHOLD = 0.7
BINS, ROUNDS, RATE, LEAVES = 32, 120, 0.15, 4
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 60

FEATURES = (
    "words", "word_length", "word_spread", "upper", "lower", "digits", "wide", "newlines", "full_stops", "commas",
    "bars", "calls", "marks", "stops", "distinct", "commonest", "repeated_next", "repeated_lines", "short_lines", "rare_ends",
)
_line = re.compile("[^\r\n]+").findall


def features(text: str | None) -> list[float]:
    """What a text looks like, as shares of its bytes, words or lines; null is empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h, n = np.bincount(raw, minlength=256), max(1, len(raw))
    words, lines = text.split(), _line(text)
    k, sizes = max(1, len(words)), np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    spaces = h[9:14].sum() + h[32]
    digits, upper, lower, wide = h[48:58].sum(), h[65:91].sum(), h[97:123].sum(), h[128:].sum()
    plain = digits + upper + lower + wide + spaces
    counts = Counter(words)
    return [
        np.log1p(len(words)), sizes.mean(), sizes.std(), upper / n, lower / n, digits / n, wide / n, h[10] / k, h[46] / k, h[44] / k,
        h[124] / k, h[33] / k, (len(raw) - plain) / n, (h[36] + h[37] + h[38] + h[42] + h[35]) / k,
        len(counts) / k, max(counts.values(), default=0) / k, sum(map(eq, words, words[1:])) / k,
        1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)), (h[58] + h[59] + h[63]) / k,
    ]


class Model(NamedTuple):
    base: float
    cuts: list  # of each feature: ascending inner bounds of its bins
    tables: list  # of each feature: an entry for each bin
    pairs: list  # (one, other, table of PAIR_BINS x PAIR_BINS)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: vectorised additions of table entries."""
        b, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[_coarse(b[:, i], self.cuts[i]), _coarse(b[:, j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(cuts) + 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow regression tree over ordered bins with gradient sums g and weights h: each leaf's step, in its bins."""
    parts, total = [(0, len(g))], lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    while len(parts) < leaves:
        best = (1e-9, None)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - total(a, b)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (p, a + k + 1))
        if best[1] is None:
            break
        p, at = best[1]
        parts[p : p + 1] = [(parts[p][0], at), (at, parts[p][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from rows of features and 0/1 labels. Without both labels the score is the smoothed share of ones."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Model(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b, f = model.bins(x), np.full(len(y), base)

    def step(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            add = RATE * _tree(*step(b[:, j], len(t)))
            t += add
            f += add[b[:, j]]
    cells = {}
    for i in range(x.shape[1]):
        for j in range(i):
            cell = _coarse(b[:, i], cuts[i]) * PAIR_BINS + _coarse(b[:, j], cuts[j])
            g, h = step(cell, PAIR_BINS**2)
            cells[i, j] = ((g**2 / (h + 1)).sum(), cell)
    for i, j in sorted(cells, key=lambda k: -cells[k][0])[:PAIRS]:
        model.pairs.append((i, j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            cell = cells[i, j][1]
            g, h = step(cell, PAIR_BINS**2)
            g, h = g.reshape(t.shape), h.reshape(t.shape)
            # a split of one feature, and below it one of the other: a tree of depth two on each side
            halves = np.digitize(_tree(g.sum(axis=1), h.sum(axis=1), 2), [0])
            add = np.zeros(t.shape)
            for half in (0, 1):
                at = halves == half
                if at.any():
                    add[at] = RATE * _tree(g[at].sum(axis=0), h[at].sum(axis=0), 2)
            t += add
            f += add.ravel()[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """The features of the sampled labelled documents, so a bounded table, come to the driver to be fitted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"doc_id": d["doc_id"], "y": d["y"], "x": [features(t) for t in d["text"]]})

    found = sample(docs, labels, "quality", most).mapInPandas(each, "doc_id long, y int, x array<double>").toPandas()
    found = found.sort_values("doc_id")  # sums in one order, so the same model on every run
    return fit(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["y"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: better) and predicted.

    Only text is an input of a score. Null texts are empty; empty texts are scored by their features
    (all zero). Very long texts are scored whole. Repeated rows are scored each, equal texts alike; other columns
    don't matter. Without labels every score is 0.5. An empty table gives an empty result.
    """
    model = learn(docs, labels, most)

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), each(F.col("text").cast("string")).alias("score"))
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
