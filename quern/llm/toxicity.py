"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols by a lexicon: insults and threats (a small seed list and what is learned from labelled
documents: words and word beginnings far more frequent in toxic ones), targets, negations and verbs of reported
speech. Four transducers rewrite a clause's symbols one after another, composed into one machine whose states are made
when first met:

    quote    a reporting verb marks what follows it in the clause as reported
    negate   a negation marks the next few words as denied
    aim      a target marks insults and threats near behind it, and takes the mark to those near before it
    match    adds up the weights that matched clauses emit, by the marks they bear

A clause counts only if an insult or threat is in it. What each kind of match adds to a document's score is learned
by a logistic regression that starts from prior weights (aimed matches more, denied and reported ones less), so kinds
that the labels don't show keep their prior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import held_out, sample
from .words import trim

#: Labelled documents learned from at most; entries that the learned lexicon holds at most, and that come to the driver to be chosen from.
MOST, ENTRIES, TRIED = 20_000, 5_000, 20_000
THRESHOLD = 0.3
#: Word beginnings of these lengths are tried besides whole words; least evidence (log-likelihood ratio) and log odds of an entry.
BEGINNINGS, EVIDENCE, ODDS = (4, 5, 6), 24.0, 2.5
SCOPE, REACH = 4, 5  # words that a negation denies, and words between a target and its match

SEEDS = {
    "insult": "idiot idiots moron morons imbecile fool loser losers scum trash worthless pathetic disgusting stupid dumb ugly vermin filth scumbag bastard crétin abruti ordure trottel abschaum dummkopf imbécil basura escoria",
    "threat": "kill hurt destroy beat punch stab shoot strangle murder tuer frapper töten umbringen schlagen matar golpear",
    "target": "you your yours yourself they them their he him she her these those tu te toi vous ton ta du dich dir ihr euch sie tú ti vosotros usted ustedes",
    "negation": "not no never isn't aren't don't won't cannot nobody neither ne pas jamais nicht kein keine nie nunca tampoco",
    "report": "said says say told wrote writes quoted quotes reported claims claimed called dit écrit sagt sagte schrieb dijo dice escribió",
}
KINDS = ("plain", "aimed", "denied", "reported", "threat", "aimed threat", "mild")
#: Log odds that a unit of each kind adds before learning, and the weight that holds a kind to it.
PRIOR, HOLD = np.array([2.0, 3.0, 0.3, 0.3, 1.0, 2.5, 0.1]), 0.05

words_of = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?").findall
clauses_of = re.compile(r"[.!?;:\n]+").split


class Lexicon:
    """Symbols of words: (class, weight). Learned entries ending in * are beginnings of words."""

    def __init__(self, learned: dict[str, float]):
        self.whole = {w: (c, 1.0) for c, ws in SEEDS.items() for w in ws.split()}
        self.starts = {}
        for entry, weight in learned.items():
            if entry.endswith("*"):
                self.starts[entry[:-1]] = ("insult", weight)
            elif self.whole.get(entry, ("insult", 0))[0] in ("insult", "threat"):
                self.whole[entry] = (self.whole.get(entry, ("insult", 0))[0], weight)
        #: The first letters of all that make a clause count.
        self.heads = {w[:4] for w, (c, _) in self.whole.items() if c in ("insult", "threat")} | {w[:4] for w in self.starts}

    def symbol(self, word: str) -> tuple[str, float] | None:
        found = self.whole.get(word)
        for n in BEGINNINGS:
            start = self.starts.get(word[:n])
            if start and (found is None or found[0] == "insult" and start[1] > found[1]):
                found = start
        return found


# Each transducer: (state, symbol) -> (state, symbol). A symbol is its class followed by its marks.
def quote(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "report":
        return 1, "word"
    return state, f"{symbol} reported" if state and symbol in ("insult", "threat") else symbol


def negate(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "negation":
        return SCOPE, "word"
    return max(0, state - 1), f"{symbol} denied" if state and symbol.startswith(("insult", "threat")) else symbol


def aim(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "target":
        return REACH, "target"
    return max(0, state - 1), f"{symbol} aimed" if state and symbol.startswith(("insult", "threat")) else symbol


def match(state: int, symbol: str) -> tuple[int, str]:
    """Which kind a match is; state counts down from an unaimed match, whose kind a target behind it in reach makes aimed."""
    if symbol == "target":
        return 0, "aims" if state else ""
    if not symbol.startswith(("insult", "threat")):
        return max(0, state - 1), ""
    marks = symbol.split()
    if "reported" in marks or "denied" in marks:
        return 0, "reported" if "reported" in marks else "denied"
    kind = {"insult": "plain", "threat": "threat"}[marks[0]]
    if "aimed" in marks:
        return 0, {"plain": "aimed", "threat": "aimed threat"}[kind]
    return REACH, kind


class Machine:
    """The composition quote > negate > aim > match, its arcs kept when first taken."""

    parts = (quote, negate, aim, match)

    def __init__(self):
        self.arcs: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]] = {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            states, out = [], symbol
            for part, s in zip(self.parts, state):
                s, out = part(s, out)
                states.append(s)
            arc = self.arcs[state, symbol] = (tuple(states), out)
        return arc

    def clause(self, symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """The matches (kind, weight) of a clause."""
        state, found = (0, 0, 0, 0), []
        for symbol, weight in symbols:
            state, out = self.step(state, symbol)
            if out == "aims":
                kind, w = found[-1]
                found[-1] = ({"plain": "aimed", "threat": "aimed threat"}[kind], w)
            elif out:
                found.append((out, weight))
        return found


def matches(text: str | None, lexicon: Lexicon, machine: Machine) -> list[float]:
    """What a whole text's matched clauses add to each kind: for a clause the weights, for the text a sum that flattens."""
    low, out = (text or "").lower(), [0.0] * len(KINDS)
    heads = lexicon.heads
    if not any(w[:4] in heads for w in set(words_of(low))):
        return out
    for clause in clauses_of(low):
        own = words_of(clause)
        if any(w[:4] in heads for w in own):
            for kind, weight in machine.clause([lexicon.symbol(w) or ("word", 0.0) for w in own]):
                out[KINDS.index(kind if weight >= 0.5 else "mild")] += weight if weight >= 0.5 else 1.0
    return [float(np.log1p(x)) for x in out]


def entries(words: list[str]) -> set[str]:
    own = set(words)
    return own | {w[:n] + "*" for n in BEGINNINGS for w in own if len(w) > n}


def evidence(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Dunning's log-likelihood ratio that a share k1/n1 differs from k0/n0."""

    def part(k, n, p):
        return k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))

    p = (k1 + k0) / (n1 + n0)
    return 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, p) - part(k0, n0, p))


def one_of_each(found: DataFrame) -> DataFrame:
    """The sample without all but one of its toxic near copies, whose every word would look toxic: documents that
    share one of four minima over hashed three-word runs are one group. The sample is bounded, so the driver groups."""

    def minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for doc_id, text in zip(d["doc_id"], d["text"]):
                own = words_of((text or "").lower())
                h = np.array([xxhash.xxh64_intdigest(" ".join(own[i : i + 3])) for i in range(max(1, len(own) - 2))], np.uint64)
                out += [(doc_id, k, int((h * np.uint64(2 * k + 3) ^ h >> np.uint64(16 * k)).min() >> np.uint64(1))) for k in range(4)]
            yield pd.DataFrame(out, columns=["doc_id", "k", "least"])

    seen: dict[tuple[int, int], int] = {}
    low: dict[int, int] = {}

    def root(x: int) -> int:
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for doc_id, k, least in found.where("y = 1").mapInPandas(minima, "doc_id long, k int, least long").toPandas().sort_values(["doc_id", "k"]).itertuples(index=False):
        a, b = root(int(doc_id)), root(seen.setdefault((k, least), int(doc_id)))
        low[max(a, b)] = min(a, b)
    gone = sorted(x for x in low if root(x) != x)
    if not gone:
        return found
    return found.join(F.broadcast(found.sparkSession.createDataFrame([(x,) for x in gone], "doc_id long")), "doc_id", "left_anti")


def learn_lexicon(found: DataFrame) -> dict[str, float]:
    """Words and beginnings that mark toxic documents, weighted by log odds, at most ENTRIES, from the TRIED that are in most toxic ones by their odds. Counts are
    gathered within parts of the bounded sample first; only strong entries come to the driver."""
    sizes = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())

        def out() -> Iterator[pd.DataFrame]:
            own = [*seen[1], *(e for e in seen[0] if e not in seen[1])]
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                yield pd.DataFrame({"entry": pd.Series(part, dtype=object), "k1": [seen[1][e] for e in part], "k0": [seen[0][e] for e in part]})

        for d in batches:
            for text, y in zip(d["text"], d["y"]):
                seen[y].update(entries(words_of((text or "").lower())))
                if len(seen[0]) + len(seen[1]) > 200_000:  # counts of parts add up all the same
                    yield from out()
                    seen = (Counter(), Counter())
        yield from out()

    counts = found.select("text", "y").mapInPandas(count, "entry string, k1 long, k0 long").groupBy("entry").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    odds = F.log((F.col("k1") + 0.5) / (n1 - F.col("k1") + 0.5)) - F.log((F.col("k0") + 0.5) / (n0 - F.col("k0") + 0.5))
    strong = counts.where("k1 >= 3").withColumn("odds", odds).where(F.col("odds") >= ODDS)
    best = strong.orderBy(F.desc(F.col("k1") * F.col("odds")), "entry").limit(TRIED).toPandas()
    if not len(best):
        return {}
    best = best[evidence(best["k1"].to_numpy(float), n1, best["k0"].to_numpy(float), n0) >= EVIDENCE]
    # a beginning gives way to a longer entry that has nearly all of its toxic documents
    held = dict(zip(best["entry"], best["k1"]))
    longest: Counter = Counter()
    for e, k in held.items():
        own = e.rstrip("*")
        for n in BEGINNINGS:
            if len(own) > n or len(own) == n and not e.endswith("*"):
                longest[own[:n] + "*"] = max(longest[own[:n] + "*"], k)
    best = best[np.array([longest[e] < 0.9 * k for e, k in zip(best["entry"], best["k1"])], bool)]
    best = best.sort_values(["odds", "entry"], ascending=[False, True]).head(ENTRIES)
    return {e: float(o) / 5 for e, o in zip(best["entry"], best["odds"])}


class Grammar:
    """A learned lexicon with the weights of the kinds of match."""

    def __init__(self, learned: dict[str, float], bias: float, weights: np.ndarray):
        self.learned, self.bias, self.weights = learned, bias, weights
        self.lexicon, self.machine = Lexicon(learned), Machine()

    def score(self, texts) -> np.ndarray:
        x = np.array([matches(t, self.lexicon, self.machine) for t in texts]).reshape(-1, len(KINDS))
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Newton steps for a logistic regression held to the prior."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    theta = np.r_[np.log(rate / (1 - rate)) if len(y) else -3.0, PRIOR]
    start, hold = theta.copy(), np.r_[1e-3, np.full(len(PRIOR), HOLD)]
    z = np.c_[np.ones(len(x)), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        slope = z.T @ (y - p) - hold * (theta - start)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), slope)
        theta = theta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), theta[1:]


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Grammar:
    found = sample(docs, labels, "toxic", most)
    learned = learn_lexicon(one_of_each(found))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, machine = Lexicon(learned), Machine()
        for d in batches:
            yield pd.DataFrame({"doc_id": d["doc_id"], "y": d["y"], "x": [matches(t, lexicon, machine) for t in d["text"]]})

    own = found.mapInPandas(each, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    return Grammar(learned, *fit(np.array(own["x"].tolist(), float).reshape(-1, len(KINDS)), own["y"].to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: more toxic) and predicted.

    Only text is an input of a score. Null, empty and blank texts match nothing and get the lowest score. Very long texts are scored
    whole, clause by clause. Repeated rows are scored each; other columns don't matter. Without labels the seeds and prior weights decide. An empty table gives an empty result.
    """
    rated = rate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, most)
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def rate(docs: DataFrame, labels: DataFrame, most: int = MOST, into: str = "score") -> DataFrame:
    """docs with its columns and the score."""
    grammar, made = learn(docs, labels, most), []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Grammar(grammar.learned, grammar.bias, grammar.weights))
        out = pd.Series(made[0].score(texts))
        trim()
        return out

    return docs.withColumn(into, scored(F.col("text").cast("string")))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they were."""
    own = "score"
    while own in docs.columns:
        own += "_"
    return rate(docs, labels, most, own).where(F.col(own) < threshold).drop(own)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
