"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams, unigrams and a uniform floor. Its weights depend on how often
the context was seen, in buckets of powers of two, and are learned by expectation-maximisation on held-out counts: one fold
of the training documents is deleted from the counts, and its tokens are what the weights must predict.

Documents are dealt into blocks of bounded size. A block sends its distinct n-grams once, as sorted 64-bit hashes with
counts, to the parts of the hash range; a part sums what all blocks sent and answers each block with counts in the order
asked, without the keys. So a frequent word costs one entry for each block, and no vocabulary is gathered in one place. A block
sends a row only to parts that it has n-grams in, so there are never more rows than distinct n-grams of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .words import cut_up, planes, whole, words

FOLDS, HELD_OUT, DELETED = 5, 1, 2
BLOCK_BYTES = 8_000_000  # of text; what a task holds at once is some forty times that at most
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
KINDS = 2  # unigrams and bigrams
BUCKETS = 48
#: Natural-log width of the cells that the ratios of estimates are counted in for expectation-maximisation.
CELL = 0.125
ROUNDS = 60


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, for each pair."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0xBF58476D1CE4E5B9) + b
        x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


class Block:
    """The tokens of a block's documents in a row, and its distinct n-grams: keys[k] ascending, at[k] each token's place there."""

    def __init__(self, texts: pa.ChunkedArray):
        sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for chunk in texts.chunks:
            for first, last, low, off in cut_up(chunk):
                begin, _, h = words(low, off)
                sizes.append(np.bincount(np.searchsorted(off, begin, "right") - 1, minlength=last - first) + 1)
                hashes.append(h)
        self.sizes = np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        h = np.full(int(self.sizes.sum()), END)
        inside = np.ones(len(h), bool)
        inside[self.starts + self.sizes - 1] = False
        h[inside] = np.concatenate(hashes)
        del hashes
        before = np.empty(len(h), np.uint64)
        before[1:] = h[:-1]
        before[self.starts] = START
        self.keys, self.at = [], []
        for x in (h, mix(before, h)):
            keys, at = np.unique(x, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Counts in the narrowest type that holds them."""
    kind = next(t for t in ("u1", "u2", "u4", "u8") if not len(x) or x.max() <= np.iinfo(t).max)
    return kind, x.astype("<" + kind).tobytes()


def unpacked(kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<" + kind).astype(np.int64)


def blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs as (doc_id, held_out, text, role, block), the number of blocks, and the first one of deleted documents, which have blocks of their own. role: 0
    trains, 1 trains but is deleted when the weights are learned, 2 is only scored."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    role = F.when(fold.isNull() | (fold == HELD_OUT), 2).when(fold == DELETED, 1).otherwise(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), text.alias("text"), role.alias("role"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(1, -(-size // BLOCK_BYTES))
    few = max(1, -(-most // (FOLDS - 1)))
    deal = F.xxhash64("doc_id", "text")
    block = F.when(F.col("role") == 1, most + F.pmod(deal, F.lit(few))).otherwise(F.pmod(deal, F.lit(most)))
    return own.withColumn("block", block.cast("int")), most + few, most


def asked(own: DataFrame, bits: int) -> DataFrame:
    """(block, part, kind, deleted, keys, type, n): each block's distinct n-grams in each of 2^bits parts of the hash range, and their counts."""
    shift = np.uint64(64 - bits)
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("deleted", pa.bool_()), ("keys", pa.binary()), ("type", pa.string()), ("n", pa.binary())])

    def ask(x: pa.Table) -> pa.Table:
        block, out = Block(x["text"]), []
        role = x["role"].to_numpy()
        learn = np.repeat(role < 2, block.sizes)
        own, deleted = x["block"][0].as_py(), bool((role == 1).any())
        for kind, (keys, at) in enumerate(zip(block.keys, block.at)):
            n = np.bincount(at[learn], minlength=len(keys))
            part = (keys >> shift).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(heads, np.append(heads[1:], len(keys))):
                out.append((own, int(part[a]), kind, deleted, planes(keys[a:b].astype("<u8")), *packed(n[a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return own.groupBy("block").applyInArrow(ask, "block int, part int, kind int, deleted boolean, keys binary, type string, n binary")


def counted(own: DataFrame, n_blocks: int) -> DataFrame:
    """What the corpus answers each block: rows (block, part, kind, total, kept, ...) with the counts of the block's n-grams in a part
    of the hash range, in all training documents and in those not deleted; and rows of block -1 with each part's sums. There are about as many
    parts as blocks, so a part has no more keys than a block."""

    def answer(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = x.sort_values("block")
        sent = [whole(k, "<u8") for k in x["keys"]]
        n = np.concatenate([unpacked(t, d) for t, d in zip(x["type"], x["n"])])
        deleted = np.repeat(x["deleted"].to_numpy(bool), [len(k) for k in sent])
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(at, n, len(keys)).astype(np.int64)
        kept = total - np.bincount(at[deleted], n[deleted], len(keys)).astype(np.int64)
        part, kind = int(x["part"].iloc[0]), int(x["kind"].iloc[0])
        a = 0
        for block, k in zip(x["block"], sent):
            own = at[a : a + len(k)]
            out.append((int(block), part, kind, *packed(total[own]), *packed(kept[own]), 0, 0, 0, 0))
            a += len(k)
        out.append((-1, part, kind, "u1", b"", "u1", b"", int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())))
        return pd.DataFrame(out, columns=["block", "part", "kind", "type", "total", "kept_type", "kept", "n", "v", "kept_n", "kept_v"])

    schema = "block int, part int, kind int, type string, total binary, kept_type string, kept binary, n long, v long, kept_n long, kept_v long"
    return cut(asked(own, max(3, (n_blocks - 1).bit_length())).groupBy("part", "kind").applyInPandas(answer, schema))


def lookup(block: Block, answers: pd.DataFrame, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the counts of its word, of its bigram and of its context."""
    found = []
    for kind in range(KINDS):
        own = answers[answers["kind"] == kind].sort_values("part")
        n = np.concatenate([unpacked(t, d) for t, d in zip(own["type" if which == "total" else "kept_type"], own[which])])
        found.append(n[block.at[kind]])
    word, pair = found
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[block.starts] = word[block.starts[0] + block.sizes[0] - 1]  # each document begins once and ends once
    return word, pair, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else one more than the whole part of its count's binary logarithm."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def learn(own: DataFrame, answers: DataFrame, first: int, n: int, v: int) -> np.ndarray:
    """The weights (bucket, order: uniform, unigram, bigram). The deleted fold's tokens are counted by bucket and by the ratios of
    the estimates in cells, so a table of bounded size, on which the driver runs expectation-maximisation."""

    def ratios(x: pa.Table, a: pa.Table) -> pa.Table:
        block = Block(x["text"])
        word, pair, context = lookup(block, a.to_pandas(), "kept")
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where(word > 0, np.log(word / max(n, 1) * (v + 1)), -np.inf)
            two = np.where(pair > 0, np.log(pair / context * (v + 1)), -np.inf)
        cell = lambda r: np.where(np.isfinite(r), np.round(r / CELL), -(2**15)).astype(np.int64)
        key = (bucket(context).astype(np.int64) << 40) | (cell(one) + 2**16 << 20) | cell(two) + 2**16
        keys, count = np.unique(key, return_counts=True)
        return pa.table({"b": keys >> 40, "one": (keys >> 20 & 0xFFFFF) - 2**16, "two": (keys & 0xFFFFF) - 2**16, "n": count})

    deleted = own.where("role = 1").groupBy("block").cogroup(answers.where(F.col("block") >= first).groupBy("block"))
    cells = deleted.applyInArrow(ratios, "b long, one long, two long, n long")
    cells = cells.groupBy("b", "one", "two").agg(F.sum("n").alias("n")).orderBy("b", "one", "two").toPandas()
    return expect(cells)


def expect(cells: pd.DataFrame) -> np.ndarray:
    """Expectation-maximisation in each bucket, from and lightly held to what all buckets together learn."""
    ratio = lambda c: np.where(c <= -(2**15), 0.0, np.exp(np.clip(c * CELL, -60, 60)))
    p = np.stack([np.ones(len(cells)), ratio(cells["one"].to_numpy()), ratio(cells["two"].to_numpy())], axis=1)
    n, b = cells["n"].to_numpy(float), cells["b"].to_numpy()

    def run(at: np.ndarray, start: np.ndarray, hold: float) -> np.ndarray:
        w = start
        for _ in range(ROUNDS):
            share = p[at] * w
            share /= share.sum(axis=1, keepdims=True)
            w = (n[at] @ share + hold * start) / (n[at].sum() + hold)
        return w

    start = np.array([0.1, 0.6, 0.3])
    every = run(np.arange(len(cells)), start, 1.0) if len(cells) else start
    out = np.stack([run(np.flatnonzero(b == k), every, 20.0) if (b == k).any() else every for k in range(BUCKETS)])
    out[0, :2] /= out[0, :2].sum()  # no context, no bigram estimate
    out[0, 2] = 0
    return out


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half
    unigrams) and score (the interpolated model), both log10 probabilities of the whole text with its end.

    Null texts are empty: the end alone. Rows without a doc_id are scored, not learned from, and not called held out. Repeated
    rows count and are scored each; other columns don't matter. Very long texts are blocks of their own. An empty table gives an empty result.
    """
    own, n_blocks, first = blocks(docs)
    answers = counted(own, n_blocks)
    sums = answers.where("block = -1 AND kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "kept_n", "kept_v")]).first()
    n, v, kept_n, kept_v = map(int, sums)
    weights = learn(own, answers, first, kept_n, kept_v)

    def rate(x: pa.Table, a: pa.Table) -> pa.Table:
        block = Block(x["text"])
        word, pair, context = lookup(block, a.to_pandas(), "total")
        w = weights[bucket(context)]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = w[:, 0] / (v + 1) + w[:, 1] * (word / max(n, 1)) + w[:, 2] * np.where(context > 0, pair / context, 0.0)
        add = lambda y: np.add.reduceat(y, block.starts)
        found = {"n_tokens": block.sizes, "n_known": add((word > 0).astype(np.int64)), "base_score": add(np.log10((word + 0.5) / (n + 0.5 * (v + 1)))), "score": add(np.log10(p))}
        return pa.table({"doc_id": x["doc_id"], "held_out": x["held_out"], **found})

    rated = own.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
