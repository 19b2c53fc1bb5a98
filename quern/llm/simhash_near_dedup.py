"""SimHash near-duplicates: fingerprints within a Hamming distance, found by pigeonring filtering.

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two differ in at most t = 4 bits, the
ring holds a segment from which every chain of l consecutive segments differs in at most l * t / 8
bits, rounded down: none in the first, at most one in the first three, two in the first five, and so
on. Candidates share the first segment and three of four quarters of the next two (a single
difference leaves three quarters alike), for one of 8 starts and 4 quarters left out: 32 keys
of 20 equal bits. The longer chains prune them before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, partitions, scratch, table
from .words import trim

WORDS, DISTANCE = 4, 4
SEGMENTS, BITS = 8, 8
#: Fingerprints of one key that a task compares with each other; more are split and compared part by part.
TOGETHER = 20_000
#: Up to so many of a key all pairs are compared at once.
FEW = 48


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included. No words (null, empty or blank): 0.
    Fewer words than a shingle has: the whole sequence is the only shingle."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    starts, hashed = (ends - sizes)[: len(own) - words + 1].tolist(), xxhash.xxh64_intdigest
    h = np.array([hashed(joined[x:y], 42) for x, y in zip(starts, ends[words - 1 :].tolist())], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, one row for each row of docs."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))
        trim()
        return out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), each(F.col("text").cast("string")).alias("fp"))


def keys(fp: str = "fp") -> F.Column:
    """The 32 keys of a fingerprint: start and quarter left out above 24 bits of the ring."""
    out = []
    for start in range(SEGMENTS):
        turned = F.shiftleft(fp, BITS * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * start)) if start else F.col(fp)
        top = F.shiftrightunsigned(turned, 40)
        for quarter in range(4):
            mask = 0xFFFFFF & ~(0xF << 4 * quarter)
            out.append(top.bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit((4 * start + quarter) << 24).cast("long")))
    return F.array(*out)


def near(x: np.ndarray, start: np.ndarray | int, distance: int = DISTANCE) -> np.ndarray:
    """Which XORs of fingerprints pass the chains from segment `start` and, last, the full distance."""
    s = np.asarray(start, np.uint64) * np.uint64(BITS)
    x = x << s | x >> (np.uint64(64) - s) % np.uint64(64)
    ok = np.arange(len(x))
    for chain in (3, 5, 7, 8):
        ok = ok[np.bitwise_count(x[ok] >> np.uint64(64 - BITS * chain)) <= chain * distance // SEGMENTS]
    found = np.zeros(len(x), bool)
    found[ok] = True
    return found


def stars(fp: np.ndarray, rep: np.ndarray, start: int, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the fingerprints of one key (with `other`: only
    across the two parts count, but links within a part are right too): a search that compares each
    found fingerprint with those not found yet, so a dense group costs no more than its size times
    what lies outside it. Gives (smallest rep of a component, its members)."""
    left = np.arange(len(fp))
    while len(left):
        found, wait, left = [left[0]], [left[0]], left[1:]
        while wait and len(left):
            hit = near(fp[left] ^ fp[wait.pop()], start)
            new = left[hit]
            if len(new):
                found += new.tolist()
                wait += new.tolist()
                left = left[~hit]
        if len(found) > 1:
            own = rep[found]
            yield np.full(len(own), own.min()), own


def links(reps: DataFrame) -> DataFrame:
    """(a, b) of rep ids whose fingerprints are near or connected through others of their key; reps: distinct (fp, rep)."""
    keyed = reps.select("fp", "rep", F.explode(keys()).alias("key"))
    # Sizes come from one fingerprint in 64: they decide how a key is split, never what is compared.
    some = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0)
    crowded = cut(some.groupBy("key").agg((64 * F.count("*")).alias("n")).where(F.col("n") > TOGETHER))
    if crowded.head(1):  # parts of a crowded key, and each two of them together
        parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(TOGETHER / 2)).cast("int")
        part = F.pmod(F.xxhash64("fp"), parts).cast("int")
        keyed = (
            keyed.join(crowded, "key", "left").withColumn("parts", parts).withColumn("part", part)
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("fp", "rep", "key", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"))
        )
    else:
        keyed = keyed.withColumns({"one": F.lit(0), "two": F.lit(0)})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            k = x[["key", "one", "two"]].to_numpy()
            last = int(np.flatnonzero((k != k[-1]).any(axis=1)).max(initial=-1)) + 1
            rest = x.iloc[last:]
            if last:
                yield compare(x.iloc[:last])
        if rest is not None:
            yield compare(rest)

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        fp, rep, k = x["fp"].to_numpy().view(np.uint64), x["rep"].to_numpy(), x[["key", "one", "two"]].to_numpy()
        start = k[:, 0] >> 26
        begins = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[begins, len(k)])
        a, b = [], []
        group = np.repeat(np.arange(len(begins)), sizes)
        few = np.flatnonzero((sizes[group] <= FEW) & (sizes[group] > 1))
        for shift in range(1, min(FEW, int(sizes.max(initial=0)))):
            few = few[few + shift < len(k)]
            few = few[group[few] == group[few + shift]]
            if not len(few):
                break
            hit = few[near(fp[few] ^ fp[few + shift], start[few])]
            a.append(rep[hit])
            b.append(rep[hit + shift])
        for g in np.flatnonzero(sizes > FEW):
            at = slice(begins[g], begins[g] + sizes[g])
            for least, own in stars(fp[at], rep[at], int(start[begins[g]])):
                a.append(least)
                b.append(own)
        out = pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})
        return out[out["a"] != out["b"]].drop_duplicates()

    n = partitions(reps.sparkSession)
    return keyed.repartition(n, "key", "one", "two").sortWithinPartitions("key", "one", "two").mapInPandas(together, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp (signed long) and component_id, the
    smallest doc_id reachable over links of at most 4 differing bits.

    Null, empty and blank texts have fingerprint 0, linked like any other. A row without a doc_id links nothing and
    has the component of its fingerprint, null if that is of such rows alone. Equal fingerprints
    (a repeated row, copies) are one node, so a group of copies never meets in a task. Very long texts are hashed
    whole. Other columns don't matter. An empty table gives an empty result.
    """
    own = cut(fingerprints(docs, words))
    reps = cut(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    with scratch():
        joined = components(links(reps))
        known = reps.join(joined, reps["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        known = cut(known, keep=True)
    return own.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near-duplicates, all columns as they were.
    Rows that repeat a kept doc_id are one document and stay, as do rows without a doc_id."""
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), words)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
