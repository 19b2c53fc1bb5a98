"""Substring deduplication by sliding sentence spans.

Every run of two consecutive sentences is hashed, so every longer run is covered by those within it. As a passage may also be repeated from within one
sentence into another, long sentences are cut into pieces by their content, and runs of pieces are hashed too: from each piece the shortest one that is
long enough, and to each piece the shortest one before it, so that a repeated passage is covered up to both of its ends. Runs are joined over
the whole corpus by hash, and the sentences and pieces that any run covers other than the run's first occurrence go.

A task sends only the first place of each hash it met, as packed columns by ranges of the hash; places behind that are
repeats whatever the others hold. So a passage that is everywhere meets once for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, cut, replaced, scratch, table, texts_of
from .words import LOWER, U8, blobs_by_part, by_place, cut_up, mixed, packed, powers, trim, unpacked, words

#: A run of two whole sentences has so many words at least (parameter `least`; 1: no bound). Shorter ones, such as two entries of a list or "Yes. No.", stay.
LEAST = 8

#: A run of pieces has this many pieces and words at least, or, whatever its pieces, so many words.
SENTENCES, WORDS, LONG = 2, 24, 40

#: A sentence of more words is cut behind the word of the least hash of every WINDOW words in a row, so that copies of a part are cut alike and no
#: piece has more words than that (parameter `most`; None: no cuts). A repeat of 48 words or more, wherever it begins, loses 12 at most at each end and holds a shared run.
MOST_WORDS, WINDOW = 12, 10

RUNS = 250_000  # of a part of the hash range, about, and joined within a task at once
RUN_BYTES = 16  # of text for each run, about

ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


class Sentences:
    """The sentences of some whole texts, those of more than `most` words cut: first word, first byte, text and sentence of each piece. A sentence
    ends behind . ! or ? before white space, or at a line's end."""

    def __init__(self, low: np.ndarray, off: np.ndarray, most: int | None = MOST_WORDS):
        begin, end, self.hashes = words(low, off)
        n = len(begin)
        text = np.searchsorted(off, begin, "right") - 1
        feeds = np.flatnonzero(low == 10)
        last = np.ones(n, bool)
        last[:-1] = ENDS[low[end[:-1] - 1]] | (np.searchsorted(feeds, end[:-1]) < np.searchsorted(feeds, begin[1:])) | (text[1:] != text[:-1])
        which = np.cumsum(last) - last
        if most is not None and n >= WINDOW:
            long = np.bincount(which)[which] > most
            ends = np.flatnonzero(long[WINDOW - 1 :] & (which[WINDOW - 1 :] == which[: n - WINDOW + 1])) + WINDOW - 1
            back = np.stack([self.hashes[ends - k] for k in range(WINDOW)]).argmin(axis=0) if len(ends) else ends  # the last of equal ones
            last[ends - back] = True
        self.first = np.r_[0, np.flatnonzero(last) + 1][: int(last.sum())]
        self.bound = np.r_[self.first, n]
        self.text, self.begin, self.sentence = text[self.first], begin[self.first], which[self.first]
        self.from_, self.to = (np.searchsorted(self.text, self.text, side) for side in ("left", "right"))

    def runs(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first piece, last one) of the runs of all texts; pieces count on from text to text."""
        at, n = self.bound, len(self.first)
        i = np.arange(n)
        j = np.minimum(np.searchsorted(at, at[:n] + LONG), np.maximum(np.searchsorted(at, at[:n] + WORDS), i + SENTENCES))  # the shortest from i ends before j
        one = j <= self.to
        k = np.maximum(np.searchsorted(at, at[1:] - LONG, "right"), np.minimum(np.searchsorted(at, at[1:] - WORDS, "right"), i + 2 - SENTENCES)) - 1  # the shortest to i begins at k
        two = k >= self.from_
        heads = np.flatnonzero(np.diff(self.sentence, prepend=-1))  # each sentence's first piece
        begin, end = heads[:-1], np.append(heads[2:], n)[: max(0, len(heads) - 1)]  # two sentences one after the other
        whole = (self.text[begin] == self.text[end - 1]) & (at[end] - at[begin] >= least)
        pairs = np.unique(np.r_[i[one] * (n + 1) + j[one], k[two] * (n + 1) + i[two] + 1, begin[whole] * (n + 1) + end[whole]])
        i, j = pairs // (n + 1), pairs % (n + 1)
        power, inverse = powers(len(self.hashes) + 1)
        sums = np.r_[np.zeros(1, U8), np.cumsum(self.hashes * power[: len(self.hashes)])]
        size = at[j] - at[i]
        return mixed((sums[at[j]] - sums[at[i]]) * inverse[at[i]] + size.astype(U8)), i, j - 1


#: A run: its hash, the place of its text, its first and last piece there.
FIELDS = {"hash": "<u8", "doc": "<i8", "nth": "<i8", "first": "<i4", "last": "<i4"}


def behind_first(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are each hash's first place, and rows of other places; rows that repeat a place are left out."""
    order = np.argsort(x["hash"])
    h = x["hash"][order]
    other = np.ones(len(h) + 1, bool)
    other[1:-1] = h[1:] != h[:-1]
    alone = other[:-1] & other[1:]
    several = order[~alone]
    several = several[by_place(x["doc"][several], x["nth"][several], x["first"][several])]
    several = several[np.argsort(x["hash"][several], kind="stable")]
    h, doc, nth, first = (x[c][several] for c in ("hash", "doc", "nth", "first"))
    head, place = np.ones(len(h), bool), np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    place[1:] = head[1:] | (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (first[1:] != first[:-1])
    return np.r_[order[alone], several[head]], several[place & ~head]


def spans(texts: DataFrame, bits: int, least: int, most: int | None) -> DataFrame:
    """(part, n, blob): the runs of texts (doc_id, nth, text): of those that a task met the first place of each hash, by 2^bits parts of the hash range; the
    other places as part -1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, nth = (batch.column(k).to_numpy() for k in (0, 1))
            for a, _, low, off in cut_up(batch.column(2)):
                s = Sentences(low, off, most)
                h, i, j = s.runs(least)
                of = s.text[i]
                held.append({"hash": h, "doc": doc[a + of], "nth": nth[a + of], "first": i - s.from_[i], "last": j - s.from_[i]})
                n += len(h)
                if n > RUNS:
                    yield sent(held)
                    held, n = [], 0
                    trim()
        if n:
            yield sent(held)
        held = None
        trim()

    def sent(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {f: np.concatenate([y[f] for y in held]) for f in FIELDS}
        first, again = behind_first(x)
        part = np.full(len(x["hash"]), -1, np.int32)
        part[first] = (x["hash"][first] >> U8(64 - bits)).astype(np.int32)
        x["part"] = part
        order = first[np.argsort(x["hash"][first])]
        part, n, blobs = blobs_by_part(x, FIELDS, order)
        if len(again):
            part, n, blobs = np.append(part, np.int32(-1)), np.append(n, len(again)), [*blobs, packed(x, FIELDS, again)]
        return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "n": pa.array(n, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return texts.mapInArrow(each, "part int, n long, blob binary")


PLACES = "doc_id long, nth long, first int, last int"


def places(x: dict[str, np.ndarray], keep) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": x["doc"][keep], "nth": x["nth"][keep], "first": x["first"][keep], "last": x["last"][keep]})


def repeated(texts: DataFrame, least: int = LEAST, most: int | None = MOST_WORDS) -> DataFrame:
    """(doc_id, nth, first, last): the runs whose text came before, in an earlier text (smaller doc_id, then nth) or earlier in their own."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["blob"]:
                yield places(unpacked([blob], FIELDS), slice(None))

    def join(x: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(x["blob"].tolist(), FIELDS)
        out = places(x, behind_first(x)[1])
        del x
        trim()
        return out

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = cut(spans(texts, max(3, (size // RUN_BYTES // RUNS).bit_length()), least, most))
    return sent.where("part < 0").mapInPandas(told, PLACES).unionByName(sent.where("part >= 0").groupBy("part").applyInPandas(join, PLACES))


def without(texts: list[str], covered: list[list[tuple[int, int]]], most: int | None = MOST_WORDS) -> list[str]:
    """Each text without the pieces that are covered; what follows a piece up to the next one goes with it."""
    out: list[str] = []
    for a, b, own, off in cut_up(pa.array(texts, pa.large_string()), lower=False):
        s, keep = Sentences(LOWER[own], off, most), np.ones(len(own), bool)
        starts, counts = np.searchsorted(s.text, np.arange(b - a)), np.bincount(s.text, minlength=b - a)
        for k in range(b - a):
            gone = np.zeros(counts[k] + 1, np.int64)
            for i, j in covered[a + k]:
                gone[i] += 1
                gone[j + 1] -= 1
            bounds = np.r_[s.begin[starts[k] : starts[k] + counts[k]], off[k + 1]]
            for m in np.flatnonzero(np.cumsum(gone)[:-1]):
                keep[bounds[m] : bounds[m + 1]] = False
            out.append(own[off[k] : off[k + 1]][keep[off[k] : off[k + 1]]].tobytes().decode("utf-8", "replace"))
    return out


def dedup(docs: DataFrame, least: int = LEAST, most: int | None = MOST_WORDS) -> DataFrame:
    """docs with its columns, whatever their names, repeated passages gone from text; every row stays, with what is left of its text (perhaps
    none). n_chars, if there, is the new length. least: words of two sentences that are a run; most: words of a sentence beyond which it is cut, None
    for whole sentences only.

    A-Z count as in lower case, and any ASCII white space alike. Null and empty texts and rows without a doc_id stay as they are. Rows that repeat a
    doc_id and its text are one document: they are occurrences at the same place, and lose the same sentences. Rows that repeat
    a doc_id with other texts are documents of their own. Very long texts are cut into sentences as any other. An empty table stays empty.
    """
    own = apart(docs)
    with scratch():
        covered = repeated(texts_of(own), least, most).groupBy("doc_id", "nth").agg(F.collect_list(F.struct("first", "last")).alias("covered"))  # bounded by the document
        covered = cut(covered.select(F.col("doc_id").alias("covered_id"), F.col("nth").alias("covered_nth"), "covered"), keep=True)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        some = [k for k, f in enumerate(firsts) if f is not None]
        out = pd.Series([None] * len(texts), dtype=object)
        for k, text in zip(some, without([texts.iloc[k] for k in some], [list(zip(firsts.iloc[k], lasts.iloc[k])) for k in some], most)):
            out.iloc[k] = text
        return out

    changed = F.col("covered").isNotNull()
    joined = own.join(covered, (F.col("doc_id") == F.col("covered_id")) & (F.col("nth") == F.col("covered_nth")), "left")
    return replaced(joined, docs, changed, rest(F.when(changed, F.col("row.text").cast("string")), F.col("covered.first"), F.col("covered.last")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
