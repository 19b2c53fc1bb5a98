"""Best-fit packing of tokenised documents into sequences of bounded length.

Best-fit decreasing: pieces are placed from the longest to the shortest, each into the open
sequence with the least room that still holds it. Pieces of one length are interchangeable, so
the driver plans on the histogram of lengths (at most `capacity` rows whatever the corpus) and on
groups of sequences with the same room, found by a segment tree over the rooms. Executors
look up where the n-th piece of a length goes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .words import trim

CAPACITY = 4096
EOS = 1
#: Words whose ids a worker keeps; beyond it starts anew.
KEPT_WORDS = 400_000


def _as_char(byte: int) -> str:
    """A byte in the alphabet of byte-level vocabularies: itself if it prints in Latin-1, else the next free character from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in prints else chr(0x100 + [x for x in range(256) if x not in prints].index(byte))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """Token ids, as little-endian unsigned 32-bit integers, of chunks without blanks.

    The vocabulary's pre-tokenizer never lets a token cross white space and its normalizer
    acts on either side of it alone, so the ids of a text are those of its chunks in a row.
    A chunk of Latin letters with a run of plain marks behind it is a word and the marks: the
    word goes to the model in the model's byte alphabet. Any other goes through the whole
    tokenizer.
    """

    plain = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?|*#%&$]*)").fullmatch
    #: A byte-level vocabulary writes the two bytes of these letters as the characters of the same numbers, those up to U+00AD shifted.
    latin = str.maketrans({chr(c): "".join(_as_char(x) for x in chr(c).encode()) for c in range(0xC0, 0x100)})

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}

    def other(self, chunk: str) -> bytes:
        ids = self.others.get(chunk)
        if ids is None:
            ids = np.array(self.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.others) >= KEPT_WORDS // 4:
                self.others = {"": b""}
            self.others[chunk] = ids
        return ids

    def ids(self, chunk: str) -> bytes:
        found = self.plain(chunk)
        if not found:
            return self.other(chunk)
        word, marks = found.groups()
        word = word.lower()
        ids = self.words.get(word)
        if ids is None:
            ids = np.array([t.id for t in self.model(word if word.isascii() else word.translate(self.latin))], "<u4").tobytes()
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids + self.other(marks) if marks else ids

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text: the distinct chunks of all are looked up once, then gathered."""
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        coded = lists.flatten().dictionary_encode()
        known = [self.ids(x) for x in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, starts, codes = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]].tolist()
        return [out[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(batch: pa.RecordBatch, text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most, prepend=0))
    bounds = [0, *cuts.tolist(), batch.num_rows]
    return (batch.slice(x, y - x) for x, y in zip(bounds, bounds[1:]) if y > x)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): the pieces of all documents.
    part and nth number the pieces of a length within their partition."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = vocabulary(tokenizer), np.array([eos], "<u4").tobytes()
        part, seen, step = pyspark.TaskContext.get().partitionId(), [0] * (capacity + 1), 4 * capacity
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode_all(pc.fill_null(batch.column(1), ""))):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        n = len(own) // 4
                        out.append((doc_id, k, k * capacity, n, zlib.crc32(own), part, seen[n], *[own] * with_ids))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in schema.split(", ")])
                del out
                trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


class Rooms:
    """Groups of open sequences by room, and a segment tree that finds the least room of some size or more."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.n)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.groups.setdefault(room, []).append((first, count))
        i = room + self.n
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        own = self.groups[room]
        found = own.pop()
        if not own:
            i = room + self.n
            self.any[i] = 0
            while i > 1:
                i >>= 1
                if self.any[2 * i] or self.any[2 * i + 1]:
                    break
                self.any[i] = 0
        return found

    def least(self, size: int) -> int:
        """The least room >= size that is open, or -1."""
        i = size + self.n
        if self.any[i]:
            return size
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on counts of lengths. Rows (length, first rank, first sequence,
    pieces in each, offset), ordered by length and rank: piece `rank` of a length goes to
    sequence first + (rank - first rank) // each, at offset + (rank - first rank) % each * length.
    Filling the sequence with the least room until it is too small is what best-fit
    does with equal pieces, since after the first its room is smaller still."""
    rooms, runs, opened = Rooms(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.least(length)
            if room < 0:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = rooms.pop(room)
            each = room // length
            full = min(count, left // each)
            some = min(left - full * each, each) if full < count else 0
            runs.append((length, rank, first, each, capacity - room))
            rank, left = rank + full * each + some, left - full * each - some
            if full:
                rooms.add(room - each * length, first, full)
            if some:
                rooms.add(room - some * length, first + full, 1)
            if count > full + (some > 0):
                rooms.add(room, first + full + (some > 0), count - full - (some > 0))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` tokens.

    Null and empty texts are the end token alone; repeated rows are packed each; other
    columns don't matter. An empty table gives an empty result. with_ids adds the ids
    themselves (little-endian unsigned 32-bit).

    The pieces are written once, so that their numbering within a partition holds however
    often a task runs again. Ranks over all partitions come from sums over (length,
    partition), never from one task that sees every piece of a length.
    """
    pieces = cut(tokenise(docs, tokenizer or default_tokenizer(), capacity, eos, with_ids))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    firsts = runs[:, 0] << 48 | runs[:, 1]  # a length's ranks stay below 2^48

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(firsts, length << 48 | rank, "right") - 1]
        nth = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * length})

    placed = pieces.join(starts.drop("n"), ["length", "part"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
