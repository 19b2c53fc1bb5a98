"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity: by the corpus count of their cell, one of 2^24 that words
are hashed into, and then by hash; so rare words come first whatever the vocabulary, and frequent ones last. Two sets of
Jaccard 0.8 or more share one of the first n - ceil(0.8 n) + 1 words of each, so lines meet under these words only; lengths,
the positions of the shared word and parity sketches of 64 bits, of 128 for long lines, rule out most lines that meet, and the words of the rest
are compared. Only lines of near lengths are tried. A line goes if any line before it matches.

Equal lines are one from the start: only the first of them is posted. Postings travel as packed columns, one blob for each
task and range of word hashes. One earlier match settles a line, so the first round compares only its nearest candidates;
lines that found no match so and have more candidates go on to rounds with many times as many, until none is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, cut, replaced, scratch, table, texts_of
from .words import U8, Piece, blobs_by_part, by_place, hash_of, mixed, packed, pieces, planes, rows_in, trim, unpacked, whole

#: Jaccard similarity of 4 / 5 or more, in whole numbers throughout.
NUM, DEN = 4, 5
CELL_BITS, CHUNK_BITS = 24, 16  # of the table of word counts, and of a chunk of it
MERGED = 64  # chunks of counts added up in one task
TABLE_BITS = 27  # of a table that tells which hashes may be worth a row: 16 MB however large the corpus
FULL = 1 << 24  # keys in such a table of repeated lines; if there are more, those repeated most
POSTINGS = 200_000  # of a part of the word hashes, about
CROWDED = 4 * POSTINGS  # a part with more is dealt by word
NEAREST = 3  # candidates of a line that the first round compares
GROWTH, PAIRS = 16, 8  # of the candidates of a line from round to round at least, and pairs of a later round for each distinct line
#: Up to FEW lines under a word all pairs of near lengths are tried at once, those of many words together, about TRIED; more than TOGETHER are split and tried part by part.
FEW, TRIED, TOGETHER = 512, 1 << 18, 20_000

def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def long(x) -> np.ndarray:
    return np.asarray(x, U8).view(np.int64)


class Table:
    """An array that travels to the tasks compressed."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getstate__(self) -> bytes:
        return zlib.compress(self.values.tobytes(), 1)

    def __setstate__(self, data: bytes) -> None:
        self.values = np.frombuffer(zlib.decompress(data), np.uint8)


def bit_table(df: DataFrame, column: str, keys: int, spare: int = 6) -> Table:
    """The places of a column's hashes as bits, packed; keys: how many hashes there are at most. A hash that isn't in the column may have its bit
    set (one in 2^spare, until the table is as large as it may be); never the other way round."""
    bits = min(TABLE_BITS, max(15, keys.bit_length() + spare))
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    parts = df.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(1 << bits - 3, np.uint8)
    for part, own in parts:
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(own, np.uint8)
    return Table(out)


def known(table: Table, h: np.ndarray) -> np.ndarray:
    bits = len(table.values).bit_length() + 2
    place = h >> U8(64 - bits)
    return table.values[(place >> U8(3)).view(np.int64)] >> (place & U8(7)).astype(np.uint8) & 1 > 0


def rarity(counts: DataFrame) -> Table:
    """The class of each cell of words by what is counted in it in all texts: 0 for none, 1 for one word that is there once, and four
    classes for each doubling from two on. What tasks sent is added up by MERGED at once, so no task meets those of all others."""

    def add(x: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(1 << CHUNK_BITS, U8)
        for cells, counts in zip(x["cells"], x["n"]):
            n[np.frombuffer(cells, "<u2")] += whole(counts, "<u8")
        met = np.flatnonzero(n)
        return pd.DataFrame({"task": x["task"].iloc[:1] // MERGED, "chunk": x["chunk"].iloc[:1], "cells": [met.astype("<u2").tobytes()], "n": [planes(n[met])]})

    schema = "task int, chunk int, cells binary, n binary"
    while True:
        last = (counts.agg(F.max("task")).first()[0] or 0) < MERGED
        counts = cut(counts.groupBy((F.col("task") / MERGED).cast("int").alias("by"), "chunk").applyInPandas(lambda _, x: add(x), schema))
        if last:
            break
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for r in counts.collect():  # at most one row for each chunk of the table
        n = whole(r["n"], "<u8").astype(float)
        out[(r["chunk"] << CHUNK_BITS) + np.frombuffer(r["cells"], "<u2").astype(np.int64)] = np.minimum(np.where(n < 2, n, 2 + np.floor(4 * np.log2(np.maximum(n, 2) / 2))), 250)
    return Table(out)


#: A posting: 32 bits of the word's hash behind those of its part, the line's place, its words, the place of this one among them, a sketch, and
#: for a line of more than LONG words, whose 64 parities tell little, those of one half of its words; sketch ^ wide are then those of the others.
FIELDS = {"token": "<u4", "doc": "<i8", "nth": "<i8", "line": "<i4", "n": "<i4", "pos": "<i4", "sketch": "<u8", "wide": "<u8"}
LONG = 64
PLACED = ("token", "doc", "nth", "line", "n")


def place(x: dict[str, np.ndarray]) -> np.ndarray:
    return hash_of(x["doc"], x["nth"], x["line"])


def seen(texts: DataFrame) -> DataFrame:
    """(sig, doc_id, nth, line) of all lines with words, sig a line's hash; and, with a null sig, (task, chunk, cells, n): how often each task met words of which cells, by chunks of the cells."""
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int64()), ("line", pa.int32()), ("task", pa.int32()), ("chunk", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())])

    def filled(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.uint32)
        for p in pieces(batches):
            sig = p.sigs()
            some = np.flatnonzero(sig)
            yield filled(len(some), sig=long(sig[some]), doc_id=p.doc[some], nth=p.nth[some], line=p.line[some].astype(np.int32))
            *_, h = p.words()
            np.add.at(n, (h >> U8(64 - CELL_BITS)).view(np.int64), np.uint32(1))
        met = np.flatnonzero(n)
        bounds = np.searchsorted(met, np.arange((1 << CELL_BITS - CHUNK_BITS) + 1) << CHUNK_BITS)
        some = np.flatnonzero(np.diff(bounds))
        met, n = (met & (1 << CHUNK_BITS) - 1).astype("<u2"), n[met].astype("<u8")
        at = [slice(bounds[k], bounds[k + 1]) for k in some]
        yield filled(
            len(some), task=np.full(len(some), TaskContext.get().partitionId(), np.int32), chunk=some.astype(np.int32),
            cells=[met[s].tobytes() for s in at], n=[planes(n[s]) for s in at],
        )
        del n, met
        trim()

    return texts.mapInArrow(each, "sig long, doc_id long, nth long, line int, task int, chunk int, cells binary, n binary")


def posted_lines(firsts: DataFrame) -> tuple[Table, Table]:
    """Tables of repeated lines' hashes and of the first places of all lines whose hash may be in the former, repeated or not: a line whose hash may be
    in the one and whose place isn't in the other has come before for certain. Beyond FULL repeated lines these are the ones repeated most; the
    others, each there a bounded number of times, then match as any two lines."""
    by = firsts.where("n > 1").groupBy(F.floor(F.log2("n")).cast("int").alias("log")).agg(F.count("*").alias("lines")).orderBy(F.desc("log")).collect()
    least, lines = 2, 0
    for r in by:
        if lines + r["lines"] > FULL:
            least = 2 << r["log"]
            break
        lines += r["lines"]
    repeated = bit_table(firsts.where(F.col("n") >= least), "sig", lines)

    @F.pandas_udf("boolean")
    def may_be(sig: pd.Series) -> pd.Series:
        return pd.Series(known(repeated, sig.to_numpy(np.int64).view(U8)))

    marked = firsts.where(may_be("sig")).select(F.xxhash64("at.doc_id", "at.nth", F.col("at.line").cast("long")).alias("place"))
    return repeated, bit_table(marked, "place", lines + firsts.count() * lines // (8 * len(repeated.values)))


def postings(texts: DataFrame, classes: Table, repeated: Table, firsts: Table, bits: int) -> DataFrame:
    """(part, n, blob): n postings of the lines that aren't known to have come before, under those words of their prefix that are there more than once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for p in pieces(batches):
            held.append(own(p))
            n += len(held[-1]["token"])
            if n > POSTINGS // 2:
                yield by_part(held)
                held, n = [], 0
        if n:
            yield by_part(held)

    def own(p: Piece) -> dict[str, np.ndarray]:
        sig = p.sigs()
        new = (sig != 0) & (~known(repeated, sig) | known(firsts, hash_of(p.doc, p.nth, p.line)))
        begin, _, h = p.words()
        line = np.repeat(np.arange(len(p.begin)), np.diff(np.searchsorted(begin, p.begin), append=len(begin)))
        mine = new[line]
        line, h = line[mine], h[mine]
        tier = classes.values[(h >> U8(64 - CELL_BITS)).view(np.int64)]
        key = line.astype(U8) << U8(42) | tier.astype(U8) << U8(34) | h >> U8(30)
        order = np.argsort(key)
        sorted_key, line, tier, h = key[order], line[order], tier[order], h[order]
        if len(p.begin) >> 22 or ((sorted_key[1:] == sorted_key[:-1]) & (h[1:] != h[:-1])).any():  # more than the key holds
            order = np.lexsort((h, tier, line))
            line, tier, h = line[order], tier[order], h[order]
        other = np.ones(len(h), bool)
        other[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        line, tier, h = line[other], tier[other], h[other]
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        size = np.diff(heads, append=len(line))
        pos = np.arange(len(line)) - np.repeat(heads, size)
        sketch = np.bitwise_xor.reduceat(U8(1) << (h & U8(63)), heads) if len(heads) else np.zeros(0, U8)
        wide = np.bitwise_xor.reduceat((h >> U8(6) & U8(1)) << (h & U8(63)), heads) if len(heads) else np.zeros(0, U8)
        wide[size <= LONG] = 0
        n = np.repeat(size, size)
        keep = np.flatnonzero((pos < n - (NUM * n + DEN - 1) // DEN + 1) & (tier > 1))
        at = line[keep]
        h = h[keep]
        return {
            "part": (h >> U8(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32), "token": (h >> U8(32 - bits)).astype(np.uint32),
            "doc": p.doc[at], "nth": p.nth[at], "line": p.line[at].astype(np.int32), "n": n[keep].astype(np.int32), "pos": pos[keep].astype(np.int32), "sketch": np.repeat(sketch, size)[keep],
            "wide": np.repeat(wide, size)[keep],
        }

    def by_part(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {f: np.concatenate([y[f] for y in held]) for f in held[0]}
        part, n, blobs = blobs_by_part(x, FIELDS, np.argsort(x["part"].astype(U8) << U8(32) | x["token"]))
        return rows(part=part, n=n, blob=pa.array(blobs, pa.binary()))

    return texts.mapInArrow(each, "part int, n long, blob binary")


def crowded_parts(posted: DataFrame) -> DataFrame | None:
    """(part) of the parts with more postings than one task takes, if there are any."""
    crowded = cut(posted.groupBy("part").agg(F.sum("n").alias("size")).where(F.col("size") > CROWDED).select("part"))
    return crowded if crowded.head(1) else None


def dealt(posted: DataFrame, crowded: DataFrame | None, words: Table | None) -> DataFrame:
    """(part, sub, one, two, block, blob): postings, with `words` those that these let pass, dealt into groups (part, sub, one, two) of bounded size that
    hold every pair of postings of a word together. A part is one group; a crowded one is dealt by word, and a word of more than TOGETHER
    postings into blocks, each two of which are a group, in which only postings of different blocks count if these differ."""
    zero = F.lit(0).cast("long")
    schema = "part int, sub long, one int, two int, block int, blob binary"
    own = lambda df: df if words is None else meeting(df, words)
    easy = own(posted if crowded is None else posted.join(crowded, "part", "left_anti"))
    easy = easy.select("part", zero.alias("sub"), *[F.lit(0).alias(c) for c in ("one", "two", "block")], "blob")
    if crowded is None:
        return easy

    def by_word(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, blob in zip(batch["part"], batch["blob"]):
                x = unpacked([blob], FIELDS)
                order = np.argsort(x["token"], kind="stable")
                token = x["token"][order]
                heads = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
                bounds = np.append(heads, len(token))
                yield pd.DataFrame({"part": part, "token": token[heads].astype(np.int64), "n": np.diff(bounds), "blob": [packed(x, FIELDS, order[a:b]) for a, b in zip(bounds, bounds[1:])]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x, most = unpacked([r.blob], FIELDS), -(-2 * r.size // TOGETHER)
                block = place(x) % U8(most)
                for b in np.unique(block).astype(int):
                    other = np.arange(most, dtype=np.int32)
                    yield pd.DataFrame({"part": r.part, "sub": -1 - r.token, "one": np.minimum(b, other), "two": np.maximum(b, other), "block": b, "blob": packed(x, FIELDS, block == b)})

    split = cut(own(posted.join(crowded, "part", "left_semi")).mapInPandas(by_word, "part int, token long, n long, blob binary"))
    hot = cut(split.groupBy("part", "token").agg(F.sum("n").alias("size")).where(F.col("size") > TOGETHER))
    rest = split.join(hot, ["part", "token"], "left_anti").select("part", (F.col("token") % 4096 + 1).alias("sub"), *[F.lit(0).alias(c) for c in ("one", "two", "block")], "blob")
    return easy.unionByName(rest).unionByName(split.join(hot, ["part", "token"]).mapInPandas(blocks, schema))


def least_shared(n: np.ndarray) -> np.ndarray:
    """The words that two lines of n words together must share."""
    return -(-NUM * n // (NUM + DEN))


PAIR = "a_doc long, a_nth long, a_line int, b_doc long, b_nth long, b_line int, far int, more boolean"
A, B = ["a_doc", "a_nth", "a_line"], ["b_doc", "b_nth", "b_line"]


def candidates(groups: DataFrame, most: int, probes: Table | None) -> DataFrame:
    """(a_doc, a_nth, a_line, b_..., more): for the lines a whose place may be among the probes the first `most` lines b before them under each word that
    pass the filters; without probes, of those of all lines the NEAREST by their sketches. more: there are others. groups: dealt postings."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        blobs = group["blob"].tolist()
        x = unpacked(blobs, FIELDS)
        block = np.repeat(group["block"].to_numpy(), [rows_in(b) for b in blobs])
        across = group["one"].iloc[0] != group["two"].iloc[0]
        order = by_place(x["doc"], x["nth"], x["line"])
        order = order[np.argsort(x["token"][order].astype(U8) << U8(32) | np.arange(len(order), dtype=U8))]
        token = x["token"][order]
        alone = np.ones(len(token) + 1, bool)
        alone[1:-1] = token[1:] != token[:-1]
        order = order[~(alone[1:] & alone[:-1])]
        x, block = {f: y[order] for f, y in x.items()}, block[order]
        token, sketch, wide = x["token"], x["sketch"], x["wide"]
        n, pos = x["n"], x["pos"]
        least = least_shared(np.arange(2 * int(n.max(initial=0)) + 1, dtype=np.int32) if n.max(initial=0) < 1 << 17 else np.zeros(0, np.int32))
        shared = lambda n1n2: least[n1n2] if len(least) else least_shared(n1n2)
        probe = np.ones(len(n), bool) if probes is None else known(probes, place(x))
        begins = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
        sizes = np.diff(begins, append=len(token))
        which = np.repeat(np.arange(len(begins)), sizes)

        def far(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """How many parities differ: of all words, or of both halves of two long lines."""
            one, other = sketch[i] ^ sketch[j], wide[i] ^ wide[j]
            return np.where(np.minimum(n[i], n[j]) > LONG, np.bitwise_count(one ^ other) + np.bitwise_count(other), np.bitwise_count(one))

        def try_(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the pairs pass the sketches, the lengths and the positions of the shared word."""
            both = n[i] + n[j]
            ok = np.bitwise_count(sketch[i] ^ sketch[j]) <= both - 2 * shared(both)  # each word that only one has changes one bit of the parities
            at = np.nonzero(ok)
            i, j = (np.broadcast_to(y, ok.shape)[at] for y in (i, j))
            n1, n2 = n[i].astype(np.int64), n[j].astype(np.int64)
            close = far(i, j) <= n1 + n2 - 2 * shared(n1 + n2)
            fits = close & (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (np.minimum(n1 - pos[i], n2 - pos[j]) >= shared(n1 + n2))
            ok[at] = fits & (block[i] != block[j]) if across else fits
            return ok

        a, b, more = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
        few = np.flatnonzero(sizes[which] <= FEW)
        few = few[np.argsort(which[few].astype(U8) << U8(32) | n[few].astype(U8), kind="stable")]
        word, of = which[few].astype(np.int64) << 32, n[few].astype(np.int64)
        from_ = np.searchsorted(word | of, word | -(-NUM * of // DEN))  # the shortest line of each one's word that may match it; pairs are (it or one behind it, this one)
        upto = np.cumsum(np.arange(len(few)) - from_)
        ends = np.flatnonzero(np.diff(word, append=-1)) + 1
        begin = 0
        while begin < len(few):
            done = upto[begin - 1] if begin else 0
            end = ends[min(np.searchsorted(upto[ends - 1], done + TRIED), len(ends) - 1)]
            each = np.arange(begin, end) - from_[begin:end]
            one = few[begin:end].repeat(each)
            other = few[np.arange(len(one)) + (from_[begin:end] - (np.cumsum(each) - each)).repeat(each)]
            i, j = np.maximum(one, other), np.minimum(one, other)
            if probes is not None:
                i, j = i[probe[i]], j[probe[i]]
            ok = try_(i, j)
            i, j = i[ok], j[ok]
            by_line = np.lexsort((j, i))
            i, j = i[by_line], j[by_line]
            heads = np.flatnonzero(np.diff(i, prepend=-1))
            each = np.diff(heads, append=len(i))
            first = np.arange(len(i)) - np.repeat(heads, each) < most
            a.append(i[first])
            b.append(j[first])
            more.append(np.repeat(each > most, each)[first])
            begin = end
        for g in np.flatnonzero(sizes > FEW):
            begin = begins[g]
            lines = np.arange(begin, begin + sizes[g])
            length = of_length(n[lines]).astype(int)
            for own in np.unique(length):
                near, lines_own = lines[np.abs(length - own) <= 1], lines[length == own]
                for i0 in range(0, len(lines_own), 512):
                    i = lines_own[i0 : i0 + 512]
                    i = i[probe[i]]
                    got, pairs = np.zeros(sizes[g], np.int64), []
                    for j0 in range(0, len(near), 1024):
                        j = near[j0 : j0 + 1024]
                        if not len(i) or j[0] >= i[-1]:
                            break
                        ok = try_(i[:, None], j[None, :]) & (j[None, :] < i[:, None])
                        nth = got[i - begin][:, None] + ok.cumsum(axis=1)
                        p, q = np.nonzero(ok & (nth <= most))
                        pairs.append((i[p], j[q]))
                        got[i - begin] = nth[:, -1]
                        i = i[got[i - begin] <= most]
                    for p, q in pairs:
                        a.append(p)
                        b.append(q)
                        more.append(got[p - begin] > most)
        i, j, more = np.concatenate(a), np.concatenate(b), np.concatenate(more)
        trim()
        out = {"a_doc": x["doc"][i], "a_nth": x["nth"][i], "a_line": x["line"][i], "b_doc": x["doc"][j], "b_nth": x["nth"][j], "b_line": x["line"][j]}
        out = pd.DataFrame(out | {"far": far(i, j).astype(np.int32), "more": more})
        out = out[(out["a_doc"] != out["b_doc"]) | (out["a_nth"] != out["b_nth"]) | (out["a_line"] != out["b_line"])]
        if probes is not None:
            return out.drop_duplicates()
        out["more"] = out.groupby(A)["more"].transform("any")
        out = out.sort_values([*A, "far", *B], ignore_index=True).drop_duplicates([*A, *B])
        lines = out.groupby(A)["far"]
        out["more"] |= lines.transform("size") > NEAREST
        return out[lines.cumcount() < NEAREST]

    found = groups.groupBy("part", "sub", "one", "two").applyInPandas(compare, PAIR)
    if probes is not None:
        return found.groupBy(*A, *B).agg(F.max("more").alias("more"))
    near = F.array_sort(F.collect_set(F.struct("far", F.struct(*B).alias("b"))))  # at most NEAREST for each word of a line's prefix
    nearest = found.groupBy(*A).agg(near.alias("near"), F.max("more").alias("more")).withColumn("more", F.col("more") | (F.size("near") > NEAREST))
    return nearest.select(*A, F.explode(F.slice("near", 1, NEAREST)).alias("at"), "more").select(*A, *[f"at.b.{c}" for c in B], "more")


def words_of(posted: DataFrame, probes: Table) -> DataFrame:
    """(word): hashes of the words, each with a class of lengths, under which lines are posted whose places may be in a table."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = [np.zeros(0, U8)]
            for part, blob in zip(batch["part"], batch["blob"]):
                x = unpacked([blob], FIELDS, PLACED)
                at = np.flatnonzero(known(probes, place(x)))
                met.extend(of_word(part, x["token"][at], of_length(x["n"][at])))
            yield pd.DataFrame({"word": long(np.unique(np.concatenate(met)))})

    return posted.mapInPandas(each, "word long")


def of_length(n: np.ndarray) -> np.ndarray:
    """A class of lengths, from 1 on: lines of the least similarity or more are of the same class or of neighbouring ones, as 1.26 is a little more than DEN / NUM."""
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(1.26)).astype(U8)


def of_word(part: int, token: np.ndarray, *lengths: np.ndarray) -> Iterator[np.ndarray]:
    """A hash of the words with each of the lengths."""
    word = mixed((token.astype(U8) << U8(31) | U8(part)) + U8(1))
    return (mixed(word + length) for length in lengths)


def meeting(posted: DataFrame, words: Table) -> DataFrame:
    """Only the postings whose word may be in a table with a class of lengths that is near the line's."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, blob in zip(batch["part"], batch["blob"]):
                x = unpacked([blob], FIELDS)
                length = of_length(x["n"])
                keep = np.flatnonzero(np.any([known(words, w) for w in of_word(part, x["token"], length - U8(1), length, length + U8(1))], axis=0))
                if len(keep):
                    out.append((part, len(keep), packed(x, FIELDS, keep)))
            yield pd.DataFrame(out, columns=["part", "n", "blob"])

    return posted.mapInPandas(each, "part int, n long, blob binary")


def line_texts(texts: DataFrame, wanted: Table, docs: Table) -> DataFrame:
    """(doc_id, nth, line, bytes) of the lines whose place may be wanted, A-Z in lower case; texts that may hold none, by their ids, aren't cut into lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(known(docs, hash_of(b.column(0).to_numpy(), b.column(1).to_numpy())))) for b in batches)
        for p in pieces(some):
            some = np.flatnonzero(known(wanted, hash_of(p.doc, p.nth, p.line)))
            own = pa.array([p.low[a:b].tobytes() for a, b in zip(p.begin[some], p.end[some])], pa.binary())
            yield rows(doc_id=p.doc[some], nth=p.nth[some], line=p.line[some].astype(np.int32), bytes=own)

    return texts.mapInArrow(each, "doc_id long, nth long, line int, bytes binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines a of the pairs (a, b) with a Jaccard similarity of at least the threshold, on the words themselves."""
    of = lambda xs: F.xxhash64(*xs[:2], F.col(xs[2]).cast("long"))
    n = pairs.count()
    wanted = bit_table(pairs.select(F.explode(F.array(of(A), of(B))).alias("place")), "place", 2 * n)
    docs = bit_table(pairs.select(F.explode(F.array(F.xxhash64(*A[:2]), F.xxhash64(*B[:2]))).alias("doc")), "doc", 2 * n)
    lines = cut(line_texts(texts, wanted, docs))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: set, q: set) -> bool:
            both = len(p & q)
            return DEN * both >= NUM * (len(p) + len(q) - both)

        return pd.Series([one(set(p.split()), set(q.split())) for p, q in zip(x, y)], dtype=bool)

    name = lambda xs, text: lines.toDF(*xs, text)
    return pairs.join(name(A, "x"), A).join(name(B, "y"), B).where(alike("x", "y")).select(*A).distinct()


def later_matches(texts: DataFrame) -> DataFrame:
    """(doc_id, nth, line): the lines that match a line before them, in an earlier text (smaller doc_id, then nth) or earlier in their own."""
    met = cut(seen(texts))
    places, counts = met.where("sig IS NOT NULL").select("sig", "doc_id", "nth", "line"), met.where("sig IS NULL").select("task", "chunk", "cells", "n")
    firsts = cut(places.groupBy("sig").agg(F.min(F.struct("doc_id", "nth", "line")).alias("at"), F.count("*").alias("n")))
    distinct = firsts.count()
    bits = max(5, (8 * distinct // POSTINGS).bit_length())  # a line has some eight words in its prefix
    posted = cut(postings(texts, rarity(counts), *posted_lines(firsts), min(bits, 31)))
    crowded, most, probes, words, gone, left = crowded_parts(posted), NEAREST, None, None, None, 1
    while left:
        with scratch():  # pairs, and the lines' texts that they are verified on, go with each round
            pairs = cut(candidates(dealt(posted, crowded, words), most, probes))
            with scratch():
                found = cut(verified(pairs, texts), keep=True)
            gone = cut(found if gone is None else gone.union(found).distinct(), keep=True)
            probing = cut(pairs.where("more").select(*A).distinct().join(gone, A, "left_anti"))
            left = probing.count()
            if left:
                most = max(GROWTH * most, PAIRS * distinct // left)
                probes = bit_table(probing.select(F.xxhash64(*A[:2], F.col(A[2]).cast("long")).alias("place")), "place", left, 9)
                shared = cut(words_of(posted, probes).distinct())
                words = bit_table(shared, "word", shared.count())
    copies = firsts.where("n > 1").select("sig", F.col("at.doc_id").alias("doc0"), F.col("at.nth").alias("nth0"), F.col("at.line").alias("line0"))
    again = places.join(copies, "sig").where("doc_id <> doc0 OR nth <> nth0 OR line <> line0").select("doc_id", "nth", "line")
    return again.union(gone).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """docs with its columns, whatever their names, lines that match an earlier one gone from text; every row stays, with what is left of its text
    (perhaps none). n_chars, if there, is the new length.

    Lines end at line feeds. Lines without words never match. Null texts and rows without a doc_id stay as they are. Rows that
    repeat a doc_id and its text are one document: their lines are at the same places, and lose the same ones. Rows that repeat
    a doc_id with other texts are documents of their own. Very long texts and lines are read as any other. An empty table stays empty.
    """
    own = apart(docs)
    with scratch():
        dropped = later_matches(texts_of(own)).groupBy("doc_id", "nth").agg(F.collect_list("line").alias("lines"))  # bounded by the document
        dropped = cut(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("nth").alias("dropped_nth"), "lines"), keep=True)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        def one(text: str, dropped) -> str:
            gone = set(dropped.tolist())
            return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)

        out = pd.Series([None if d is None else one(t, d) for t, d in zip(texts, dropped)], dtype=object)
        trim()
        return out

    changed = F.col("lines").isNotNull()
    # what goes has no bound, so it is never broadcast: one plan at every size
    joined = own.join(dropped.hint("merge"), (F.col("doc_id") == F.col("dropped_id")) & (F.col("nth") == F.col("dropped_nth")), "left")
    return replaced(joined, docs, changed, rest(F.when(changed, F.col("row.text").cast("string")), F.col("lines")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
