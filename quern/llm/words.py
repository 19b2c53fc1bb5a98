"""Lines and words of whole batches of texts at once, on their bytes: A-Z in lower case, words between ASCII white space."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20  # bytes of whole documents whose words are found at once
STEP = 1 << 18  # and whose words are hashed at once

try:
    _trim = ctypes.CDLL(None).malloc_trim  # where the C library has it
except (OSError, AttributeError):
    _trim = None


def trim() -> None:
    """Gives memory that is free back to the system: a worker that waits for its next task holds what its largest one took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


U8 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, U8)  # what a byte counts in a word's hash
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U8), np.ones(1, U8)]


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1 at least, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, U8)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U8(30)) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U8(27)) * U8(0x94D049BB133111EB)
    return x ^ x >> U8(31)


def hash_of(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    p1, p2, p3, p4, p5 = (U8(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = U8(42)
    with np.errstate(over="ignore"):
        for c in columns:
            k = np.asarray(c, np.int64).view(U8) * p2
            h = (h + p5 + U8(8)) ^ (k << U8(31) | k >> U8(33)) * p1
            h = (h << U8(27) | h >> U8(37)) * p1 + p4
            h = (h ^ h >> U8(33)) * p2
            h = (h ^ h >> U8(29)) * p3
            h = h ^ h >> U8(32)
    return h


class Piece:
    """Some whole documents: their bytes, A-Z in lower case, and the lines in these: begin, end, doc_id, nth, and line in the document."""

    def __init__(self, low: np.ndarray, off: np.ndarray, doc: np.ndarray, nth: np.ndarray):
        self.low, self.off = low, off
        nl = np.flatnonzero(low == 10)
        count = 1 + np.bincount(np.searchsorted(off, nl, "right") - 1, minlength=len(doc))
        self.begin, self.end = np.sort(np.concatenate([off[:-1], nl + 1])), np.sort(np.concatenate([nl, off[1:]]))
        self.doc, self.nth = np.repeat(doc, count), np.repeat(nth, count)
        self.line = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)

    def sigs(self) -> np.ndarray:
        """A hash of each line; 0 for lines without words."""
        data, digest = self.low.tobytes(), xxhash.xxh64_intdigest
        lines = [data[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist())]
        return np.array([digest(x) or 1 if x and not x.isspace() else 0 for x in lines], U8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.low, self.off)


def words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of each word of texts that begin and end at off."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U8)
    space = (low == 32) | (low - np.uint8(9) < 5)
    after, before = np.empty(len(low), bool), np.empty(len(low), bool)
    after[1:], before[:-1] = space[:-1], space[1:]
    after[off[:-1][off[:-1] < len(low)]] = True
    before[off[1:][off[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(~space & after), np.flatnonzero(~space & before) + 1
    out, k = [np.zeros(0, U8)], 0
    while k < len(begin):  # a very long text takes no tables of its length
        to = max(k + 1, int(np.searchsorted(end, begin[k] + STEP, "right")))
        a, b = begin[k:to] - begin[k], end[k:to] - begin[k]
        power, inverse = powers(int(b[-1]) + 1)
        sums = np.zeros(int(b[-1]) + 1, U8)
        np.cumsum(BYTE[low[begin[k] : end[to - 1]]] * power[: len(sums) - 1], out=sums[1:])
        out.append(mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U8)))
        k = to
    return begin, end, np.concatenate(out)


def cut_up(text: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of texts by about PIECE bytes, A-Z in lower case if wanted."""
    if len(text):
        wide = pa.types.is_large_string(text.type)
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        low = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        low = low + ((low - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else low
        off = off - off[0]
        cuts = np.flatnonzero(np.diff(off[:-1] // PIECE, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            if b > a:
                yield a, b, low[off[a] : off[b]], off[a : b + 1] - off[a]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """The texts of batches (doc_id, nth, text) as pieces."""
    for batch in batches:
        doc, nth = (batch.column(k).to_numpy() for k in (0, 1))
        for a, b, low, off in cut_up(batch.column(2)):
            yield Piece(low, off, doc[a:b], nth[a:b])
    trim()


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones, and so on, which compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def whole(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(x: dict[str, np.ndarray], fields: dict[str, str], keep) -> bytes:
    """Some rows of columns as one blob; fields: the columns' types. Before the planes come the number of rows, and for each column that of its planes:
    those above the highest byte that isn't 0 in all rows are left out."""
    columns = [x[f][keep].astype(kind) for f, kind in fields.items()]
    used = [(int(np.bitwise_or.reduce(c)) & (1 << 8 * c.itemsize) - 1).bit_length() + 7 >> 3 for c in columns]
    low = [c.view(np.uint8).reshape(-1, c.itemsize)[:, :k].T.tobytes() for c, k in zip(columns, used)]
    return b"".join([len(columns[0]).to_bytes(4, "little"), bytes(used), *low])


def rows_in(blob: bytes) -> int:
    return int.from_bytes(blob[:4], "little")


def unpacked(blobs: list[bytes], fields: dict[str, str], only=()) -> dict[str, np.ndarray]:
    """The rows of several blobs, all columns or only some."""
    rows = [rows_in(blob) for blob in blobs]
    found = {f: np.zeros((sum(rows), np.dtype(kind).itemsize), np.uint8) for f, kind in fields.items() if not only or f in only}
    to = 0
    for blob, n in zip(blobs, rows):
        at = 4 + len(fields)
        for f, k in zip(fields, blob[4:at]):
            if k and f in found:
                found[f][to : to + n, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
            at += n * k
        to += n
    return {f: x.view(fields[f]).ravel() for f, x in found.items()}


def by_place(doc: np.ndarray, nth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of places: by doc_id, nth and what is counted in a text."""
    at = at.astype(np.int64)
    if len(doc) and not nth.any():
        bits, low = int(at.max()).bit_length(), int(doc.min())
        if (int(doc.max()) - low).bit_length() + bits < 64:
            return np.argsort((doc - low).view(U8) << U8(bits) | at.view(U8))
    return np.lexsort((at, nth, doc))


def blobs_by_part(x: dict[str, np.ndarray], fields: dict[str, str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(part, rows, blob) of rows in an order that begins with their part."""
    x = {f: y[order] for f, y in x.items()}
    heads = np.flatnonzero(np.diff(x["part"], prepend=-1))
    bounds = np.append(heads, len(order))
    return x["part"][heads].astype(np.int32), np.diff(bounds), [packed(x, fields, slice(a, b)) for a, b in zip(bounds, bounds[1:])]
