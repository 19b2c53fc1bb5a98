"""Chat formatting: conversations as one text each, with a mask of what a model learns from.

A turn is `<s>role[INST] text [/INST]</s>` and a line feed. Control strings inside a role or a text get a
backslash behind their first character (one more where some stand there already), so none of them
stands in a formatted text but where the template put it, and taking one backslash away gives back what was there.

Bytes are assembled by column: the lengths of all segments of a batch, their running sums as places,
and scatter indices copy headers and contents into one buffer that becomes an Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

OPEN, MID, CLOSE, END = "<s>", "[INST] ", " [/INST]", "</s>\n"
#: What is escaped: the template's own strings and those of other common templates. None holds an opening mark but at its start.
CONTROL = r"/?s>|/?INST\]|/?SYS>|\|[a-z_]+\|>"
LEARNED = "assistant"
#: Bytes of a conversation in one row; a longer one fills several rows, cut between turns.
PIECE = 1 << 25
#: Bytes that are assembled at once, and turns.
STEP, TURNS = 1 << 22, 20_000
FORMATTED = "conv_id long, part int, piece int, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"
_escaped = re.compile(rf"([<\[]\\*)\\(?={CONTROL})")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, rf"([<\[])(\\*)({CONTROL})", r"\1\2\\\3")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def assembled(columns: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bytes of all rows, each the columns' values (or a constant) in turn, and where each column's segments begin."""
    sizes = np.empty((rows, len(columns)), np.int64)
    for k, c in enumerate(columns):
        sizes[:, k] = len(c) if isinstance(c, bytes) else pc.binary_length(c).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.ravel())
    starts = (ends - sizes.ravel()).reshape(rows, -1)
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for k, c in enumerate(columns):
        at = starts[:, k]
        if isinstance(c, bytes):
            out[(at[:, None] + np.arange(len(c))).ravel()] = np.tile(np.frombuffer(c, np.uint8), rows)
            continue
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + rows + 1]
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        out[np.repeat(at - (offsets[:-1] - offsets[0]), sizes[:, k]) + np.arange(len(data))] = data
    return out, [starts[:, k] for k in range(len(columns))]


class _Writer:
    """Rows of FORMATTED from turns in order, whatever batches they come in."""

    def __init__(self, part: int, piece: int):
        self.part, self.limit, self.conv, self.nth = part, piece, None, 0
        self.held: list[tuple[bytes, np.ndarray, int, int, int]] = []  # bytes, spans, characters before them, turns, characters
        self.size = 0
        self.out: list[tuple] = []

    def flush(self) -> None:
        if self.held:
            text = b"".join(h[0] for h in self.held).decode()
            spans, before = [], 0
            for _, own, turns, chars in self.held:
                spans += [{"start": int(a) + before, "end": int(b) + before} for a, b in own]
                before += chars
            self.out.append((self.conv, self.part, self.nth, sum(h[2] for h in self.held), text, spans))
            self.held, self.size, self.nth = [], 0, self.nth + 1

    def add(self, conv, data: bytes, spans: np.ndarray, turns: int, chars: int, first: bool) -> None:
        if first:
            self.flush()
            self.conv, self.nth = conv, 0
        elif self.size + len(data) > self.limit:
            self.flush()
        self.held.append((data, spans, turns, chars))
        self.size += len(data)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in self.out], schema=_SCHEMA)
            self.out = []


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", _SPANS)])


def _steps(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.add(pc.binary_length(batch.column(1)), pc.binary_length(batch.column(2))).to_numpy(zero_copy_only=False)
    turn = np.maximum(np.cumsum(sizes, dtype=np.int64) // most, np.arange(len(sizes)) // TURNS)
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def format_conversations(conversations: DataFrame, learned: str = LEARNED, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, piece, n_turns, formatted, loss_spans) of conversations (conv_id, turn, role, text).

    Turns stand in order of turn (null first), role and text; repeated rows are turns each; a null role or text is empty; a null conv_id is a
    conversation of its own; other columns don't matter; an empty table gives an empty result. loss_spans are the characters [start, end) of the
    formatted text that a role `learned` wrote, in order, empty ones too. Rows are dealt by ranges of all these columns, so a conversation of any length is formatted by as many
    tasks as its rows fill: (part, piece) orders its rows, of about `piece` bytes at most (a longer turn stands alone). No task holds more.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = own.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, begun = _Writer(pyspark.TaskContext.get().partitionId(), piece), False
        for whole in batches:
            for b in _steps(whole, min(STEP, piece)):
                n, conv = b.num_rows, b.column(0)
                role, text = (escape(pc.cast(b.column(k), pa.large_string())) for k in (1, 2))
                data, (start, _, _, at, close, _) = assembled([OPEN.encode(), role, MID.encode(), text, CLOSE.encode(), END.encode()], n)
                ends = np.append(start[1:], len(data))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                mine = pc.equal(b.column(1), learned).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
                null = pc.is_null(conv).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
                for x, y in zip(new, np.append(new[1:], n)):
                    key = None if null[x] else int(ids[x])
                    hit = np.flatnonzero(mine[x:y]) + x
                    spans = np.stack([chars[at[hit]], chars[close[hit]]], 1) - chars[start[x]]
                    w.add(key, data[start[x] : ends[y - 1]].tobytes(), spans, int(y - x), int(chars[ends[y - 1]] - chars[start[x]]), not begun or key != w.conv)
                    begun = True
                yield from w.take()
        w.flush()
        yield from w.take()

    return dealt.select("conv_id", "role", "text").mapInArrow(rows, FORMATTED)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    for turn in formatted.split(CLOSE + END)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(MID)
        yield unescape(role), unescape(text)


class _Digest:
    """What a conversation's formatted rows say, in order."""

    def __init__(self):
        self.n, self.loss_chars, self.chars, self.turns, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        for role, text in turns_of(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in spans:
            text = unescape(formatted[s["start"] : s["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self, conv) -> dict:
        return {"conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_OPEN = pa.schema([*_DIGEST, *[_SCHEMA.field(c) for c in ("part", "piece", "formatted", "loss_spans")]])


def digests(formatted: DataFrame) -> DataFrame:
    """DIGEST of each conversation, read back from its formatted rows as format_conversations returns them (not dealt anew): a conversation that begins and
    ends inside a task's rows is digested there. Others travel as they are and pass one task each as a stream, as their digests are one sequence of bytes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, first, held, size = None, None, True, [], 0

        def apart() -> list[dict]:
            return [{"conv_id": conv, **{c: r[c] for c in ("part", "piece", "formatted", "loss_spans")}} for r in held]

        for b in batches:
            out = []
            for r in b.to_pylist():
                if digest is None or r["piece"] == 0:
                    if digest is not None:
                        out += apart() if first else [digest.row(conv)]
                        first = False
                    conv, digest, held, size = r["conv_id"], _Digest(), [], 0
                held.append(r)
                size += len(r["formatted"])
                if first or size > PIECE:  # it may have begun elsewhere, or is too long to keep until its end is seen
                    out += apart()
                    held, first = [], True
                else:
                    digest.add(r["formatted"], r["loss_spans"])
            yield pa.RecordBatch.from_pylist(out, schema=_OPEN)
        if digest is not None:
            yield pa.RecordBatch.from_pylist(apart(), schema=_OPEN)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if digest is None or r["conv_id"] != conv:
                    out += [digest.row(conv)] if digest else []
                    conv, digest = r["conv_id"], _Digest()
                digest.add(r["formatted"], r["loss_spans"])
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
        if digest:
            yield pa.RecordBatch.from_pylist([digest.row(conv)], schema=_DIGEST)

    more = ", part int, piece int, formatted string, loss_spans array<struct<start: long, end: long>>"
    read = cut(formatted.mapInArrow(whole, DIGEST + more))
    names = [f.name for f in _DIGEST]
    parts = read.where("formatted IS NOT NULL").select("conv_id", "part", "piece", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return read.where("formatted IS NULL").select(*names).unionByName(parts.mapInArrow(streamed, DIGEST))


#: A conversation of control strings, which the query formats with the table's.
ODD_ID, ODD_TEXT = -7, "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(own.unionByName(odd)))


_escape = lambda c: f"regexp_replace({c}, '([<\\[])(\\\\*)({CONTROL})', '\\1\\2\\\\\\3', 'g')"
ORACLE_SQL = {
    "op12_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {ODD_ID}, i, r, '{ODD_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
        sum({len(OPEN + MID + CLOSE + END)} + length({_escape("role")}) + length({_escape("text")}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""
}
