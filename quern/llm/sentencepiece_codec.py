"""SentencePiece encoding and decoding with a public vocabulary.

Texts are cut into marked words (blanks written as marks, with what follows). The distinct words of a batch are sorted, so
that walking them in order is a depth-first traversal of their trie: the forward states of a word's characters are those of
the common prefix with the word before, and only the rest is computed.

The forward state of a prefix is how it is best segmented. In a unigram vocabulary that is Viterbi's: the best sum of
scores and the last piece. In a BPE vocabulary the sum of scores doesn't give the library's ids, but the same pass does with
another step: the merges leave a prefix's last piece p right before piece t exactly if merging p + t alone leaves them
apart, so of the pieces that end at a character one alone fits the states before it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Words whose ids a worker keeps; beyond it starts anew.
KEPT_WORDS = 900_000
KEPT_PAIRS = 1_000_000
TAIL = 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes as the library does with the same model (identity normalisation, a mark put in front, bytes for unknown characters)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        #: The length of the longest piece with these last TAIL characters; without any, no piece is as long as they are.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) >= TAIL:
                self.reach[p[-TAIL:]] = max(len(p), self.reach.get(p[-TAIL:], 0))
        #: The scores of a BPE vocabulary are its merges' ranks, negated; those of a unigram vocabulary are logarithms.
        self.merges = all(float(s).is_integer() for s in self.scores.values())
        #: Marks that aren't in front of a piece would join words; then a text is one word.
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = (lambda text: [text] if text else []) if inside else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.least = min(self.scores.values()) - 10
        self.words: dict[str, bytes] = {}
        #: Numbers of the pieces, 0 for none; and which pairs of them the merges leave apart.
        self.numbers: dict[str, int] = {"": 0, **{p: k for k, p in enumerate(self.ids, 1)}}
        self.apart: dict[int, bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges themselves, on a short list: the best-scored neighbours that are a piece together, the leftmost first."""
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether the merges leave the two apart, and each whole."""
        return self.merged(list(before + piece)) == [p for p in (before, piece) if p]

    def number(self, character: str) -> int:
        """A number for a character that is no piece, behind those of the pieces."""
        return self.numbers.setdefault(character, len(self.numbers))

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each word of a sorted list. last[i] is the last piece of the first i characters, which[i] its number, best[i] their score."""
        last, which, best, before = [""], [0], [0.0], ""
        pieces, numbers, reach, apart = self.scores, self.numbers, self.reach, self.apart
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], which[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                begin = max(0, end - reach.get(word[max(0, end - TAIL) : end], TAIL - 1))
                if self.merges:
                    while True:  # the last one, a character alone, fits if no longer one does
                        found = word[begin:end]
                        n = numbers.get(found)
                        if n is None and begin == end - 1:
                            n = self.number(found)
                        if n is not None:
                            pair = which[begin] << 32 | n
                            known = apart.get(pair)
                            if known is None:
                                if len(apart) >= KEPT_PAIRS:
                                    apart.clear()
                                known = apart[pair] = self.fits(last[begin], found)
                            if known or begin == end - 1:
                                break
                        begin += 1
                    which.append(n)
                else:
                    found, score = word[end - 1], None
                    for begin in range(begin, end):
                        piece = word[begin:end]
                        s = pieces.get(piece, self.least if begin == end - 1 else None)  # an unknown character stands alone
                        if s is not None and (score is None or best[begin] + s > score):
                            found, score = piece, best[begin] + s
                    best.append(score)
                last.append(found)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield word, out[::-1]
            before = word

    def learn(self, words: set[str]) -> None:
        new = words - self.words.keys()
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = words
        for word, pieces in self.encode_words(sorted(new)):
            ids = []
            for p in pieces:
                i = self.ids.get(p)
                if i is None:
                    ids += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                else:
                    ids.append(i)
            self.words[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut((MARK + t if t else "").replace(" ", MARK)) for t in texts]
        self.learn({w for words in cut for w in words})
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4") for words in cut]

    def decode(self, ids) -> str:
        """The text of ids: runs of bytes as UTF-8, marks as blanks, and without the mark that was put in front."""
        out, raw = [], bytearray()
        values = {i: b for b, i in self.bytes.items()}
        for i in ids:
            if (b := values.get(int(i))) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[int(i)])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    @property
    def table(self) -> list[bytes]:
        """The bytes of each id, for decoding by one join."""
        if not hasattr(self, "_table"):
            values = {i: b for b, i in self.bytes.items()}
            self._table = [bytes([values[i]]) if i in values else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        return self._table

    def decode_all(self, ids: np.ndarray) -> str:
        """As decode, where the bytes of unknown characters are whole: ids that came from encode."""
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs (doc_id, text) as (doc_id, ids array<int>): the library's ids. Null and empty texts have none; repeated rows are
    encoded each; very long texts as any other; other columns don't matter."""
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([i.astype("i4") for i in codec(path).encode(texts.fillna("").tolist())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), each(F.col("text").cast("string")).alias("ids"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) as (doc_id, text); null ids give an empty text."""
    path = model or default_model()

    @F.pandas_udf("string")
    def each(ids: pd.Series) -> pd.Series:
        return pd.Series(["" if i is None else codec(path).decode(i) for i in ids], dtype=object)

    return encoded.select("doc_id", each("ids").alias("text"))


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The state of a prefix is the last piece that the merges leave at each character; with a unigram vocabulary it is Viterbi's best score and last piece.

    One row for each row of docs: doc_id, n_pieces, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), decoded_crc32 (of the decoded
    text's UTF-8) and round_trip, whether the decoded text is the text (null: empty). Both ways in one pass, so that the ids needn't travel. Empty texts have no
    pieces; repeated rows have a row each; very long texts are encoded whole; other columns don't matter; an empty table gives an empty result."""
    path = model or default_model()

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    def each(column: pd.Series) -> pd.DataFrame:
        own, out, texts = codec(path), [], column.fillna("").tolist()
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            for text, ids in zip(part, own.encode(part)):
                back = own.decode_all(ids)
                out.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text))
        return pd.DataFrame(out, columns=["n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), each(F.col("text").cast("string")).alias("r")).select("doc_id", "r.*")


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
