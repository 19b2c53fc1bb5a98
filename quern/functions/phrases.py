"""Removal of many phrases by one automaton.

The rule: phrases go one after another, the longest first, of equal ones by text; a phrase is its words with any white space or
none between them, letters' case aside; what goes leaves a blank. A phrase's turn so comes behind longer ones, and what
they leave may bring the parts of a shorter one together.

The automaton finds all phrases that a text without its white space holds, in one scan. Only those have a turn, and
those that a removal may have made: they stand across it, so a few characters on both sides are scanned again.
Plain texts don't come here: a pattern by first characters lets the others pass in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, which is what (?U)\s is in the JVM.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_blanks = re.compile(f"{BLANK}+")


def ordered(phrases) -> list[tuple[str, ...]]:
    """The phrases as words, in the order of their turns."""
    split = (tuple(_blanks.sub(" ", unicodedata.normalize("NFKC", p)).split(" ")) for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    kept = (tuple(w for w in words if w) for words in split)
    return [w for w in kept if w]


class Phrases:
    def __init__(self, phrases):
        import ahocorasick

        words = ordered(phrases)
        plain = {c for w in words for x in w for c in x}
        cased = any(not c == c.upper() == c.lower() == c.casefold() for c in plain)
        self.patterns = [re.compile(f"{BLANK}*".join(map(re.escape, w)), re.I) for w in words]
        # Only runs of the phrases' characters can hold one; of a text in another script that is little.
        self.runs = None if cased or not plain else re.compile(f"[{''.join(map(re.escape, sorted(plain)))}][{''.join(map(re.escape, sorted(plain)))}{BLANK[1:-1]}]*")
        self.width = max((sum(map(len, w)) for w in words), default=0)
        self.machine, ranks = ahocorasick.Automaton(), {}
        for r, w in enumerate(words):
            ranks.setdefault("".join(w).casefold(), []).append(r)
        for key, own in ranks.items():
            self.machine.add_word(key, own)
        if ranks:
            self.machine.make_automaton()

    def held(self, text: str) -> set[int]:
        """The turns of the phrases that a text may hold."""
        if not self.patterns:
            return set()
        if self.runs:
            text = "\0".join(self.runs.findall(text))
        return {r for _, own in self.machine.iter(_blanks.sub("", text).casefold()) for r in own}

    def _side(self, text: str, at: int, step: int) -> str:
        """The characters next to a place, as many as the longest phrase has besides blanks, or all."""
        size = 2 * self.width
        while True:
            own = text[max(0, at - size) : at] if step < 0 else text[at : at + size]
            if len(own) < size or len(_blanks.sub("", own)) >= self.width:
                return own
            size *= 2

    def remove(self, text: str) -> str:
        due = self.held(text)
        while due:
            turn = min(due)
            due.discard(turn)
            pieces = self.patterns[turn].split(text)
            if len(pieces) > 1:
                text, at, sides = " ".join(pieces), 0, []
                for p in pieces[:-1]:
                    at += len(p) + 1
                    sides.append(self._side(text, at, -1) + self._side(text, at, 1))
                due |= {r for r in self.held("\0".join(sides)) if r > turn}
        return text


@lru_cache(64)
def _phrases(own: tuple[str, ...]) -> Phrases:
    return Phrases(own)


def holds(text: Column, phrases) -> Column:
    """Whether a text has any of the phrases, in the JVM: a look for the range of their first characters, which most texts lack, then one pattern."""
    by: dict[str, list[str]] = {}
    for words in ordered(phrases):
        by.setdefault(words[0][0], []).append("(?U:\\s*)".join(re.escape(w) for w in words)[len(re.escape(words[0][0])) :])
    if not by:
        return F.lit(False)
    first = f"[{re.escape(min(by))}-{re.escape(max(by))}]"  # a range is one comparison, a list one for each
    whole = f"(?iu)(?={first})(?:" + "|".join(f"{re.escape(h)}(?:{'|'.join(rest)})" for h, rest in by.items()) + ")"
    return text.rlike(("" if all(h.upper() == h.lower() for h in by) else "(?iu)") + first) & text.rlike(whole)


def remover(lists: dict[str, list[str]]):
    """A Column function of a text and a key: the text without the phrases of lists[key], null where it holds none."""
    own = {k: tuple(sorted(set(v))) for k, v in lists.items()}

    @F.pandas_udf("string")
    def removed(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or k not in own else _phrases(own[k]).remove(t) for t, k in zip(texts, keys)], dtype=object)

    def column(text: Column, key: Column) -> Column:
        found = F.lit(False)
        for k, phrases in own.items():
            found = F.when(key == k, holds(text, phrases)).otherwise(found)
        return removed(F.when(found, text), key)

    return column
