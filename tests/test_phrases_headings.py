"""The automaton against phrases removed one after another, the heading scan against the patterns, and characters that NFKC leaves alone."""

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import headings, phrases
from quern.functions import text as T


def one_after_another(text, own):
    for p in sorted(set(own), key=lambda p: (-len(p), p)):
        if pattern := r"\s*".join(map(re.escape, unicodedata.normalize("NFKC", p).split())):
            text = re.sub(pattern, " ", text, flags=re.I)
    return text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text("ab B", min_size=1, max_size=5), max_size=7), st.text("aAbB \n", max_size=60))
def test_automaton_is_the_sequential_rule(own, text):
    assert phrases.Phrases(own).remove(text) == one_after_another(text, own)


def korean(r, n):
    own = sorted({p for s in T.SECTION_PHRASES.values() for level in s.values() for p in level})
    parts = [w for p in own for w in p.split()] + own + [p.replace(" ", "") for p in own] + [" ", "\n", "  ", "가", "나다", "text"]
    return "".join(r.choice(parts) + r.choice(["", "", " ", "\u3000"]) for _ in range(n))


def test_phrases_of_the_modes(spark):
    r = random.Random(1)
    texts = [korean(r, r.randrange(60)) for _ in range(300)] + ["", "plain", None]
    lists = {f"{s}/{m}": T.phrases_of(s, m) for s in T.SECTION_PHRASES for m in T.MODES[1:]}
    remove = phrases.remover(lists)
    df = spark.createDataFrame([(t, k) for t in texts for k in lists], "t string, k string")
    for row in df.select("t", "k", F.coalesce(remove(F.col("t"), F.col("k")), F.col("t")).alias("out")).collect():
        assert row["out"] == (None if row["t"] is None else one_after_another(row["t"], lists[row["k"]])), row


def plain_sections(text):
    t = re.sub(r"-\s*\d+\s*-", "", text or "")

    def take(pattern, group, flags=re.S):
        m = re.search(pattern, t, flags)
        return m[group].strip() if m else ""

    return (
        take(r"발명의?\s*명칭\s*(.+?)(?:\n{2,}|\(57\)|요\s*약|【요약】)", 1), take(r"(요\s*약|【요약】)\s*(.+?)(?=청구범위|청구항|명\s*세\s*서|발명의?\s*설명)", 2),
        take(r"(청구범위|청구항\s*1)[\s\S]+?(?=발명의?\s*설명|기\s*술\s*분\s*야|배\s*경\s*기\s*술)", 0), take(r"(기\s*술\s*분\s*야|배\s*경\s*기\s*술|발명의?\s*내용)[\s\S]+", 0),
        take(r"[A-H][0-9]{2}[A-Z]\s*\d+/\d+", 0),
    )


def test_heading_scan_is_the_patterns(spark):
    r = random.Random(2)
    heads = ["발명의 명칭", "발명 명칭", "(57)", "요 약", "요약", "【요약】", "【", "】", "청구범위", "청구항 1", "청구항 2", "청구항", "청구항1", "명 세 서", "발명의 설명", "발명설명", "기술분야", "배경기술", "배경기술분야", "발명의 내용", "\n\n", "\n", " ", "가", "본문 나", "G06F 17/30", "- 3 -", "기\n\n술분야"]
    texts = ["".join(r.choice(heads) + r.choice(["", " ", "\n", "x"]) for _ in range(r.randrange(14))) for _ in range(4000)] + ["", None, "발명의 명칭 가\n\n(57) 【요약】 나 청구범위 청구항 1 다 발명의 설명 기술분야 라"]
    rows = headings.with_sections(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)).select("i", "title", "abstract", "claims", "description", "ipc").collect()
    names = ["title", "abstract", "claims", "description", "ipc"]
    bad = [(texts[x["i"]], tuple(x)[1:], plain_sections(texts[x["i"]])) for x in rows if tuple(x)[1:] != plain_sections(texts[x["i"]])]
    assert not bad, (len(bad), [(t, n, a, b) for t, x, y in bad[:6] for n, a, b in zip(names, x, y) if a != b])


def test_fallback_claims_is_the_patterns(spark):
    starts = [r"\b청\s*구\s*항\b", r"\b청구항\b", r"\bclaims\b", r"\bwhat\s+is\s+claimed\s+is\b"]
    ends = [r"\b발명의\s+상세한\s+설명\b", r"\b발명의\s+설명\b", r"\bdetailed\s+description\b", r"\bdescription\s+of\s+embodiments\b"]
    r = random.Random(4)
    parts = ["청 구 항", "청구항", "CLAIMS", "What is claimed is", "발명의 상세한 설명", "발명의 설명", "Detailed description", "description of embodiments", "가", "x", "\n"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(8))) for _ in range(600)]

    def plain(t):
        own = next((t[m.start() :] for p in starts if (m := re.search(p, t, re.I))), "")
        return next((own[: m.start() + 1] for p in ends if (m := re.search(p, own[1:], re.I))), own).strip()

    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fallback_claims("t").alias("out")).collect():
        assert row["out"] == plain(row["t"]), row


def test_stable_characters():
    stable = re.compile(f"[{T.STABLE}]")
    own = [c for c in map(chr, range(0x10000)) if stable.match(c)]
    assert all(unicodedata.is_normalized("NFKC", c) for c in own) and len(own) > 30000
    r = random.Random(3)
    assert all(unicodedata.is_normalized("NFKC", "".join(r.choice(own) for _ in range(50))) for _ in range(2000))
    later = {unicodedata.normalize("NFKC", c + d) == c + d for c in own[:400] for d in own[:400]}
    assert later == {True}
