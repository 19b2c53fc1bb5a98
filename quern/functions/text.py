"""Text rules as Column expressions.

Patterns are written for Java's engine with (?U) where classes must be Unicode's and (?d) where only a line feed ends a line. NFKC
has no built-in: one Arrow function does it, handed only texts that hold a character which it may change.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.phrases import remover


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


#: Characters that NFKC leaves alone, next to each other too: ASCII, letters of Latin alphabets, CJK ideographs, Hangul syllables, some marks.
STABLE = "\\x00-\\x7F\u00c0-\u0131\u2013\u2014\u2018\u2019\u201c\u201d\u3010\u3011\u4e00-\u9fff\uac00-\ud7a3"
#: One that isn't. Java tries a class's ranges one by one through nested calls, so ASCII and Hangul are put aside by one comparison each.
UNSTABLE = f"[^\\x00-\\x7F](?<![\uac00-\ud7a3])(?<![{STABLE}])"


def nfkc(text: Column | str) -> Column:
    t = _c(text)
    return F.coalesce(_nfkc(F.when(t.rlike(UNSTABLE), t)), t)


def sub(text: Column | str, pattern: str, to: str = " ") -> Column:
    return F.regexp_replace(_c(text), F.lit(pattern), F.lit(to))


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: sub(t, *s), steps, text)


#: White space as Unicode has it: what (?U)\s is.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    return F.btrim(_c(text), F.lit(WHITE))


def squeeze(text: Column | str) -> Column:
    return strip(sub(text, r"(?U)\s+", " "))


def let(value: Column, then) -> Column:
    """then of a value that is worked out once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chain_held(text: Column, *steps: tuple) -> Column:
    """chain of (pattern, to, words): a step passes over texts that hold none of its words, without one of which nothing that it changes is there."""

    def step(t: Column, pattern: str, to: str, *words: str) -> Column:
        return let(t, lambda v: F.when(reduce(lambda a, b: a | b, [F.contains(v, F.lit(w)) for w in words]), sub(v, pattern, to)).otherwise(v))

    return reduce(lambda t, s: step(t, *s), steps, text)


#: What a text holds in which a run of the blanks of ASCII isn't one blank.
RUNS = ("  ", "\t", "\r", "\f", "\x0b")


def squeeze_line(text: Column) -> Column:
    """squeeze of texts that mostly have single blanks already."""
    return let(text, lambda t: F.when(t.rlike(r"(?U)\s(?<=\s\s|[^ ])"), squeeze(t)).otherwise(strip(t)))


def filled(text: Column | str) -> Column:
    return F.coalesce(_c(text), F.lit(""))


def or_else(text: Column, other: Column) -> Column:
    """text, or other where it is empty."""
    return F.when(text != "", text).otherwise(other)


# ---- preprocessing of sections -------------------------------------------------------------------------------------


def normalize_basic(text: Column | str) -> Column:
    """NFKC; NBSP and NUL to blanks; CR to LF; runs of blanks to one, of three or more LF to two; stripped. Null gives ""."""
    return _basic(nfkc(filled(text)))


def _basic(t: Column) -> Column:
    return strip(chain(F.translate(t, "\u00a0\x00\r", "  \n"), ("\t[ \t]*| [ \t]+", " "), ("\n{3,}", "\n\n")))


def remove_phrases(text: Column | str, phrases: list[str]) -> Column:
    """Phrases to blanks one after another, the longest first, of equal ones by text (see quern.functions.phrases)."""
    return F.coalesce(remover({"": phrases})(_c(text), F.lit("")), _c(text))


def _lines(t: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(F.translate(t, "\u00a0\x00\r", "  \n"), "\n"), strip), lambda x: x != ""), "\n")


def normalize_lines(text: Column | str) -> Column:
    """NFKC; NBSP and NUL to blanks; CR to LF; lines stripped, empty ones gone."""
    return _lines(nfkc(filled(text)))


def first_at(text: Column, patterns: list[str], flags: str) -> Column:
    """Where the first pattern in list order that is anywhere begins, from 1, or null. Texts with none are seen by one pattern alone."""
    found = reduce(lambda rest, p: F.coalesce(F.nullif(F.regexp_instr(text, F.lit(flags + p)), F.lit(0)), rest), reversed(patterns), F.lit(None).cast("int"))
    return F.when(text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), found)


def _span(text: Column, starts: list[str], ends: list[str], flags: str) -> Column:
    """From the first start pattern in list order that is anywhere, up to the first end pattern in list order that is anywhere behind
    its first character; null without a start."""
    own = F.substring(text, first_at(text, starts, flags), F.lit(1 << 30))
    if not ends:
        return own
    return let(own, lambda t: F.coalesce(F.substring(t, F.lit(1), first_at(F.substring(t, 2, 1 << 30), ends, flags)), t))


def block_from(lines: Column, starts: list[str], ends: list[str] = (), least: int = 30) -> Column:
    """Of lines as normalize_lines gives them the part from the first pattern in list order that is anywhere, up to the first end pattern
    in list order that follows; "" if shorter than least."""
    own = strip(F.coalesce(_span(lines, starts, list(ends), "(?iuU)"), F.lit("")))
    return let(own, lambda t: F.when(F.length(t) >= least, t).otherwise(""))


# Headings at which a description without its background may begin.
DESCRIPTION_STARTS = [
    r"발명의\s*내용",
    r"해결하려는\s*과제",
    r"과제의\s*해결\s*수단",
    r"도면의\s*간단한\s*설명",
    r"도면에\s*대한\s*간단한\s*설명",
    r"발명을\s*실시하기\s*위한\s*구체적인\s*내용",
    r"발명의\s*실시를\s*위한\s*구체적인\s*내용",
    r"구체적인\s*실시예",
    r"실시예",
]


def _without_background(lines: Column) -> Column:
    begins = f"[{min(p[0] for p in DESCRIPTION_STARTS)}-{max(p[0] for p in DESCRIPTION_STARTS)}]"  # one range of first characters spares most texts the rest
    whole = "(?iuU)" + "|".join(DESCRIPTION_STARTS)
    return let(lines, lambda t: F.when(t.rlike(begins) & t.rlike(whole), let(block_from(t, DESCRIPTION_STARTS), lambda b: or_else(b, t))).otherwise(t))


def without_background(text: Column | str) -> Column:
    return _without_background(normalize_lines(text))


# The patterns.
ARTIFACTS = [(r"(?U)\[\d{4}\]", " "), (r"(?U)등록특허\s*10-\d+", " "), (r"(?U)-\s*\d+\s*-", " ")]
CLAIM_ARTIFACTS = [(r"(?U)청구항\s*\d+", " "), (r"(?U)제\s*\d+\s*항에\s*있어서", " ")]


def _cleaned(t: Column, section: str) -> Column:
    return squeeze(chain(t, *ARTIFACTS, *(CLAIM_ARTIFACTS if section == "claims" else [])))


def cleanup_artifacts(text: Column | str, section: str) -> Column:
    """Paragraph numbers, registration numbers and page marks go; in claims their headers and references too."""
    return _cleaned(normalize_basic(text), section)


def normal_form(section: str, text: Column) -> Column:
    """The x mode of a section's text that is in NFKC already, behind which the other modes only remove phrases."""
    return _cleaned(_basic(_without_background(_lines(text)) if section == "description" else text), section)


# Phrases that the modes remove from each section.
SECTION_PHRASES = {
    "abstract": {
        "conservative": [
            "본 발명은", "본 발명의 실시예에 따르면", "본 발명의 일 실시예에 따르면", "일 실시예에 따르면", "일 실시예에서", "본 실시예에 따르면",
            "에 관한 것이다", "를 제공한다", "를 포함한다", "를 포함하는", "의 효과가 있다", "할 수 있는 효과가 있다",
        ],
        "strong": ["적어도 하나 이상의", "하나 이상의", "기 설정된", "미리 설정된", "사용자 단말", "복수의", "상기", "및"],
    },
    "claims": {
        "conservative": [
            "상기", "포함하는", "포함하고", "구비하는", "구비하고", "방법으로서", "장치에 있어서", "컴퓨팅 장치에서 수행되는 방법으로서",
            "하나 이상의 프로세서들", "하나 이상의 프로그램들", "메모리를 구비하고",
        ],
        "strong": [
            "제 1 항에 있어서", "제1항에 있어서", "제 2 항에 있어서", "제2항에 있어서", "제 3 항에 있어서", "제3항에 있어서",
            "삭제", "단계", "수단", "모듈", "복수의",
        ],
    },
    "description": {
        "conservative": [
            "본 발명은", "본 발명의 실시예에 따르면", "본 발명의 일 실시예에 따르면", "일 실시예에 따르면", "일 실시예에서", "본 실시예에 따르면",
            "예를 들어", "예컨대", "이하", "상기", "에 관한 것이다",
        ],
        "strong": [
            "도 1은", "도 2는", "도 3은", "도 4는", "도 5는", "도 6는", "도 7은", "도 8은", "도 9은", "도 10은", "도 11은", "도 12은", "도 13은",
            "도 14은", "도 15은", "도 16은", "도 17은",
            "도면의 간단한 설명", "발명을 실시하기 위한 구체적인 내용", "기술분야", "배경기술", "선행기술문헌", "발명의 효과", "발명의 내용",
            "해결하려는 과제", "과제의 해결 수단", "복수의", "하나 이상의",
        ],
    },
}
MODES = ("x", "conservative", "strong")


def phrases_of(section: str, mode: str, extra: dict | None = None) -> list[str]:
    """What a mode removes from a section, with extra phrases by level; x removes nothing."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}: {mode}")
    levels = {"x": [], "conservative": ["conservative"], "strong": ["conservative", "strong"]}[mode]
    return [p for level in levels for p in [*SECTION_PHRASES[section][level], *((extra or {}).get(level, []))]]


def preprocess_section(text: Column | str, section: str, mode: str, extra: dict | None = None) -> Column:
    """One section's text in a mode: x only cleans; conservative and strong remove phrases, extra ones of a domain too."""
    phrases = phrases_of(section, mode, extra)
    t = cleanup_artifacts(without_background(text) if section == "description" else text, section)
    return squeeze(remove_phrases(t, phrases)) if phrases else t


# Patterns that say nothing about a patent's field.
COMMON_PATTERNS = [
    r"제\s*\d+\s*항", r"도\s*\d+", r"실시예", r"본\s*발명", r"상기", r"전술한", r"상술한", r"특징으로\s*함", r"구성된다", r"포함한다", r"장치", r"방법",
    r"시스템", r"데이터", r"정보", r"도면", r"위하여", r"의해", r"대한", r"기술분야", r"배경기술", r"해결하고자\s*하는\s*과제", r"발명의\s*효과",
    r"대\s*표\s*도", r"등록특허", r"청구항", r"특허청구의\s*범위", r"\[\d{4}\]",
]


def clean_for_embedding(text: Column | str) -> Column:
    """Lower-case NFKC without the common patterns, only a-z, Hangul syllables and words of two or more characters."""
    held = lambda p: max(re.findall("[가-힣]+", p) or ["["], key=len)  # noqa: E731 (a part that every match of the pattern holds)
    t = chain_held(F.lower(nfkc(filled(text))), *[("(?U)" + p, " ", held(p)) for p in COMMON_PATTERNS])
    return F.array_join(F.filter(F.split(sub(t, "[^a-z가-힣]+", " "), " "), lambda w: F.length(w) > 1), " ")


def clean_query(text: Column | str) -> Column:
    """Lower-case NFKC without stop phrases between word edges; digits, a-z, Hangul syllables and - _ / ; stay."""
    # The stop phrases.
    stop = r"(?U)\b(상기|전술한|본 발명은|특징으로 한다|의한|포함하는|관한 것으로서)\b"
    return squeeze(chain(F.lower(nfkc(filled(text))), (stop, " "), (r"(?U)[^0-9a-z가-힣\s\-_/;]", " ")))


# ---- normalisation, first version ----------------------------------------------------------------------------------

# The patterns of this part and of the second version, and the words that they hold.
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def v1_common(text: Column | str) -> Column:
    return strip(chain_held(
        sub(nfkc(filled(text)), f"[\u200b\ufeff{CONTROLS[1:]}", ""), ("\r\n?", "\n", "\r"),
        (r"(?U)\(\s*\d{2,6}\s*[a-zA-Z]?\s*\)", "", "("), ("[ \\t\\f\\x0B]+", " ", *RUNS), ("\n{3,}", "\n\n", "\n\n\n"),
    ))


def v1_abstract(text: Column | str) -> Column:
    return squeeze(chain(
        v1_common(text), (r"(?iuU)^\s*본\s*발명은\s+", ""),
        (r"(?iuU)\s*제공하는\s*데\s*그\s*목적이\s*있다\s*\.?\s*$", " 제공한다."),
        (r"(?iuU)\s*제공하는\s*것을\s*목적으로\s*한[다당]\s*\.?\s*$", " 제공한다."),
        (r"(?iuU)\s*제공하(?:는\s*것)?\s*기\s*위한\s*것이[다당]\s*\.?\s*$", " 제공한다."),
    ))


DELETED_CLAIM = r"(?iuU)(청구항\s*\d+\s*삭제|삭제된\s*청구항\s*\d+)"
CLAIM_NUMBER = r"(?U)^\s*(?:청구항|제)\s*\d+\s*(?:항)?\s*[\.\:\)]\s*"


def v1_claims(text: Column | str) -> Column:
    """Claims by line. A line break before one that a claim's header follows would only make an empty line, so none is set."""
    t = chain_held(v1_common(text), (DELETED_CLAIM, " ", "삭제"))
    refers = r"(?U)^\s*(?:제\s*\d+\s*항|청구항\s*\d+)(?:\s*내지\s*\d+)?\s*(?:중\s*어느\s*한\s*항)?\s*에\s*(?:있어서|따른|기재된|의한)\s*,?\s*"
    one = lambda b: squeeze_line(chain_held(
        strip(b), (CLAIM_NUMBER, "", "청구항", "제"), (refers, "", "항"), (r"(?U)\s*것을\s*특징으로\s*하(?:는|며|여|한)\s*", "; ", "특징으로"),
        (r"(?U)\s*;\s*", "; ", ";"), (r"(?U)(\d\)|[①②③④⑤⑥⑦⑧⑨⑩])\s*", " $1 ", ")", *"①②③④⑤⑥⑦⑧⑨⑩"),
    ))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), one), lambda b: b != ""), "\n")


def v1_description(text: Column | str) -> Column:
    return squeeze(chain(
        v1_common(text), (r"(?U)(\[\s*\d{4,5}\s*\]|【\s*\d{4,5}\s*】)", ""),
        (r"(?U)도\s*\d+(?:[a-zA-Z])?(?:\s*내지\s*도\s*\d+(?:[a-zA-Z])?)?\s*에\s*도시된\s*바와\s*같이,?\s*", ""),
        (r"(?U)본\s*발명의\s*(?:일\s*)?실시예(?:들)?(?:에)?\s*따른\s*", ""),
    ))


# ---- normalisation, second version ---------------------------------------------------------------------------------

PARAGRAPH = r"(?U)(?:\[\s*\d{3,5}\s*\]|【\s*\d{3,5}\s*】|\(\s*\d{3,5}\s*\))"
# Short technical words that keep a fragment.
TECHNICAL = r"(?iuU)\b(?:AI|GAN|SIFT|CNN|RNN|LSTM|GRU|Transformer|BERT|GPU|TPU|CPU|NPU|DSP|FPGA|ASIC|SoC|SRAM|DRAM)\b"
BLANKS = "[ \\t\\r\\f\\x0B]+"


def v2_common(text: Column | str) -> Column:
    number = (
        r"(?U)[\(\[\{]\s*(?=[^)\]\}]*?(?:\d{2,}|[a-zA-Z]))\d{1,6}[a-zA-Z]?(?:\s*(?:,|~|-)\s*\d{1,6}[a-zA-Z]?)*\s*[\)\]\}]"
    )
    return strip(chain_held(
        sub(nfkc(filled(text)), f"[\u200b-\u200d\ufeff{CONTROLS[1:]}", ""), ("\r\n?", "\n", "\r"), (number, "", *"([{"),
        (BLANKS, " ", *RUNS), ("\n{3,}", "\n\n", "\n\n\n"),
    ))


CONTENT = "가-힣A-Za-z_/-"


def content_score(text: Column | str) -> Column:
    """Letters, and the marks that technical words hold."""
    return F.coalesce(_count(_c(text), CONTENT), F.lit(0))


def _worth(least: int):
    """Whether the content score reaches least, for which a look at its first characters will do, or a technical word is there."""
    scored = f"[{CONTENT}](?:[^{CONTENT}]*+[{CONTENT}]){{{least - 1}}}"
    return lambda p: p.rlike(scored) | p.rlike(TECHNICAL)


def v2_abstract(text: Column | str) -> Column:
    """Sentences of some content, or all if none is. Sentences end behind . ? or ! (a longer ending holds the same mark)."""
    own = chain_held(sub(v2_common(text), r"(?iuU)\A\s*(요약|ABSTRACT)\s*[:：]?\s*", ""), (PARAGRAPH, "", *"[【("))
    kept = lambda t: F.filter(F.transform(F.split(t, r"(?U)\s(?<=[.?!]\s|\n)\s*"), strip), lambda p: (p != "") & _worth(5)(p))
    return strip(chain_held(let(own, lambda t: let(kept(t), lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(t))), (BLANKS, " ", *RUNS)))


def v2_claims(text: Column | str) -> Column:
    t = chain_held(
        v2_common(text), (DELETED_CLAIM, " ", "삭제"), (PARAGRAPH, " ", *"[【("), (r"(?U)(?=(?:청구항|제)\s*\d+\s*(?:항)?\s*[\.\:\)])", "\n", "청구항", "제"),
        ("[；]", ";", "；"), (r"(?U)\s*;\s*", "; ", ";"),
    )
    refers = (
        r"(?U)^\s*(?:청구항|제)\s*\d+\s*(?:항)?\s*(?:내지\s*\d+\s*(?:항)?)?\s*(?:중\s*어느\s*한\s*항)?\s*에\s*(?:있어서|따른|기재된|의한)\s*,?\s*"
    )
    weak = r"(?U)^\s*(상기|또는|및|그|해당|더욱)\s+"

    def clauses(own: Column) -> Column:
        each = F.filter(F.transform(F.split(own, ";"), strip), lambda c: c != "")
        return F.filter(F.transform(each, lambda c: strip(chain_held(c, (weak, "", *"상또및그해더")))), _worth(8))

    def line(raw: Column) -> Column:
        named = chain_held(strip(raw), (CLAIM_NUMBER, "", "청구항", "제"), (refers, "", "청구항", "제"))
        found = let(named, lambda own: let(clauses(own), lambda k: F.when(F.size(k) > 0, F.array_join(k, "; ")).otherwise(strip(own))))
        return strip(chain_held(found, (BLANKS, " ", *RUNS)))

    return strip(F.array_join(F.filter(F.transform(F.split(t, "\n+"), line), lambda x: x != ""), "\n"))


def v2_description(text: Column | str) -> Column:
    t = chain(
        v2_common(text), (PARAGRAPH, ""), (r"(?iuU)(도면의\s*간단한\s*설명|도면\s*간단\s*설명|부호의\s*설명)\s*[:：]?", " "),
        (r"(?mdU)^\s*도\s*\d+(?:[a-zA-Z])?\s*[은는]\s*.*$", " "), (r"(?mdU)^\s*\d{2,6}[a-zA-Z]?\s*[:：\-]\s*.*$", " "), (BLANKS, " "), ("\n{3,}", "\n\n"),
    )
    return strip(t)


def normalize(text: Column | str, version: str = "ver2", section: str = "general") -> Column:
    """Dispatch by version and section; a general text takes the first version's common rule or the second's for descriptions."""
    rules = {
        "ver1": {"abstract": v1_abstract, "claims": v1_claims, "description": v1_description, "general": v1_common},
        "ver2": {"abstract": v2_abstract, "claims": v2_claims, "description": v2_description, "general": v2_description},
    }
    if version not in rules:
        raise ValueError(f"version is ver1 or ver2: {version}")
    return rules[version].get(section, rules[version]["general"])(text)


def normalize_legacy(text: Column | str) -> Column:
    return strip(chain(
        F.translate(filled(text), "\u00a0", " "), ("([가-힣])\n([을를은는이가에의로])", "$1$2"), ("[ \\t]+", " "), ("\n{3,}", "\n\n"),
        (r"(?U)공개특허\s*10-\d{4}-\d{7}", ""), (r"(?U)-\s*\d+\s*-", ""), (r"(?U)\n\s*[①-⑳]\s*", "\n"),
    ))


# ---- claims -------------------------------------------------------------------------------------------


def split_claims(text: Column | str) -> Column:
    """A map from each claim header to what follows it up to the next header; of equal headers the last one's."""
    t, header = filled(text), r"(?U)청구항\s*\d+"
    heads = F.transform(F.regexp_extract_all(t, F.lit(f"({header})"), F.lit(1)), strip)
    bodies = F.transform(F.split(t, header, -1), strip)

    def mapped(h: Column, b: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_position(F.reverse(h), F.element_at(h, i)) == F.size(h) - i + 1)
        return F.map_from_arrays(F.transform(last, lambda i: F.element_at(h, i)), F.transform(last, lambda i: F.element_at(b, i + 1)))

    return let(heads, lambda h: F.when(F.size(h) > 0, let(bodies, lambda b: mapped(h, b))))


def fallback_claims(text: Column | str) -> Column:
    """From the first start pattern in list order that is anywhere to the first end pattern in list order behind it, letters' case aside."""
    # The patterns.
    starts = [r"\b청\s*구\s*항\b", r"\b청구항\b", r"\bclaims\b", r"\bwhat\s+is\s+claimed\s+is\b"]
    ends = [r"\b발명의\s+상세한\s+설명\b", r"\b발명의\s+설명\b", r"\bdetailed\s+description\b", r"\bdescription\s+of\s+embodiments\b"]
    return strip(F.coalesce(_span(filled(text), starts, ends, "(?iuU)"), F.lit("")))


def claims_or_fallback(claims: Column | str, fallback: Column | str, least: int = 300) -> Column:
    c, f = filled(claims), filled(fallback)
    return F.when((F.length(c) < least) & (f != ""), f).otherwise(c)


# The patterns of tables and equations.
def tables(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(filled(text), F.lit(r"(?U)(표\s*\d+[\s\S]+?(?=\n\n|표\s*\d+|\z))"), F.lit(1)), strip)


def equations(text: Column | str) -> Column:
    return F.regexp_extract_all(filled(text), F.lit(r"(?U)(수학식\s*\d+[\s\S]+?(?=\n\n|수학식\s*\d+|\z))"), F.lit(1))


def _count(t: Column, chars: str) -> Column:
    """How many of a class's characters a text has; a count of a pattern's matches would make a string of each."""
    return F.length(sub(t, f"[^{chars}]+", ""))


def low_quality(text: Column | str, least: int = 300, share: float = 0.15) -> Column:
    t = filled(text)
    return (F.length(strip(t)) < least) | (_count(t, "가-힣") / F.greatest(F.length(t), F.lit(1)) < share)


# ---- scalars -------------------------------------------------------------------------------------------------------


def json_object(text: Column | str) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)


def snippet(text: Column | str, most: int = 600) -> Column:
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def snippet_always(text: Column | str, most: int) -> Column:
    return F.concat(F.substring(_c(text), 1, most), F.lit("..."))


@F.pandas_udf(StringType())
def _rounded(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(x, digits)], dtype=object)


def fixed(x: Column | str, digits: int) -> Column:
    """A double to so many digits by its exact binary value, halves to even. Java rounds the shortest decimal that names it instead, which tells only
    next to a half: those alone are handed to Python."""
    x = _c(x).cast("double")
    scaled = F.abs(x) * 10.0**digits
    near = (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3) | (scaled > 1e11)
    return F.when(F.isnan(x), "nan").when(x.isNotNull(), F.coalesce(_rounded(F.when(near, x), F.lit(digits)), F.format_string(f"%.{digits}f", x)))


def percent(score: Column | str) -> Column:
    return fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), _c(score) * 100)), 2)


def renumber_dependent(claim: Column | str, number: Column) -> Column:
    own = strip(sub(claim, r"(?U)^제\s*\d+\s*항에\s*있어서\s*[\,\.]?", ""))
    return F.concat(F.lit("제"), number.cast("string"), F.lit("항. 제1항에 있어서, "), own)


def title(message: Column | str, most: int = 20, blank: str = "새 채팅") -> Column:
    t = sub(filled(message), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(t == "", blank).when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("…")))


def code(number: Column | str) -> Column:
    return F.lpad(_c(number).cast("string"), 6, "0")


def content_hash(text: Column | str) -> Column:
    return F.substring(F.md5(_c(text)), 1, 10)


def caption(text: Column | str) -> Column:
    """What follows an assistant mark, without control words, blanks squeezed."""
    t = strip(filled(text))
    for mark in ("ASSISTANT:", "Assistant:", "assistant:"):
        t = F.when(F.instr(t, mark) > 0, strip(sub(t, f"(?s)^.*?{mark}", ""))).otherwise(t)
    return squeeze(F.replace(t, F.lit("<end_of_utterance>"), F.lit(" ")))


def prompt_input(text: Column | str, described: Column | str, prefix: str = "이미지 d에 대한 설명:") -> Column:
    """The user's text, and below it what is seen in images, if anything is."""
    # The labels.
    raw, seen = strip(filled(text)), strip(filled(described))
    head = F.concat(F.lit("[사용자 텍스트 입력]\n"), raw)
    return F.when(seen == "", head).otherwise(F.concat(head, F.lit(f"\n\n[이미지 기반 도면 설명]\n{prefix} "), seen))


def labelled_parts(parts: list[tuple[str, Column]], between: str = "\n\n") -> Column:
    """A prompt from headed parts; the headings are the caller's."""
    return F.concat_ws(between, *[F.concat(F.lit(h + "\n"), filled(c)) for h, c in parts])


def html_escape(text: Column | str) -> Column:
    t = filled(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# Headings of an answer, and the sub-headings under its numbered parts.
ANSWER_SECTIONS = ["사용자의 아이디어 요약", "유사 특허 목록", "발명의 명칭", "특허청구범위", "발명의 설명"]
ANSWER_PARTS = ["기술분야", "배경기술", "발명의 내용", "발명의 실시를 위한 구체적인 내용", "산업상 이용가능성"]
ANSWER_SUBTITLES = [
    "해결하고자 하는 과제", "과제의 해결 수단", "발명의 효과", "전체 처리 흐름", "Dynamic Weights Algorithm 적용",
    "RAG 기반 컨텍스트 및 few-shot 예시 구성의 구체화", "시스템 구성의 예",
]
ANSWER_ENDS = ["방법", "시스템", "장치", "매체", "것", "단계", "수단"]


def format_answer(text: Column | str) -> Column:
    """Line breaks of an answer: broken words and items joined, headings, claims, numbered parts and lists on lines of their own."""
    end, parts, subs = "|".join(f"{e}\\." for e in ANSWER_ENDS), "|".join(ANSWER_PARTS), "|".join(ANSWER_SUBTITLES)
    t = F.replace(filled(text), F.lit("-" * 64), F.lit(""))
    joined = [(rf"(?U)([가-힣])\s*\n+\s*{x}\.", f"$1{x}.") for x in ("다", "법", "템")]
    joined += [(r"(?U),\s*\n+\s*", ", "), (r"(?U)\s*\n+\s*(\([가-하]\))", " $1"), (r"(?U)(\([가-하]\))\s*\n+\s*", "$1 ")]
    heads = [(rf"\[{h}\]", f"\n\n[{h}]\n") for h in ANSWER_SECTIONS]
    rest = [
        (rf"(?U)({end})\s+청구항\s*([0-9]+)(?=\s+(?!에 있어서)[가-힣A-Za-z])", "$1\n\n청구항 $2\n"),
        (r"(?mdU)(^|\n)\s*청구항\s*([0-9]+)\s*$", "\n\n청구항 $2"),
        (r"(?U)\n+\s*청구항\s*([0-9]+)\s*\n+\s*에 있어서", "\n\n청구항 $1에 있어서"),
        (rf"(?U)([0-9]+)\.\s*({parts})", "\n\n$1. $2\n"),
        (rf"(?U)(^|\n)\s*([가-하])\.\s*({subs})", "\n\n$2. $3"),
        (r"(?U)\s-\s", "\n- "),
        (r"(?U)\s\(([0-9]+)\)\s", "\n($1) "),
        ("\n{3,}", "\n\n"),
    ]
    return strip(chain(t, *joined, *heads, *rest))


def line_class(line: Column | str) -> Column:
    """What a line of an answer is; the first rule that holds."""
    t = strip(filled(line))
    return (
        F.when(t == "", "break")
        .when(t.startswith("[") & t.endswith("]"), "ai-section-title")
        .when(t.rlike(r"(?U)^청구항\s*[0-9]+\s*$"), "ai-claim-title")
        .when(t.rlike(r"(?U)^청구항\s*[0-9]+\s*에 있어서"), "ai-paragraph")
        .when(t.rlike(r"^[0-9]+\.") | t.rlike(r"^[가-하]\."), "ai-sub-title")
        .when(t.startswith("-"), "ai-list-item")
        .otherwise("ai-paragraph")
    )


def date_text(value: Column | str) -> Column:
    """A date as written in Korean; as it is if it isn't one, - if missing or empty."""
    v = F.nullif(_c(value), F.lit(""))
    at = F.try_to_timestamp(v)
    return F.coalesce(F.when(at.isNotNull(), F.date_format(at, "yyyy. M. d.")).otherwise(v), F.lit("-"))


def input_type(value: Column | str, exists: Column) -> Column:
    return F.when(F.lower(F.trim(_c(value))).endswith(".pdf") & exists, "pdf").otherwise("text")
