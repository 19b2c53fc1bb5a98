"""Sections of whole patent texts: one scan finds all headings in order, what stands between them is cut out once, and a few states over
the list of headings yield title, abstract, claims and description.

A section runs from its first heading to the first heading behind it that ends it. Something must stand between: a heading
at which a section's own text would begin (blanks aside; for claims, at once) doesn't end it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import filled, strip, sub

# The headings, blanks within them allowed, and what marks a page and a class.
HEADINGS = [
    r"발명의?\s*명칭", r"요\s*약", r"\(57\)", r"청구범위", r"청구항(?:\s*\d+)?", r"명\s*세\s*서", r"발명의?\s*설명",
    r"기\s*술\s*분\s*야", r"배\s*경\s*기\s*술", r"발명의?\s*내용",
]
PAGE_MARK = r"(?U)-\s*\d+\s*-"
CLASS = r"(?U)[A-H][0-9]{2}[A-Z]\s*\d+/\d+"
NAMED, SUMMED, CLAIMED = ["발명의명칭", "발명명칭"], ["요약"], ["청구범위", "청구항1"]
ABOUT, BEGUN = ["발명의설명", "발명설명"], ["기술분야", "배경기술"]
NAME_ENDS = ["(57)", "요약"]
SUMMARY_ENDS = ["청구범위", "청구항", "청구항1", "명세서", *ABOUT]
DESCRIBED = [*BEGUN, "발명의내용", "발명내용"]

_ANY = "(?U)(" + "|".join(HEADINGS) + ")"


def scanned(df: DataFrame, text: Column | str) -> DataFrame:
    """df with _text (without page marks), _heads (all headings in order), _gaps (what stands before, between and behind them) and _kinds."""
    out = df.withColumn("_text", sub(filled(text), PAGE_MARK, ""))
    out = out.withColumns({"_heads": F.regexp_extract_all("_text", F.lit(_ANY), F.lit(1)), "_gaps": F.split("_text", _ANY, -1)})

    def kind(h: Column) -> Column:
        k = F.regexp_replace(h, r"(?U)\s+", "")
        return F.when(k.startswith("청구항1"), "청구항1").when(k.startswith("청구항"), "청구항").otherwise(k)

    return out.withColumn("_kinds", F.transform("_heads", kind))


def _first(kinds: list[str], after: Column | int = 0) -> Column:
    """The number of the first heading of these kinds behind the given number, or 0."""
    after = F.lit(after) if isinstance(after, int) else after
    rest = F.slice("_kinds", (after + 1).cast("int"), F.greatest(F.size("_kinds") - after.cast("int"), F.lit(0)))
    at = F.array_position(F.transform(rest, lambda k: k.isin(*kinds)), F.lit(True))
    return F.when(at > 0, at + after).otherwise(0)


def _between(i: Column, j: Column) -> Column:
    """What stands behind heading i and before heading j."""
    whole = F.transform(F.sequence(i + 1, j - 1), lambda k: F.concat(F.element_at("_heads", k.cast("int")), F.element_at("_gaps", (k + 1).cast("int"))))
    return F.concat(F.element_at("_gaps", (i + 1).cast("int")), F.when(j > i + 1, F.array_join(whole, "")).otherwise(""))


def with_sections(df: DataFrame, text: Column | str = "text") -> DataFrame:
    """df with title, abstract, claims, description and ipc of a whole text, "" where there is none; null is empty."""
    out, size = scanned(df, text), F.size("_heads").cast("long") + 1
    begins = {"_t": NAMED, "_a": SUMMED, "_c": CLAIMED, "_d": DESCRIBED}
    out = out.withColumns({c: _first(kinds) for c, kinds in begins.items()})
    behind = lambda c: F.element_at("_gaps", (F.col(c) + 1).cast("int"))
    bare = {"_t": strip(behind("_t")) == "", "_a": strip(_unbracketed(behind("_a"), _bracketed("_a"))) == "", "_c": behind("_c") == ""}
    ends = {"_t": NAME_ENDS, "_a": SUMMARY_ENDS, "_c": [*ABOUT, *BEGUN]}
    out = out.withColumns({f"{c}e": F.when(F.col(c) > 0, _first(ends[c], F.col(c) + F.when(bare[c], 1).otherwise(0))).otherwise(0) for c in ends})
    cut = lambda c: _between(F.col(c), F.when(F.col(f"{c}e") > 0, F.col(f"{c}e")).otherwise(size))

    # A title ends at an empty line too, and before the bracket of a bracketed heading if something else stands there.
    name, far = sub(cut("_t"), r"(?U)^\s+", ""), F.col("_te") > 0
    name = F.when(far & _bracketed("_te") & (F.length(name) > 1), F.regexp_replace(name, "【$", "")).otherwise(name)
    line = F.instr(name, "\n\n")
    title = F.when(line > 0, F.substring_index(name, "\n\n", 1)).when(far, name).otherwise("")
    # Claims that begin at a background heading end inside it, if that is one of a field too.
    nxt = (F.col("_c") + 1).cast("int")
    inner = bare["_c"] & F.coalesce((F.get("_kinds", F.col("_c").cast("int")) == "배경기술") & F.get("_gaps", nxt).rlike(r"(?U)^\s*분\s*야"), F.lit(False))
    made = {
        "title": F.when(F.col("_t") > 0, strip(title)).otherwise(""),
        "abstract": F.when((F.col("_a") > 0) & (F.col("_ae") > 0), strip(_unbracketed(cut("_a"), _bracketed("_a"))))
        # a bracket alone before the one heading that could end it
        .when(_bracketed("_a") & (behind("_a") == "】") & F.coalesce(F.get("_kinds", F.col("_a").cast("int")).isin(*SUMMARY_ENDS), F.lit(False)), "】").otherwise(""),
        "claims": F.when((F.col("_c") > 0) & inner, F.concat(F.element_at("_heads", F.col("_c").cast("int")), strip(F.regexp_extract(F.get("_heads", F.col("_c").cast("int")), r"(?U)^배\s*경", 0)))).when((F.col("_c") > 0) & (F.col("_ce") > 0), strip(F.concat(F.element_at("_heads", F.col("_c").cast("int")), cut("_c")))).otherwise(""),
        "description": F.when(F.col("_d") > 0, F.concat(F.element_at("_heads", F.col("_d").cast("int")), _between(F.col("_d"), size))).otherwise(""),
        "ipc": F.regexp_extract("_text", CLASS, 0),
    }
    made["description"] = F.when((F.col("_d") > 0) & (F.col("_d") == size - 1) & (behind("_d") == ""), "").otherwise(strip(made["description"]))
    return out.withColumns(made).drop("_text", "_heads", "_gaps", "_kinds", *begins, *[f"{c}e" for c in ends])


def _bracketed(c: str) -> Column:
    """Whether heading number c is the one that brackets stand around."""
    at = F.col(c).cast("int")
    return F.coalesce((at > 0) & (F.element_at("_heads", F.greatest(at, F.lit(1))) == "요약") & F.element_at("_gaps", F.greatest(at, F.lit(1))).endswith("【") & F.element_at("_gaps", at + 1).startswith("】"), F.lit(False))


def _unbracketed(text: Column, bracketed: Column) -> Column:
    return F.when(bracketed, F.substring(text, 2, 1 << 30)).otherwise(text)
