"""Prompts from a document's parts, as Column expressions. All wording is the caller's: headings, what stands for a missing part, instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, or_else, strip


def headed(heading: str, text: Column | str, missing: str | None = None, least: int = 1) -> Column:
    """A heading's line and the stripped text's; of a text shorter than least `missing` in its place, or nothing at all if that is None."""
    own = strip(filled(text))
    whole = F.concat(F.lit(heading + "\n"), own, F.lit("\n"))
    return F.when(F.length(own) >= least, whole).otherwise(F.lit("") if missing is None else F.lit(f"{heading}\n{missing}\n"))


def joined(*parts: Column | str, keep_blank: bool = False) -> Column:
    """Parts on lines of their own; blank ones left out unless kept. A str is the caller's wording, not a column."""
    own = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n", *[p if keep_blank else F.when(strip(p) != "", p) for p in own])


def json_list(texts: Column) -> Column:
    """An array of strings as JSON, one on each line."""
    quoted = F.transform(texts, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.when(F.size(texts) > 0, F.concat(F.lit("[\n  "), F.array_join(quoted, ",\n  "), F.lit("\n]"))).otherwise("[]")


def head(text: Column, most: int, mark: str = "...", always: bool = False) -> Column:
    """The first characters, with a mark behind them if there are more, or always."""
    own = F.substring(filled(text), 1, most)
    return F.concat(own, F.when(F.lit(always) | (F.length(text) > most), mark).otherwise(""))


def summary(text: Column | str, heading: str, short: str, instructions: str, least: int = 50) -> Column:
    """What summarises a document; of very short texts only that they are."""
    return joined(headed(heading, text, short, least), instructions, keep_blank=True)


def claim_parts(claim: Column | str, heading: str, missing: str, instructions: str) -> Column:
    return joined(headed(heading, claim, missing), instructions, keep_blank=True)


def difference(idea: Column | str, prior: Column, headings: tuple[str, str], missing: str, instructions: str) -> Column:
    """An idea beside the elements of prior art (array of strings)."""
    elements = F.when(F.size(prior) > 0, json_list(prior)).otherwise(F.lit(missing))
    return joined(headed(headings[0], idea), headed(headings[1], elements), instructions)


def consensus(drafts: Column, heading: str, missing: str, instructions: str) -> Column:
    return joined(headed(heading, F.when(F.size(drafts) > 0, json_list(drafts)).otherwise(F.lit(missing))), instructions, keep_blank=True)


def shown_examples(examples: Column, heading: str, labels: tuple[str, str], rule: str, most: tuple[int, int] = (300, 600)) -> Column:
    """Examples (abstract, claims) to write like, each cut, a rule behind each; none gives ""."""
    one = lambda x: F.concat(F.lit(labels[0] + "\n"), head(x["abstract"], most[0], always=True), F.lit(f"\n\n{labels[1]}\n"), head(x["claims"], most[1], always=True), F.lit(f"\n\n{rule}\n"))
    return F.when(F.size(examples) > 0, F.concat(F.lit(heading + "\n"), F.array_join(F.transform(examples, one), ""))).otherwise("")


def draft(examples: Column, context: Column, idea: Column | str, only: Column, headings: tuple[str, str], instructions: str) -> Column:
    """Examples, prior art, the idea and what only it has, and what to do with them; blank parts left out."""
    difference_ = F.concat(F.lit(headings[0] + "\n"), filled(idea), F.lit(f"\n\n{headings[1]}\n"), json_list(only), F.lit("\n"))
    return joined(examples, context, difference_, instructions)


def document(heading: str, fields: list[tuple[str, Column]], sections: list[tuple[str, Column]], captions: Column, caption: str, missing: str = "") -> Column:
    """A parsed document: fields on a line each, headed sections, and numbered captions of its images (an array; blank ones left out but counted)."""
    lines = [F.concat(F.lit(f"{name}: "), or_else(filled(c), F.lit(missing))) for name, c in fields]
    parts = [F.concat(F.lit(f"\n{name}\n"), or_else(filled(c), F.lit(missing))) for name, c in sections]
    seen = F.transform(captions, lambda c, i: F.when(strip(filled(c)) != "", F.concat(F.lit(caption + " "), (i + 1).cast("string"), F.lit("\n"), strip(c))))
    whole = F.concat_ws("\n", F.lit(heading), *lines, *parts)
    images = F.array_join(F.filter(seen, lambda x: x.isNotNull()), "\n\n")
    return F.when(images == "", whole).otherwise(F.concat(whole, F.lit("\n\n"), images))


def final(examples: Column, fields: list[tuple[str, Column]], headings: tuple[str, str], example: str, labels: tuple[str, str, str, str], instructions: str, missing: str = "", most: int = 600) -> Column:
    """Similar documents (doc_id, score, abstract, claims) with scores to four places, the parts of the document to write, and instructions."""
    one = lambda x, i: F.concat(
        F.lit(f"{example} "), (i + 1).cast("string"), F.lit(f"\n- {labels[0]}: "), x["doc_id"].cast("string"), F.format_string(f"\n- {labels[1]}: %.4f", x["score"]),
        F.lit(f"\n- {labels[2]}: "), head(or_else(filled(x["abstract"]), F.lit(missing)), most), F.lit(f"\n- {labels[3]}: "), or_else(filled(x["claims"]), F.lit(missing)),
    )
    lines = [F.concat(F.lit(f"- {name}: "), or_else(filled(c), F.lit(missing))) for name, c in fields]
    return F.concat_ws("\n", F.lit(headings[0]), F.array_join(F.transform(examples, one), "\n"), F.lit("\n" + headings[1]), *lines, F.lit("\n" + instructions))
