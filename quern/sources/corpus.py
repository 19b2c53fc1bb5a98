"""Sources: JSON corpora, vector packs, page texts; and the shapes that they are read into."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.headings import with_sections
from quern.functions.phrases import remover
from quern.operators.vectors import first_wins

SECTIONS = ("abstract", "claims", "description")
_parts = ", ".join(f"{s}: string" for s in SECTIONS)
RECORD = f"doc_id string, id string, {', '.join(f'{s} string' for s in SECTIONS)}, clean_text struct<{_parts}>, raw_text struct<{_parts}>"
QUERY = (
    "type string, type_reason string, " + ", ".join(f"{s} struct<raw: string, clean: string>" for s in SECTIONS)
    + ", normalization_log struct<" + ", ".join(f"{s}_removed_or_weakened: array<string>" for s in SECTIONS) + ">, missing_information array<string>"
)
PATENT = (
    "id string, title string, abstract string, claims string, description string, ipc string, "
    "extracted_images array<struct<page: int, filename: string, width: int, height: int, path: string>>, "
    "tables_raw array<string>, equations_detected array<string>, claims_structured map<string, string>"
)


def project(records: DataFrame) -> DataFrame:
    """(domain, doc_id, path, sections): a section's cleaned text, else its raw one, else the record's own field, else ""."""
    one = lambda s: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (f"clean_text.{s}", f"raw_text.{s}", s)], F.lit("")).alias(s)
    return records.select("domain", F.coalesce("doc_id", "id", F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("doc_id"), "path", *[one(s) for s in SECTIONS])


def json_corpus(spark: SparkSession, root: str, domains: list[str]) -> DataFrame:
    """The records of root/<domain>/*.json for the domains that there are."""
    there = [f"{root}/{d}" for d in domains if _exists(spark, f"{root}/{d}")]
    if not there:
        return project(spark.createDataFrame([], RECORD + ", path string, domain string"))
    found = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(there)
    found = found.withColumn("path", F.col("_metadata.file_path"))
    return project(found.withColumn("domain", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def by_section(records: DataFrame, sections=SECTIONS) -> DataFrame:
    """(section, domain, doc_id, text), one row for each record and section."""
    return records.unpivot(["domain", "doc_id"], list(sections), "section", "text").select("section", "domain", "doc_id", "text")


def by_mode(records: DataFrame, sections=SECTIONS, modes=T.MODES, extra: dict | None = None) -> DataFrame:
    """(section, mode, domain, doc_id, text): every section in every mode. extra: for a domain its own phrases by level, removed with those that all domains share.

    A text is normalised once, and its x form made once; the other modes are that form without their phrases."""
    own = by_section(records, sections).withColumn("text", T.nfkc(T.filled("text")))
    x = F.lit(None).cast("string")
    for s in sections:
        x = F.when(F.col("section") == s, T.normal_form(s, F.col("text"))).otherwise(x)
    made = own.select("section", "domain", "doc_id", x.alias("x"))  # below the explode, which would repeat it
    each = made.select("*", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    lists = {f"{s}/{m}/{d}": T.phrases_of(s, m, (extra or {}).get(d)) for s in sections for m in modes for d in ["", *(extra or {})]}
    named = F.when(F.col("domain").isin(*(extra or {})), F.col("domain")).otherwise("") if extra else F.lit("")
    removed = remover({k: v for k, v in lists.items() if v})(F.col("x"), F.concat_ws("/", "section", "mode", F.coalesce(named, F.lit(""))))
    return each.select("section", "mode", "domain", "doc_id", F.coalesce(T.squeeze(removed), F.col("x")).alias("text"))


def text_by_mode(records: DataFrame, mode: str, least: int = 80) -> DataFrame:
    """(doc_id, text) of the claims, or of abstract and claims; shorter texts left out."""
    parts = {"claims_only": ["claims"], "abs_claims": ["abstract", "claims"]}
    if mode not in parts:
        raise ValueError(f"mode is one of {', '.join(parts)}: {mode}")
    return records.select("doc_id", F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in parts[mode]]).alias("text")).where(F.length(T.strip("text")) >= least)


def core_text(claims: str = "claims", description: str = "description") -> F.Column:
    """The claims and a middle part of the description."""
    return F.concat_ws("\n\n", T.filled(claims), F.substring(T.filled(description), 2001, 6000))


def sampled(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that depends on the seed alone."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")).cast("binary")), ident).limit(n)


def npz_pack(spark: SparkSession, path: str, vectors: str = "vectors", labels: str = "labels", ids: str = "doc_ids") -> DataFrame:
    """(label, doc_id, vector, pos, path) of NumPy archives, read where they lie. An archive without labels has those of its file's name."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    x = z[vectors].astype("float32")
                    own = name.rsplit("/", 1)[-1]
                    label = z[labels].astype(str) if labels in z else [own.removesuffix("_combined_embeddings.npz")] * len(x)
                    ident = z[ids].astype(str) if ids in z else z["filenames"].astype(str)
                for at in range(0, len(x), 4096):
                    part = slice(at, at + 4096)
                    yield pd.DataFrame({"label": list(label[part]), "doc_id": list(ident[part]), "vector": list(x[part]), "pos": range(at, at + len(x[part])), "path": own})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(read, "label string, doc_id string, vector array<float>, pos long, path string")


def meta(text: F.Column) -> F.Column:
    """A pack's description as a map; an empty one if it can't be read."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def union_packs(packs: list[DataFrame]) -> DataFrame:
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def indexed_vectors(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows (id, filename, load_seq) with the vectors of their files (filename, vector); of equal names the first loaded."""
    return first_wins(index.join(vectors, "filename"), ["filename"], "load_seq")


def saved_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Statistics or weights as they were saved (parquet, csv or json), with the types they had."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(f"{path}/csv") if kind == "csv" else reader.format(kind).load(f"{path}/{kind}")


def for_fields(saved: DataFrame, fields: list, key: str = "field") -> DataFrame:
    """The rows of these fields; a field without rows is an error."""
    there = {r[0] for r in saved.where(F.col(key).isin(*fields)).select(key).distinct().collect()}  # at most as many as were asked for
    if lost := [f for f in fields if f not in there]:
        raise FileNotFoundError(f"nothing saved for {', '.join(map(str, lost))}")
    return saved.where(F.col(key).isin(*fields))


def whole_cache(cache: DataFrame, sections=SECTIONS) -> DataFrame:
    """A cache (field, doc_id, section, vector) in order of ids; a document that lacks a section is an error."""
    lost = missing_sections(cache, sections).orderBy("field", "doc_id", "section").head(1)
    if lost:
        raise FileNotFoundError(f"no vector of section {lost[0]['section']} of {lost[0]['doc_id']} in {lost[0]['field']}")
    return cache.orderBy("field", "doc_id", "section")


def missing_sections(cache: DataFrame, sections=SECTIONS) -> DataFrame:
    """(field, doc_id, section) that a cache of section vectors lacks."""
    ids = cache.select("field", "doc_id").distinct()
    want = ids.withColumn("section", F.explode(F.array(*[F.lit(s) for s in sections])))
    return want.join(cache.select("field", "doc_id", "section"), ["field", "doc_id", "section"], "left_anti")


def to_parse(paths: DataFrame, cached: DataFrame, ident: str = "doc_id") -> DataFrame:
    """What a cache of parsed results doesn't hold yet."""
    return paths.join(cached.select(ident).distinct(), ident, "left_anti")


def distinct_paths(*lists: DataFrame) -> DataFrame:
    return union_packs([x.select("path") for x in lists]).distinct()


def page_texts(pages: DataFrame, ocr, version: str = "ver2", once: bool = True, least: int = 0, tag: str | None = None) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page, text, image). Pages of low quality get the text that `ocr`, a Column function of the image,
    reads: the first such page of a document alone (once), or all. Then each is normalised; short ones are left out; they are joined in order."""
    pages = pages.withColumn("low", T.low_quality("text"))  # below the window, so that it is worked out once
    nth = F.sum(F.col("low").cast("int")).over(Window.partitionBy("doc_id").orderBy("page"))
    turn = F.col("low") & ((nth == 1) if once else F.lit(True))
    own = pages.withColumn("text", F.when(turn, ocr(F.col("image"))).otherwise(F.col("text"))).where("text <> ''")
    # A filter would be pushed below the rule and take it a second time; an array of one text or none isn't.
    made = F.array(T.normalize("text", version))
    own = own.select("doc_id", "page", F.explode(F.filter(made, lambda t: F.length(F.trim(t)) >= least) if least > 0 else made).alias("text"))
    if tag:
        own = own.withColumn("text", F.concat(F.format_string(tag, F.col("page")), F.col("text")))
    pages_of = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return own.groupBy("doc_id").agg(F.array_join(pages_of, "\n\n").alias("text"))


def usable_images(images: DataFrame, side: int = 100, most: int = 5) -> DataFrame:
    """Images (doc_id, page, filename, width, height, path) of some size, the first few of each document."""
    big = images.where((F.col("width") >= side) & (F.col("height") >= side))
    return big.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "filename"))).where(F.col("nth") <= most)


def section_records(texts: DataFrame) -> DataFrame:
    """(doc_id, text) as sectioned patent records; claims from the fallback where the section has too little."""
    own = with_sections(texts.select("doc_id", "text"))
    own = own.withColumn("claims", T.claims_or_fallback("claims", T.fallback_claims("text")))
    return own.select(
        F.col("doc_id").alias("id"), "title", "abstract", "claims", "description", "ipc", T.tables("text").alias("tables_raw"), T.equations("text").alias("equations_detected"),
        T.split_claims("claims").alias("claims_structured"),
    )


def parsed_query(raw: F.Column, fallback: F.Column) -> F.Column:
    """A sectioned query from a model's answer; where a required part is missing, the raw input in every section."""
    answer = F.from_json(T.json_object(raw), QUERY)
    whole = answer["type"].isNotNull() & answer["abstract"].isNotNull() & answer["claims"].isNotNull() & answer["description"].isNotNull()
    own = F.struct(fallback.alias("raw"), fallback.alias("clean"))
    return F.struct(
        F.when(whole, answer["type"]).otherwise("Ai").alias("type"), *[F.when(whole, answer[s]).otherwise(own).alias(s) for s in SECTIONS]
    )


def newest_file(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path) of the file that was changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def examples(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n ranked hits as examples of an abstract and its claims, missing ones empty."""
    return hits.where(F.col("rank") <= n).select("rank", T.filled("abstract").alias("abstract"), T.filled("claims").alias("claims"))


def prior_art(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first few hits, each with a snippet of its claims, as one text; behind a limit, so few rows."""
    line = F.concat(F.lit("<"), F.col("rank").cast("string"), F.lit(". "), F.col("doc_id").cast("string"), F.lit("> "), T.filled("abstract"), F.lit(" | "), T.snippet_always("claims", 300))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.where(F.col("rank") <= most).agg(F.array_join(lines, "\n").alias("text"))


def job_arguments(argv: list[str]) -> dict:
    """--text or --pdf (not both), --output and --num-fewshots of a job."""
    import argparse

    p = argparse.ArgumentParser()
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--text")
    one.add_argument("--pdf")
    p.add_argument("--output")
    p.add_argument("--num-fewshots", type=int, default=3)
    return vars(p.parse_args(argv))


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
