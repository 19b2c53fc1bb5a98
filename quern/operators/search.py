"""Exact similarity search: domain filter or whitening, scores, top-k, score-gap cutoffs, late lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.numbering import numbered
from quern.operators.vectors import vector_mean
from quern.sources.shared import written


def detect_fields(means: DataFrame, query: DataFrame) -> DataFrame:
    """(label, score): cosine of the query (one row `q`) with each field's mean of length 1, best first."""
    scored = means.join(F.broadcast(query.select("q")), F.lit(True))
    return scored.select("label", V.dot("q", V.l2_added("mean")).alias("score")).orderBy(F.desc("score"), "label")


def whiten(corpus: DataFrame, means: DataFrame, vector: str = "vector") -> DataFrame:
    """Each vector less its own field's mean (none: as it is), of length 1."""
    joined = corpus.join(means.select("label", "mean"), "label", "left")
    return joined.withColumn(vector, V.l2_added(V.minus(vector, F.coalesce("mean", V.zeros_like(vector))))).drop("mean")


def top_k(scored: DataFrame, k: int, ident: str = "doc_id") -> DataFrame:
    """The k best rows, ties to the smaller id: a bounded heap in each partition."""
    return scored.orderBy(F.desc("score"), ident).limit(k)


def gap_cutoff(scored: DataFrame, first: int, gap: float, default: int = 10, most: int = 15, ident: str = "doc_id") -> DataFrame:
    """The best rows up to the first gap of more than `gap` between neighbours at or behind place `first` (from 0); without one
    `default` rows; never over `most`. Only the best `most` + 1 rows are looked at, which is all that can matter."""
    best = top_k(scored, most + 1, ident)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), ident)  # most + 1 rows
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("gap", F.col("score") - F.lead("score").over(order))
    cut = F.min(F.when((F.col("rank") - 1 >= first) & (F.col("gap") > gap), F.col("rank"))).over(Window.partitionBy(F.lit(0)))
    upto = ranked.withColumn("upto", F.least(F.coalesce(cut, F.lit(default)), F.lit(most)))
    return upto.where(F.col("rank") <= F.col("upto")).drop("gap", "upto")


def whitened_search(corpus: DataFrame, query: DataFrame, dim: int, first: int = 3, gap: float = 0.05) -> DataFrame:
    """The minimum retrieval slice: field means, the query's field, both sides less their means, cosines, gap cutoff. corpus: (doc_id, label,
    vector); query: one row (q)."""
    means = vector_mean(corpus, ["label"], "vector", dim)
    best = detect_fields(means, query).limit(1).select(F.col("label").alias("field"))
    q = (
        means.join(F.broadcast(best), F.col("label") == F.col("field")).join(F.broadcast(query), F.lit(True))
        .select(V.l2_added(V.minus("q", "mean")).alias("q"))
    )
    scored = whiten(corpus, means).join(F.broadcast(q), F.lit(True)).select("doc_id", "label", V.dot("vector", "q").alias("score"))
    return gap_cutoff(scored, first, gap)


def domain_search(corpus: DataFrame, query: DataFrame, domain, k: int = 10) -> DataFrame:
    """The k best of one domain; the filter reaches the scan."""
    own = corpus.where(F.col("label") == F.lit(domain))
    return top_k(own.join(F.broadcast(query), F.lit(True)).select("doc_id", "label", V.dot("vector", "q").alias("score")), k)


def few_shots(hits: DataFrame, n: int, least: float = 0.05, always: int = 2) -> DataFrame:
    """Of ranked hits (rank, score) those of some score, the first `always` whatever theirs, n at most."""
    return hits.where((F.col("score") >= least) | (F.col("rank") <= always)).where(F.col("rank") <= n)


def with_text(hits: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts looked up behind the limit; a hit without one stays."""
    return texts.join(F.broadcast(hits), key, "right")


# ---- many queries at once

#: Queries whose vectors stand in every task at once: at most so many, 25 MB at 768 dimensions. More take more passes over the corpus.
AT_ONCE = 4096
HITS = "query_id long, doc_id long, score double"


def fields_of(means: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, q) with the field of each, the label whose mean it is closest to, and that mean. The means travel as one row: labels are few."""
    every = means.select("label", "mean").where("mean IS NOT NULL").agg(F.collect_list(F.struct("label", "mean", V.l2_added("mean").alias("unit"))).alias("_means"))
    best = F.array_min(F.transform("_means", lambda m: F.struct((-V.dot(F.col("q"), m["unit"])).alias("s"), m["label"].alias("label"), m["mean"].alias("mean"))))
    return queries.join(F.broadcast(every), F.lit(True)).withColumn("_best", best).select(*queries.columns, F.col("_best.label").alias("field"), F.col("_best.mean").alias("mean"))  # one row


def top_k_each(corpus: DataFrame, queries: DataFrame, k: int, at_once: int = AT_ONCE) -> DataFrame:
    """HITS with rank: the k best of corpus (doc_id, vector) for each of queries (query_id, q) by product, ties to the smaller doc_id.

    Each task keeps k rows for each query while its rows pass, and only those are shuffled. Null vectors, and ones of another length than the queries',
    take no part; of equal query ids each row is a query of its own and their hits are one list, so ids are keys."""
    own = written(queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles("q").alias("q")).where("q IS NOT NULL"), "queries")
    n, docs = own.count(), corpus.select(F.col("doc_id").cast("long").alias("doc_id"), V.doubles("vector").alias("vector")).where("vector IS NOT NULL")
    if n > at_once:
        own = written(numbered(own, [], ["query_id"], "_n", 0), "queries")
    found = None
    for at in range(0, max(n, 1), at_once):
        block = (own.where(f"_n >= {at} AND _n < {at + at_once}") if n > at_once else own).select("query_id", "q").collect()  # at_once at most
        hits = written(_heaps(docs, block, k), "hits") if block else own.sparkSession.createDataFrame([], HITS)
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # k rows from each task at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _heaps(docs: DataFrame, block: list, k: int) -> DataFrame:
    ids = np.array([r["query_id"] for r in block])
    sent = docs.sparkSession.sparkContext.broadcast(np.array([r["q"] for r in block], float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
        for pdf in batches:
            pdf = pdf[pdf["vector"].map(len) == q.shape[1]]
            for start in range(0, len(pdf), 2048):
                part = pdf.iloc[start : start + 2048]
                x, doc = np.stack(part["vector"].to_numpy()), part["doc_id"].to_numpy(np.int64)
                for i, s in enumerate(q @ x.T):
                    old, names = best[i]
                    keep = s >= old[-1] if len(old) == k else slice(None)
                    s, d = np.concatenate([old, s[keep]]), np.concatenate([names, doc[keep]])
                    if len(s) > k:
                        top = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, d = s[top], d[top]
                    first = np.lexsort((d, -s))[:k]
                    best[i] = s[first], d[first]
        for i, (s, d) in enumerate(best):
            if len(s):
                yield pd.DataFrame({"query_id": ids[i], "doc_id": d, "score": s})

    return docs.mapInPandas(run, HITS)


def gap_cutoff_each(hits: DataFrame, first: int, gap: float, default: int = 10, most: int = 15) -> DataFrame:
    """gap_cutoff of each query's ranked hits, of which it needs the best `most` + 1."""
    order, whole = Window.partitionBy("query_id").orderBy("rank"), Window.partitionBy("query_id")
    own = hits.where(F.col("rank") <= most + 1).withColumn("_gap", F.col("score") - F.lead("score").over(order))
    cut = F.min(F.when((F.col("rank") - 1 >= first) & (F.col("_gap") > gap), F.col("rank"))).over(whole)
    return own.withColumn("_upto", F.least(F.coalesce(cut, F.lit(default)), F.lit(most))).where(F.col("rank") <= F.col("_upto")).drop("_gap", "_upto")


def whitened_search_each(corpus: DataFrame, queries: DataFrame, dim: int, first: int = 3, gap: float = 0.05, most: int = 15, at_once: int = AT_ONCE) -> DataFrame:
    """whitened_search for each of queries (query_id, q), each with the mean of its own field: HITS, rank and the query's field."""
    means = written(vector_mean(corpus, ["label"], "vector", dim), "means")
    asked = written(fields_of(means, queries).select("query_id", "field", V.l2_added(V.minus("q", "mean")).alias("q")), "asked")
    hits = top_k_each(whiten(corpus, means), asked, most + 1, at_once)
    return gap_cutoff_each(hits, first, gap, most=most).join(asked.select("query_id", "field"), "query_id")
