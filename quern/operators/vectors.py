"""Vector means, pair statistics without pairs, dynamic section weights, centering and fusion.

Pair statistics come from moments: with s the sum of a group's unit vectors and G the sum of their outer products, the mean
of all pair products is (|s|^2 - sum |x|^2) / (n (n - 1)) and their second moment (|G|^2 - sum |x|^4) / (n (n - 1)); across groups
s_a.s_b / (n_a n_b) and <G_a, G_b> / (n_a n_b). One pass of size N D^2 takes the place of N^2 pairs, and one row for each group is
what is left of any number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions import vectors as V


#: From so many dimensions on means are summed by Arrow batch: one aggregate for each dimension is a plan that grows with them.
WIDE = 256
#: Dimensions that travel as one row.
SLICE = 64
#: Doubles of sums that a task holds at most; then they leave it, and are added up with what it sends later.
HELD = 1 << 20


def wide_stats(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, mean, std, most, n): mean, population deviation and maximum of each dimension in each group. Each task adds up its own rows, about the means
    that it has so far, for as many groups as HELD allows; what leaves it is a row for each group and SLICE dimensions, and those are added up by lanes of tasks before all. Null entries
    don't count; a dimension without any has a null mean. The vectors of a group are of one length; a null vector counts in n alone."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", lane int, at int, rows long, n array<double>, s array<double>, q array<double>, h array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        held = 0
        for b in batches:
            column = b.column(len(keys))
            names = pd.DataFrame({k: b.column(i).to_pandas() for i, k in enumerate(keys)})
            for key, at in names.groupby(keys, dropna=False, sort=False).indices.items():
                own = column.take(pa.array(at))
                there = own.drop_null()
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                rows, n, mean, m2, most = sums.get(key, (0, None, None, None, None))
                if len(there):
                    flat = there.flatten()
                    null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(there), -1)
                    x = np.where(null, 0.0, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1))
                    k = (~null).sum(0).astype(float)
                    m = x.sum(0) / np.maximum(k, 1)
                    d, high = (np.where(null, 0.0, x - m) ** 2).sum(0), np.where(null, -np.inf, x).max(0)
                    if n is None:
                        n, mean, m2, most = k, m, d, high
                        held += 4 * len(n)
                    else:
                        total = np.maximum(n + k, 1)
                        m2 = m2 + d + (m - mean) ** 2 * n * k / total
                        mean, n, most = (mean * n + m * k) / total, n + k, np.maximum(most, high)
                sums[key] = rows + len(at), n, mean, m2, most
                if held > HELD:
                    yield from sent(sums)
                    sums, held = {k: v for k, v in sums.items() if v[1] is None}, 0  # rows without a vector wait for one
        yield from sent(sums)

    def sent(sums: dict) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % LANES
        out = [(*key, lane, at, rows, n[at : at + SLICE], (mean * n)[at : at + SLICE], (m2 + mean * mean * n)[at : at + SLICE], most[at : at + SLICE]) for key, (rows, n, mean, m2, most) in sums.items() if n is not None for at in range(0, len(n), SLICE)]
        yield from pa.Table.from_pandas(pd.DataFrame(out, columns=[*keys, "lane", "at", "rows", "n", "s", "q", "h"]), schema=arrow, preserve_index=False).to_batches() if out else ()

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    total = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.col(c)[0], lambda x, y: F.zip_with(x, y, lambda a, b: F.greatest(a, b) if c == "h" else a + b)).alias(c)

    def added(parts: DataFrame, by: list[str]) -> DataFrame:
        got = parts.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.collect_list(c).alias(c) for c in "nsqh"])
        return got.select(*by, "rows", *[total(c) for c in "nsqh"])

    parts = added(added(df.select(*keys, vector).mapInArrow(add, schema), [*keys, "lane", "at"]).drop("lane"), [*keys, "at"])
    mean = F.zip_with("s", "n", lambda s, n: F.when(n > 0, s / n))
    spread = F.zip_with(F.zip_with("q", "n", lambda q, n: F.when(n > 0, q / n)), "mean", lambda q, m: F.sqrt(F.greatest(q - m * m, F.lit(0.0))))
    high = F.zip_with("h", "n", lambda h, n: F.when(n > 0, h))
    each = parts.withColumn("mean", mean).withColumn("std", spread).withColumn("most", high)
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "mean", "std", "most", "rows"))).alias("r"))  # one entry for each slice
    return whole.select(*keys, F.flatten("r.mean").alias("mean"), F.flatten("r.std").alias("std"), F.flatten("r.most").alias("most"), F.col("r")[0]["rows"].alias("n"))


def vector_mean(df: DataFrame, keys: list[str], vector: str, dim: int, into: str = "mean") -> DataFrame:
    """The mean vector of each group, one aggregate for each dimension: no exploded rows to shuffle; of WIDE dimensions or more by batches."""
    if dim >= WIDE:
        return wide_stats(df, keys, vector).select(*keys, F.col("mean").alias(into))
    parts = [F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]
    return df.groupBy(*keys).agg(F.array(*parts).alias(into))


def vector_stats(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """Mean and population deviation of each dimension in each group; of WIDE dimensions or more by batches."""
    if dim >= WIDE:
        return wide_stats(df, keys, vector).drop("most")
    at = [F.col(vector)[i].cast("double") for i in range(dim)]
    return df.groupBy(*keys).agg(F.array(*[F.avg(x) for x in at]).alias("mean"), F.array(*[F.stddev_pop(x) for x in at]).alias("std"), F.count("*").alias("n"))


def zscore_l2(df: DataFrame, keys: list[str], vector: str, dim: int, into: str = "z") -> DataFrame:
    """Each dimension less its group's mean over its deviation (plus 1e-8), then length 1; a zero vector stays zero."""
    stats = vector_stats(df, keys, vector, dim).select(*keys, "mean", "std")
    moved = F.zip_with(V.minus(vector, "mean"), "std", lambda x, s: x / (s + 1e-8))
    return df.join(stats, keys).withColumn(into, V.l2_guarded(moved)).drop("mean", "std")


def mean_max_pool(df: DataFrame, keys: list[str], vector: str, dim: int, into: str = "pooled") -> DataFrame:
    """Half the sum of mean and maximum of each dimension, over its length plus 1e-8."""
    if dim >= WIDE:
        half = F.zip_with("mean", "most", lambda m, h: (m + h) / 2)
        return wide_stats(df, keys, vector).select(*keys, V.l2_added(half).alias(into))
    at = [F.col(vector)[i].cast("double") for i in range(dim)]
    pooled = df.groupBy(*keys).agg(F.array(*[(F.avg(x) + F.max(x)) / 2 for x in at]).alias(into))
    return pooled.withColumn(into, V.l2_added(into))


def mean_pool(df: DataFrame, keys: list[str], vector: str, dim: int, into: str = "pooled") -> DataFrame:
    return vector_mean(df, keys, vector, dim, into).withColumn(into, V.l2_added(into))


LANES = 64  # of partitions' sums that are added up apart first


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    sums = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q2", "q4")], F.collect_list("g").alias("g"))
    total = F.aggregate(F.slice("g", 2, F.size("g")), F.col("g")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return sums.withColumn("g", total)


def moment_rows(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, n, s, g, q2, q4), one row for each group and dimension i: count, entry i of the sum of vectors, row i of the sum of outer products,
    sums of squared and fourth-power lengths. Each partition sums its own groups first; then the rows are added up apart from each
    other, and by LANES of partitions before all, so no task gathers a matrix from every partition."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", lane int, i int, n long, s double, g array<double>, q2 double, q4 double"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, own in batch.groupby(keys, dropna=False, sort=False):
                x = np.array(own[vector].tolist(), float)
                q = (x * x).sum(axis=1)
                new = (len(x), x.sum(axis=0), x.T @ x, q.sum(), (q * q).sum())
                sums[key] = tuple(a + b for a, b in zip(sums[key], new)) if key in sums else new
        lane = TaskContext.get().partitionId() % LANES
        for k, (n, s, g, q2, q4) in sums.items():
            own = {c: pd.Series([None if pd.isna(v) else v] * len(s), dtype=object) for c, v in zip(keys, k)}
            yield pd.DataFrame(own | {"lane": lane, "i": range(len(s)), "n": n, "s": s, "g": list(g), "q2": q2, "q4": q4})

    return _added(_added(df.select(*keys, vector).mapInPandas(add, schema), [*keys, "lane", "i"]).drop("lane"), [*keys, "i"])


def moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, s, g, q2, q4): the rows of each group together, g flat."""
    parts = moment_rows(df, keys, vector)
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "n", "s", "g", "q2", "q4"))).alias("r"))  # one entry for each dimension
    first = F.col("r")[0]
    return whole.select(*keys, first["n"].alias("n"), F.col("r.s").alias("s"), F.flatten("r.g").alias("g"), first["q2"].alias("q2"), first["q4"].alias("q4"))


def with_totals(rows: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Moment rows of [*by, label] with n_all, s_all and g_all, the sums over all labels but null of their group of `by`; rows without a label get none.
    Labels are added up by LANES first, dimension by dimension. What is across labels is the total less a label's own, so no two labels are joined."""
    lanes = _added(rows.where(F.col(label).isNotNull()).withColumn("lane", F.pmod(F.xxhash64(label), F.lit(LANES))), [*by, "lane", "i"])
    total = _added(lanes, [*by, "i"]).select(*[F.col(k).alias(f"{k}_all") for k in [*by, "i", "n", "s", "g"]])
    cond = F.col(label).isNotNull()
    for k in [*by, "i"]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_all"))
    return rows.join(total, cond, "left").drop(*[f"{k}_all" for k in [*by, "i"]])


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means and deviations from sums of pairs: none gives zeros."""
    for side in ("in", "out"):
        n, a, b = F.col(f"n_{side}"), F.col(f"a_{side}"), F.col(f"b_{side}")
        mean = F.when(n > 0, a / n).otherwise(0.0)
        df = df.withColumn(f"mu_{side}", mean).withColumn(f"sigma_{side}", F.when(n > 0, F.sqrt(F.greatest(b / n - mean * mean, F.lit(0.0)))).otherwise(0.0))
    return df.select(*keys, "mu_in", "mu_out", "sigma_in", "sigma_out", F.col("n_in").cast("long").alias("count_in"), F.col("n_out").cast("long").alias("count_out"))


def pair_stats(df: DataFrame, label: str, vector: str, by: list[str] = (), scope: str = "global") -> DataFrame:
    """Mean, population deviation and count of the products of all pairs of unit vectors within a label and across labels, for each
    group of `by`. scope "global": all labels together (pairs within count in both orders, pairs across once). scope
    "domain": for each label its own pairs and those with any other label."""
    by = list(by)
    rows = with_totals(moment_rows(df, [*by, label], vector), label, by)
    n, once = F.col("n").cast("double"), lambda x: F.when(F.col("i") == 0, x)  # n, q2 and q4 stand in the row of each dimension
    half = 0.5 if scope == "global" else 1.0  # the labels' sums count each pair across from both sides
    sums = {
        "n_in": once(n * (n - 1)), "a_in": F.col("s") ** 2 - F.coalesce(once(F.col("q2")), F.lit(0.0)), "b_in": V.dot("g", "g") - F.coalesce(once(F.col("q4")), F.lit(0.0)),
        "n_out": half * once(n * (F.col("n_all") - n)), "a_out": half * F.col("s") * (F.col("s_all") - F.col("s")), "b_out": half * V.dot("g", V.minus("g_all", "g")),
    }
    keys = by if scope == "global" else [*by, "label"]
    found = rows.withColumnRenamed(label, "label").groupBy(*keys).agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    return _finish(found.fillna(0.0, list(sums)), keys)


def mean_matrix(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(domain_i, domain_j, mean_sim) for all labels: the diagonal leaves each vector's product with itself out; a label of one row has 0 there."""
    m = moments(df, [label], vector)
    one, two = m.alias("one"), m.alias("two")
    i, j = F.col(f"one.{label}"), F.col(f"two.{label}")
    n = F.col("one.n").cast("double")
    own = F.when(n > 1, (V.dot("one.s", "one.s") - F.col("one.q2")) / (n * (n - 1))).otherwise(0.0)
    return one.join(two, F.lit(True)).select(i.alias("domain_i"), j.alias("domain_j"), F.when(i == j, own).otherwise(V.dot("one.s", "two.s") / (n * F.col("two.n"))).alias("mean_sim"))


def softmax(x, over) -> "F.Column":
    e = F.exp(x - F.max(x).over(over))
    return e / F.sum(e).over(over)


def dynamic_weights(stats: DataFrame, scope: list[str] = (), margin: float = 0.05, tau: float = 1.5, eps: float = 1e-6) -> DataFrame:
    """J = mu_in - mu_out, sigma, S = max(J - margin, 0) / (sigma + eps) and W, the softmax of S / tau over the sections of each scope."""
    over = Window.partitionBy(*[F.col(c) for c in scope]) if scope else Window.partitionBy(F.lit(0))
    out = stats.withColumn("J", F.col("mu_in") - F.col("mu_out")).withColumn("sigma", F.sqrt(F.col("sigma_in") ** 2 + F.col("sigma_out") ** 2))
    out = out.withColumn("S", F.greatest(F.col("J") - margin, F.lit(0.0)) / (F.col("sigma") + eps))
    return out.withColumn("W", softmax(F.col("S") / tau, over))


def weights_from_scores(scores: DataFrame, scope: list[str] = (), **parameters) -> DataFrame:
    """The same from rows (scope, section, inside, score)."""
    inside = lambda f, b: F.coalesce(f(F.when(F.col("inside") == b, F.col("score"))), F.lit(0.0))
    stats = scores.groupBy(*scope, "section").agg(
        inside(F.avg, True).alias("mu_in"), inside(F.avg, False).alias("mu_out"), inside(F.stddev_pop, True).alias("sigma_in"), inside(F.stddev_pop, False).alias("sigma_out")
    )
    return dynamic_weights(stats, list(scope), **parameters)


def prototype_weights(df: DataFrame, field: str, section: str, vector: str, dim: int, floor: float = 1e-6) -> DataFrame:
    """For each field and section that aren't null: cosines of all the section's vectors with the field's mean, inside the field and outside it, by the field's
    moments and by the totals less these, so no vector meets a mean and no field another one; the ratio of their difference to their spread, and its softmax over a field's sections."""
    protos = vector_mean(df, [field, section], vector, dim, "mean").select(F.col(field).alias("target"), section, V.l2_or_zero("mean").alias("p"))
    rows = moment_rows(df.select(field, section, V.l2_or_zero(vector).alias("unit")), [field, section], "unit")
    own = (F.col(field) == F.col("target")) & (F.col("own_section") == F.col(section))
    rows = protos.withColumnRenamed(section, "own_section").join(with_totals(rows, field, [section]), own).drop(field, section).withColumnRenamed("own_section", section)
    n, at, once = F.col("n"), F.col("p")[F.col("i")], lambda x: F.when(F.col("i") == 0, x)
    sums = {  # of squared cosines: p G p, row by row of G
        "n_in": once(n), "a_in": at * F.col("s"), "b_in": at * V.dot("g", "p"),
        "n_out": once(F.col("n_all") - n), "a_out": at * (F.col("s_all") - F.col("s")), "b_out": at * V.dot(V.minus("g_all", "g"), "p"),
    }
    out = rows.groupBy("target", section).agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    for side in ("in", "out"):
        n, mean = F.greatest(F.col(f"n_{side}"), F.lit(1)), F.col(f"mu_{side}")
        out = out.withColumn(f"mu_{side}", F.col(f"a_{side}") / n)
        out = out.withColumn(f"sigma_{side}", F.sqrt(F.greatest(F.col(f"b_{side}") / n - mean * mean, F.lit(0.0))))
    out = out.select("target", section, "mu_in", "mu_out", "sigma_in", "sigma_out")
    spread = F.greatest(F.sqrt(F.col("sigma_in") ** 2 + F.col("sigma_out") ** 2), F.lit(floor))
    out = out.withColumn("snr", (F.col("mu_in") - F.col("mu_out")) / spread)
    return out.withColumn("weight", softmax(F.col("snr"), Window.partitionBy("target")))


def best_mode(stats: DataFrame, modes: list[str], forced: dict[str, str] | None = None) -> DataFrame:
    """One row for each section of (section, mode, separation): the greatest separation, the mode that comes first of equal ones; or the forced mode."""
    rank = F.coalesce(*[F.when(F.col("mode") == m, i) for i, m in enumerate(modes)], F.lit(len(modes)))
    want = F.coalesce(*[F.when(F.col("section") == s, F.lit(m)) for s, m in (forced or {}).items()], F.lit(None).cast("string"))
    first = F.row_number().over(Window.partitionBy("section").orderBy(F.desc(F.col("mode").eqNullSafe(want)), F.desc("separation"), rank))
    return stats.withColumn("nth", first).where("nth = 1").drop("nth")


def align(sections: dict[str, DataFrame], domains: list, unknown: int = 999) -> DataFrame:
    """Inner join of the sections' (label, doc_id, vector) on their keys, with the rank of the label in `domains`."""
    out = None
    for name, df in sections.items():
        own = df.select("label", "doc_id", F.col("vector").alias(f"v_{name}"))
        out = own if out is None else out.join(own, ["label", "doc_id"])
    rank = F.coalesce(*[F.when(F.col("label") == d, i) for i, d in enumerate(domains)], F.lit(unknown))
    return out.withColumn("domain_rank", rank)


def _one_of(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    """One row of each key, combined before the shuffle, so that no task sorts a common key's rows."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(order)).alias("one"))
    return found.select(*[F.col(f"one.{c}") if c in rest else F.col(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order."""
    return _one_of(df, keys, order, F.max_by)


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one_of(df, keys, order, F.min_by)


def remove_components(df: DataFrame, vector: str, k: int = 2, into: str = "vector_out") -> DataFrame:
    """Vectors without their parts along the k leading right singular directions, of length 1 again. The directions come from the
    D x D sum of outer products, so only that leaves the executors."""
    total = moments(df.withColumn("_all", F.lit(0)), ["_all"], vector).first()
    if total is None:
        return df.withColumn(into, V.doubles(vector))
    g = np.array(total["g"]).reshape(len(total["s"]), -1)
    top = np.linalg.eigh(g)[1][:, ::-1][:, :k]
    project = top @ top.T

    @F.pandas_udf("array<double>")
    def rest(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float)
        x = x - x @ project
        return pd.Series(list(x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)))

    return df.withColumn(into, rest(V.doubles(vector)))
