"""Whitening of embedding vectors by their principal components.

The covariance comes from one SQL aggregation with a sum of centred products for each pair of
dimensions in the upper triangle; the driver assembles the matrix (dimension squared, whatever the
number of rows) and LAPACK decomposes it. Vectors are scaled to whole numbers, so sums and means
are exact, and products are taken of centred values only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Pairs in one aggregation; a triangle of more is summed by several, each over the columns that it needs.
PAIRS = 4096
#: Of the trace: a component of less variance has no direction to scale.
LEAST = 1e-13


def scaled(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<long>) with x = floor(scale * entry) + shift, of the vectors that take part: not null, without null or non-finite entries or
    ones beyond 2^62 / scale, and of the length that most of these have (of equally frequent ones the shorter)."""
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(2**62 // scale)))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(ok, F.lit(False))).select("vec_id", x.alias("x"))
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)
    return own.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def pair_sums(df: DataFrame, columns: list[str], most: int = PAIRS) -> np.ndarray:
    """The sums of products of columns that are centred already, as a symmetric matrix: one SQL expression for each pair of the upper triangle."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = np.zeros((len(columns),) * 2)
    for at in range(0, len(pairs), most):
        own = pairs[at : at + most]
        row = df.selectExpr(*[f"sum({columns[i]} * {columns[j]})" for i, j in own]).first()
        for (i, j), v in zip(own, row):
            out[i, j] = out[j, i] = v or 0.0
    return out


def _largest(x: DataFrame, d: int) -> int:
    return max(x.selectExpr(*[f"max(abs(x{i}))" for i in range(d)]).first())


def fit(own: DataFrame, d: int, most: int = PAIRS) -> dict:
    """n, exact sums, eigenvalues and unit eigenvectors (columns, by falling eigenvalue) of the covariance of x over all rows."""
    x = own.selectExpr(*[f"x[{i}] AS x{i}" for i in range(d)])
    first = x.selectExpr("count(*)", *[f"cast(sum(cast(x{i} AS decimal(38,0))) AS string)" for i in range(d)]).first()
    n, sums = first[0], [int(s) for s in first[1:]]
    # Not nullable, so that each sum is one addition. Products of n beyond 64 bits are taken in decimals.
    kind = "bigint" if n * 2**21 < 2**62 and max(map(abs, sums)) < 2**61 and _largest(x, d) * n < 2**62 else "decimal(38,0)"
    centred = x.selectExpr(*[f"coalesce(cast(cast({n} AS {kind}) * cast(x{i} AS {kind}) - cast({s} AS {kind}) AS double) / {n}D, 0D) AS c{i}" for i, s in enumerate(sums)])
    cov = pair_sums(centred, [f"c{i}" for i in range(d)], most) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    return {"n": n, "sums": sums, "cov": cov, "values": values[order], "vectors": vectors[:, order]}


def project(own: DataFrame, model: dict, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened array<double>): each row's squared distance from the mean in units of 1 / n, exact, and its centred x on the
    components over the roots of their eigenvalues."""
    n, sums, d = model["n"], np.array(model["sums"], object), len(model["sums"])
    keep = [k for k in range(min(components, d)) if model["values"][k] > LEAST * max(model["cov"].trace(), 1e-300)]
    basis = model["vectors"][:, keep] / np.sqrt(model["values"][keep])
    wide = max(n, 1) * 2**20 > 2**62 or max(map(abs, model["sums"]), default=0) > 2**61  # then whole numbers don't fit 64 bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            small = not wide and (not x.size or int(np.abs(x).max()) < 2**62 // n)
            dev = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
            w = dev.astype(float) / n @ basis
            if small and (not dev.size or float(np.abs(dev).max()) ** 2 * d < 2.0**62):
                total = (dev * dev).sum(1).tolist()
            else:
                total = (dev.astype(object) ** 2).sum(1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(keep)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(t) for t in total]), flat], names=["vec_id", "deviation", "whitened"])

    return own.select("vec_id", "x").mapInArrow(rows, "vec_id long, deviation string, whitened array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, most: int = PAIRS) -> DataFrame:
    """(vec_id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error) of the vectors (vec_id, embedding)
    that take part (see scaled), one row for each, repeated ids and rows too; other columns don't matter. explained holds each component's share
    of the variance. identity_error is measured on the rows returned: the largest entry of their covariance less the identity.

    Components without variance (constant dimensions, fewer rows than dimensions) have no scale and are left out, so arrays may be shorter
    than `components`, or empty where all rows agree; then identity_error is 0. Eigenvalues that tie leave any basis of their space. An empty
    table, or one without usable vectors, gives an empty result.
    """
    own = cut(scaled(vectors))
    head = own.head(1)
    if not head:
        return own.selectExpr("vec_id", "0L AS n", "cast(0 AS decimal(38,0)) AS deviation", "cast(array() AS array<double>) AS whitened", "cast(array() AS array<double>) AS explained", "0D AS identity_error")
    model = fit(own, len(head[0]["x"]), most)
    done = cut(project(own, model, components))
    k = len(done.head(1)[0]["whitened"])
    error = 0.0
    if k:
        names = [f"w{i}" for i in range(k)]
        means = done.selectExpr(*[f"avg(whitened[{i}])" for i in range(k)]).first()
        centred = done.selectExpr(*[f"coalesce(whitened[{i}] - {float(m)!r}D, 0D) AS {w}" for i, (w, m) in enumerate(zip(names, means))])
        error = float(np.abs(pair_sums(centred, names, most) / model["n"] - np.eye(k)).max())
    explained = [float(v) for v in model["values"][:k] / max(model["cov"].trace(), 1e-300)]
    return done.select("vec_id", F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "v")
    return own.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error"
    )
