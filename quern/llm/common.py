"""What several of the operators share: tables, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import shared_folder

#: While a cut is written: its shuffle files go when it ends, as nothing reads them afterwards; and Python gets whole texts in smaller batches.
WHILE_CUTTING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
_made: list[tuple[SparkSession, str]] = []
_held: ContextVar[tuple[list, ...]] = ContextVar("held", default=())  # of the scratches that are open, the innermost last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: its lineage ends there,
    so a lost executor costs no recomputation of what went before. The files go when the scratch they
    were written in ends, with keep the one around that, else when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k, None) for k in WHILE_CUTTING}
    for k, v in WHILE_CUTTING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = _held.get()
    (held[: len(held) - keep] or (_made,))[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """What is cut within, and not kept, is removed at the end: nothing that is read later may depend on it."""
    own: list[tuple[SparkSession, str]] = []
    token = _held.set((*_held.get(), own))
    try:
        yield
    finally:
        _held.reset(token)
        _remove(own)


def _remove(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_remove, _made)


def apart(docs: DataFrame) -> DataFrame:
    """(row, doc_id, nth) of all rows of docs: row has all its columns, whatever their names. Rows of one doc_id with different texts differ in nth:
    0 where a doc_id has one text only, however often, else a hash of the text. (doc_id, nth) so stands for one text."""
    own = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"))
    hashed, zero = F.xxhash64(F.col("row.text").cast("string")), F.lit(0).cast("long")
    often = cut(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("doubled")))
    if not often.head(1):
        return own.select("row", "doc_id", zero.alias("nth"))
    texts = own.join(often, own["doc_id"] == often["doubled"], "left_semi").where("row.text IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high"))
    doubled = cut(texts.where("low <> high").select(F.col("doc_id").alias("doubled")))
    nth = F.when(F.col("doubled").isNotNull(), hashed).otherwise(zero)
    return own.join(doubled, own["doc_id"] == doubled["doubled"], "left").select("row", "doc_id", nth.alias("nth"))


def texts_of(own: DataFrame) -> DataFrame:
    """(doc_id, nth, text) of the rows told apart that have a doc_id and a text."""
    return own.where("doc_id IS NOT NULL AND row.text IS NOT NULL").select("doc_id", "nth", F.col("row.text").cast("string").alias("text"))


def replaced(joined: DataFrame, docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """The columns of docs from the rows in joined, with another text, and its length in n_chars if there, where `changed`."""
    new = {"text": F.when(changed, text).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A node of more edges is a hub. Hubs are broadcast with their least neighbours: HUBS at most, whatever the number of edges, as the bound rises with it.
HUB, HUBS = 256, 100_000


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v), about n of them, with m, the least v of each u. The edges of a hub stay where they are, so they don't meet in one task."""
    bound = max(HUB, n // HUBS)
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hubs = least.where(F.col("n") > bound).select("u", "m")
    if not hubs.head(1):
        return edges.join(least.select("u", "m"), "u")
    few = edges.join(F.broadcast(hubs), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(few)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star
    steps. Returns (node, component) for every node that has an edge to another one;
    component is the smallest node reachable.

    Each step is a grouped minimum, combined before the shuffle, and a join in which hubs
    are apart. Rounds end when the edges no longer change; their number grows with the
    logarithm of a component's length.
    """
    e = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with scratch():
            large = cut(with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
            small = (
                with_least(large, before[0])
                .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                .select("x.u", "x.v").where("u > v").distinct()
            )
            e = cut(small, keep=True)
        after = digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
