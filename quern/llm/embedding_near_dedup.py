"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a label by the concatenated signs of random projections and compares each
vector with a bounded window of those that precede it; verified pairs of all passes are united. What is sorted is a code of
one byte a component with a bound of its error: most pairs are decided on it, and the few within the error are
verified on the vectors themselves. The number of passes grows with the vectors, so that pairs are found as surely among many.

A window can be shorter than a dense group, so links are then counted exactly within each component: its members are dealt
into balls of bounded size; two balls so near that all of their members link, or so far that none do, are settled by
centres and radii, and only the members of others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, partitions, scratch, table

SIMILARITY = 0.93
PASSES, BITS, WINDOW = 16, 60, 48
#: PASSES are enough for so many vectors of a label; for n times as many there are n ** GROWTH times as many (README: measured recall).
ENOUGH, GROWTH = 100_000, 0.27
ROWS = 16_384  # compared at once, with their windows
MEMBERS = 2048  # members of a ball


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1, in doubles; scaled first, so that no square overflows."""
    x = np.array(vectors.tolist(), float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def local_stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 linked by (i, j): the smallest row of each one's component."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def planes(dim: int, nth: int) -> np.ndarray:
    return np.random.default_rng([nth, dim]).standard_normal((dim, BITS))


def keys(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The signs of projections, the first one the highest bit."""
    return (v @ p > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (bytes, scale, error): scale * bytes differs from a vector by a length of error at most."""
    scale = (np.abs(v).max(axis=1) / 127).astype(np.float32)
    code = np.rint(v / scale[:, None]).astype(np.int8)
    error = np.sqrt(((v - code * scale[:, None].astype(float)) ** 2).sum(axis=1)) * (1 + 1e-6) + 1e-6
    return code, scale, error.astype(np.float32)


def projected(reps: DataFrame, passes: int) -> DataFrame:
    """(rep, label, dim, pass, key, code, scale, error) of each vector in each pass."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for x in batches:
            for dim, own in x.groupby(x["embedding"].str.len()):
                v = unit(own["embedding"])
                code, scale, error = coded(v)
                row = {"rep": own["rep"].to_numpy(), "label": own["label"].to_numpy(), "dim": int(dim), "code": [c.tobytes() for c in code], "scale": scale, "error": error}
                for nth in range(passes):
                    if (dim, nth) not in known and len(known) < 1024:
                        known[dim, nth] = planes(int(dim), nth)
                    p = known.get((dim, nth))
                    yield pd.DataFrame({**row, "pass": nth, "key": keys(v, planes(int(dim), nth) if p is None else p)})

    return reps.select("rep", "label", "embedding").mapInPandas(project, "rep long, label long, dim int, pass int, key long, code binary, scale float, error float")


def compared(x: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of rows in order, each with those in its window: pairs that link for sure, as stars, and pairs that may link on what the codes tell."""
    i, j, sure = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
    by = x[["pass", "label", "dim"]].to_numpy()
    bounds = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]).any(axis=1), True])
    for begin, end in zip(bounds, bounds[1:]):
        code = np.frombuffer(b"".join(x["code"].iloc[begin:end]), np.int8).reshape(end - begin, -1).astype(np.float32)
        v = code * x["scale"].to_numpy()[begin:end, None]
        e = x["error"].to_numpy()[begin:end].astype(float)
        for at in range(0, len(v), 4 * WINDOW):
            a, b = slice(at, at + 4 * WINDOW), slice(max(0, at - WINDOW), at + 4 * WINDOW)
            p, q = np.arange(len(v))[a], np.arange(len(v))[b]
            about = v[a] @ v[b].T
            slack = (1 + e[a])[:, None] * (1 + e[b])[None, :] - 1 + 1e-5  # lengths of codes are 1 + error at most; products of floats
            near = (about + slack >= similarity) & (q[None, :] < p[:, None]) & (q[None, :] >= p[:, None] - WINDOW)
            r, s = np.nonzero(near)
            i.append(begin + p[r])
            j.append(begin + q[s])
            sure.append(about[r, s] - slack[r, s] >= similarity)
    i, j, sure = np.concatenate(i), np.concatenate(j), np.concatenate(sure)
    low = local_stars(len(x), i[sure], j[sure])
    star, open_ = np.flatnonzero(low != np.arange(len(x))), ~sure & (low[i] != low[j])
    return np.r_[star, i[open_]], np.r_[low[star], j[open_]], np.r_[np.ones(len(star), bool), np.zeros(open_.sum(), bool)]


FOUND = "a long, b long, sure boolean, edge int, side int, nth int, label long, dim int, pass int, code binary, scale float, error float"


def candidates(reps: DataFrame, passes: int, similarity: float) -> DataFrame:
    """(a, b): links found in the windows; those that connect what others connect for sure in the same window may be left out."""
    n = partitions(reps.sparkSession)
    by = ["pass", "label", "dim", "key", "rep"]
    carried = ["rep", "label", "dim", "pass", "code", "scale", "error"]

    def pairs(x: pd.DataFrame, fresh: int = 0) -> pd.DataFrame:
        i, j, sure = compared(x, similarity)
        rep, new = x["rep"].to_numpy(), (i >= fresh) | (j >= fresh)
        return pd.DataFrame({"a": rep[i[new]], "b": rep[j[new]], "sure": sure[new]}).drop_duplicates()

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, before, head = TaskContext.get().partitionId(), [], None, None

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal before, head
            x = pd.concat(held if before is None else [before, *held], ignore_index=True)
            yield pairs(x, 0 if before is None else len(before)).reindex(columns=columns)
            head = x.iloc[:WINDOW] if before is None else head
            before = x.iloc[-WINDOW:]
            held.clear()

        for x in batches:
            held.append(x)
            if sum(map(len, held)) >= ROWS:
                yield from flush()
        if held:
            yield from flush()
        if before is not None:  # the rows at both ends, for the partitions beside this one
            for edge, side, rows in ((part, 1, head), (part + 1, 0, before)):
                yield rows.assign(a=rows["rep"], edge=edge, side=side, nth=np.arange(len(rows))).reindex(columns=columns)

    columns = [c.split()[0] for c in FOUND.split(", ")]
    ordered = projected(reps, passes).repartitionByRange(n, *by).sortWithinPartitions(*by).select(*carried)
    found = cut(ordered.mapInPandas(windows, FOUND))

    def across(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["side", "nth"], ignore_index=True).rename(columns={"a": "rep"})
        return pairs(x)

    ends = found.where("edge IS NOT NULL").drop("b", "sure").groupBy("edge").applyInPandas(across, "a long, b long, sure boolean")
    links = cut(found.where("edge IS NULL").select("a", "b", "sure").unionByName(ends).groupBy("a", "b").agg(F.max("sure").alias("sure")))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", unit(x), unit(y)) >= similarity) if len(x) else pd.Series([], dtype=bool)

    doubt = links.where("NOT sure").select("a", "b")
    of = lambda c, v: reps.select(F.col("rep").alias(c), F.col("embedding").alias(v))
    return links.where("sure").select("a", "b").union(doubt.join(of("a", "x"), "a").join(of("b", "y"), "b").where(alike("x", "y")).select("a", "b"))


def balls(members: DataFrame) -> DataFrame:
    """members (component, rep, copies, embedding) with cell and salt: the ball they are dealt into, by the first projections if a component has more than MEMBERS."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    bits = F.when(F.col("n") > MEMBERS, F.least(F.ceil(F.log2(F.col("n") / MEMBERS)) + 2, F.lit(30))).otherwise(0).cast("int")

    @F.pandas_udf("long")
    def cell(embedding: pd.Series, bits: pd.Series) -> pd.Series:
        out = np.zeros(len(embedding), np.int64)
        for dim, at in embedding.reset_index(drop=True).groupby(embedding.str.len().to_numpy()).indices.items():
            some = at[bits.to_numpy()[at] > 0]
            if len(some):
                out[some] = keys(unit(embedding.iloc[some]), planes(int(dim), 0)) >> (BITS - bits.to_numpy()[some])
        return pd.Series(out)

    own = members.join(sizes.select("component", bits.alias("bits")), "component").withColumn("cell", cell("embedding", "bits"))
    own = cut(own.select("component", "rep", "copies", "embedding", "cell"))
    salts = own.groupBy("component", "cell").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    return own.join(salts, ["component", "cell"]).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int")).drop("salts")


def counts(members: DataFrame, similarity: float) -> DataFrame:
    """(rep, others): the copies of all other vectors of its component within the similarity; members: component, rep, copies, embedding."""
    own = cut(balls(members))
    angle = float(np.arccos(similarity))
    ball = ["component", "cell", "salt"]

    def round_(x: pd.DataFrame) -> pd.DataFrame:
        v = unit(x["embedding"])
        center = v.sum(axis=0)
        size = np.sqrt(center @ center)
        center = center / size if size > 1e-9 else v[0]
        radius = float(np.arccos(np.clip(v @ center, -1, 1)).max())
        return pd.DataFrame({**{c: x[c].iloc[:1] for c in ball}, "center": [center.tolist()], "radius": [radius], "total": [int(x["copies"].sum())]})

    rounds = cut(own.groupBy(*ball).applyInPandas(round_, "component long, cell long, salt int, center array<double>, radius double, total long"))
    one, two = rounds.alias("one"), rounds.alias("two")
    id_ = lambda side: F.struct(F.col(f"{side}.cell"), F.col(f"{side}.salt"))
    both = one.join(two, (F.col("one.component") == F.col("two.component")) & (id_("one") <= id_("two")))
    product = F.aggregate(F.zip_with("one.center", "two.center", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product)))
    reach = F.col("one.radius") + F.col("two.radius")
    same = id_("one") == id_("two")
    side = lambda s, n: [F.col(f"{s}.cell").alias(f"cell{n}"), F.col(f"{s}.salt").alias(f"salt{n}"), F.col(f"{s}.total").alias(f"total{n}")]
    judged = both.select(F.col("one.component"), *side("one", 1), *side("two", 2), same.alias("same"), F.when(F.when(same, 2 * F.col("one.radius")).otherwise(apart + reach) <= angle - 1e-6, "all")
                         .when(~same & (apart - reach > angle + 1e-6), "none").otherwise("some").alias("which"))
    judged = cut(judged.where("which <> 'none'"))
    full = judged.where("which = 'all'")
    seen = full.select("component", F.col("cell1").alias("cell"), F.col("salt1").alias("salt"), F.col("total2").alias("n")).unionByName(
        full.where("NOT same").select("component", F.col("cell2").alias("cell"), F.col("salt2").alias("salt"), F.col("total1").alias("n"))
    )
    inside = full.where("same").select("component", F.col("cell1").alias("cell"), F.col("salt1").alias("salt"), F.lit(1).alias("self"))
    whole = seen.groupBy(*ball).agg(F.sum("n").alias("n")).join(inside, ball, "left")
    settled = own.select("rep", "copies", *ball).join(whole, ball).select("rep", (F.col("n") - F.when(F.col("self") == 1, F.col("copies")).otherwise(0)).alias("others"))

    def count(x: pd.DataFrame) -> pd.DataFrame:
        v, copies, side = unit(x["embedding"]), x["copies"].to_numpy(), x["side"].to_numpy()
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        alone = not len(two)
        two = one if alone else two
        linked = np.zeros(len(x), np.int64)
        for at in range(0, len(one), 256):
            own = one[at : at + 256]
            hit = v[own] @ v[two].T >= similarity
            hit &= own[:, None] != two[None, :]
            linked[own] += hit @ copies[two]
            if not alone:
                linked[two] += copies[own] @ hit
        return pd.DataFrame({"rep": x["rep"], "others": linked})

    some = judged.where("which = 'some'").withColumn("pair", F.struct("component", "cell1", "salt1", "cell2", "salt2"))
    first = some.select("component", F.col("cell1").alias("cell"), F.col("salt1").alias("salt"), "pair", F.lit(1).alias("side"))
    second = some.where("NOT same").select("component", F.col("cell2").alias("cell"), F.col("salt2").alias("salt"), "pair", F.lit(2).alias("side"))
    meeting = own.join(first.unionByName(second), ball).select("pair", "side", "rep", "copies", "embedding")
    compared_ = meeting.groupBy("pair").applyInPandas(count, "rep long, others long")
    return settled.unionByName(compared_).groupBy("rep").agg(F.sum("others").alias("others"))


def passes_for(n: int) -> int:
    """Passes for n vectors of one label."""
    return max(PASSES, int(np.ceil(PASSES * (n / ENOUGH) ** GROWTH)))


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, passes: int | None = None) -> DataFrame:
    """One row for each different row of vectors (vec_id, embedding, label): vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable) and kept (vec_id = component_id).

    Vectors of equal label and dimension link at this cosine or more. Null labels, null, empty or zero
    vectors and those with null or non-finite components link with nothing: no links, their own component, kept.
    Copies of a vector are one node with a count, and linked to each other. A repeated row counts once;
    a row without a vec_id links with nothing and isn't kept. An empty table gives an empty result. Other columns don't matter.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label")).distinct())
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    reps = cut(rows.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    if passes is None:
        passes = passes_for(reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    with scratch():
        found = components(cut(candidates(reps, passes, similarity)))
        members = cut(found.withColumnRenamed("node", "rep").join(reps, "rep").select("component", "rep", "copies", "embedding"))
        known = (
            reps.join(members.select("rep", "component"), "rep", "left").join(counts(members, similarity), "rep", "left")
            .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        )
        known = cut(known, keep=True)
    linked = rows.where(fine).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
