"""Exact top-k by inner product over an M-tree.

The tree's upper level is spread over the cluster: up to PIVOTS candidates are pivots, each candidate goes to the pivot nearest to
it, and a small table holds each pivot's covering radius. Below it a task builds an M-tree (pages of entries,
each with its distance to the page's pivot, and for inner pages a covering radius) over a bounded block of a pivot's candidates. A
query is first searched below its home, the pivot of the greatest product; its k-th score there is a floor, and it goes on to
those other pivots only that can still reach it. For a query q and an entry with pivot p, radius r and parent pivot o, the
Cauchy-Schwarz and triangle inequalities give

    q.x <= q.p + |q| r <= q.o + |q| (d(p, o) + r)      for every x below p,

so the second bound, which needs no product with p, already drops most entries of a page that can't reach the k-th score. Queries
go through a tree in groups: bounds and floors are each query's own, what is left of a page is one matrix product. Integer
products below 2^53 are exact in doubles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, SCALE, QUERY_EVERY = 20, 64, 20
PAGE = 256
CANDIDATES, QUERIES = 16_384, 8_192  # rows of a block
TOGETHER = 1024  # queries that go through a tree as one group
PIVOTS, BELOW, DRAWN = 1024, CANDIDATES, 4  # pivots of the upper level at most, candidates below one that they are chosen for, rows drawn for each


class Page:
    """Entries of an M-tree page: vectors, their distances to the page's pivot, and below inner entries pages with radii."""

    __slots__ = ("vectors", "to_parent", "radii", "below", "rows")

    def __init__(self, vectors, to_parent, radii=None, below=None, rows=None):
        self.vectors, self.to_parent, self.radii, self.below, self.rows = vectors, to_parent, radii, below, rows


def build(x: np.ndarray, rows: np.ndarray, pivot: np.ndarray, rng: np.random.Generator, page: int = PAGE) -> Page:
    """Bulk loading: up to `page` pivots drawn from the rows take the rows nearest to them, and so on below."""
    own = x[rows]
    away = np.sqrt(((own - pivot) ** 2).sum(axis=1))
    if len(rows) <= page:
        return Page(own, away, rows=rows)
    chosen = own[rng.choice(len(rows), min(page, -(-len(rows) // (page // 2))), replace=False)]
    to = (chosen**2).sum(axis=1)[None, :] - 2 * (own @ chosen.T)
    nearest = to.argmin(axis=1)
    pivots, below, radii = [], [], []
    for k in range(len(chosen)):
        part = np.flatnonzero(nearest == k)
        if len(part) == len(rows):  # equal distances all around: halve, so that it ends
            halves = np.array_split(part, 2)
        else:
            halves = [part] if len(part) else []
        for half in halves:
            pivots.append(chosen[k])
            radii.append(np.sqrt(((own[half] - chosen[k]) ** 2).sum(axis=1).max()))
            below.append(build(x, rows[half], chosen[k], rng, page))
    pivots = np.array(pivots)
    return Page(pivots, np.sqrt(((pivots - pivot) ** 2).sum(axis=1)), np.array(radii), below)


def search_group(root: Page, pivot: np.ndarray, q: np.ndarray, ids: list[list[int]], own: np.ndarray, k: int, floors: np.ndarray, work: list | None = None) -> list[list[tuple[int, int]]]:
    """For each row of q the k best (score, id) below root of those that reach its floor, ties to the smaller id; ids: those of each row, ascending. The query's own id is left out.

    A query without a floor goes down to the leaf of its greatest bounds first. Then pages are taken best first, by the greatest bound of a
    query in the group; a page's entries are pruned for each query by themselves, and products with what is left are one matrix product.
    work, if given, takes the number of products at its first place."""
    norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
    least = floors.astype(float)
    best: list[list[tuple[float, int]]] = [[] for _ in own]  # heaps of (score, -id)
    only = np.array([i[0] if len(i) == 1 else 0 for i in ids], np.int64)
    single = np.array([len(i) == 1 for i in ids], bool)
    begun: dict[int, np.ndarray] = {}  # leaves that queries went down to first

    def product(at: np.ndarray, vectors: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Products of queries with entries, at least of the pairs that may matter; -inf where none is made."""
        i, j = np.nonzero(may) if 16 * np.count_nonzero(may) < may.size else (None, None)
        if work is not None:
            work[0] += may.size if i is None else len(i)
        if i is None:
            return q[at] @ vectors.T
        out = np.full(may.shape, -np.inf)
        out[i, j] = np.einsum("ij,ij->i", q[at[i]], vectors[j])
        return out

    def take(at: np.ndarray, page: Page, cols: np.ndarray, may: np.ndarray) -> None:
        products, rows = product(at, page.vectors[cols], may), page.rows[cols]
        products[single[rows][None, :] & (only[rows][None, :] == own[at][:, None])] = -np.inf
        good = (products >= least[at][:, None]) & (products > -np.inf)
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
        if len(many):  # ties with the k-th stay
            good[many] &= products[many] >= np.partition(products[many], -k, axis=1)[:, -k][:, None]
        for i, j in zip(*(y.tolist() for y in np.nonzero(good))):
            score, found, heap = float(products[i, j]), 0, best[at[i]]
            for x in ids[rows[j]]:
                if x == own[at[i]]:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (score, -x))
                elif (score, -x) > heap[0]:
                    heapq.heapreplace(heap, (score, -x))
                else:
                    break
                found += 1
                if found == k:
                    break
            if len(heap) == k:
                least[at[i]] = max(floors[at[i]], heap[0][0])

    def go_down(page: Page, at: np.ndarray) -> None:
        every = np.ones((len(at), len(page.vectors)), bool)
        if page.radii is None:
            begun[id(page)] = at
            take(at, page, np.arange(len(page.vectors)), every)
            return
        to = (product(at, page.vectors, every) + norm[at][:, None] * page.radii[None, :]).argmax(axis=1)
        for c in np.unique(to):
            go_down(page.below[c], at[to == c])

    new = np.flatnonzero(np.isneginf(least))
    if len(new):
        go_down(root, new)
    every = np.arange(len(q))
    wait = [(-np.inf, 0, root, every, np.full(len(q), np.inf), q @ pivot)]
    nth = 0
    while wait:
        _, _, page, at, bounds, parent = heapq.heappop(wait)
        keep = bounds >= least[at]
        if id(page) in begun:
            keep &= ~np.isin(at, begun[id(page)])
        at, parent = at[keep], parent[keep]
        reach = page.to_parent if page.radii is None else page.to_parent + page.radii
        may = parent[:, None] + norm[at][:, None] * reach[None, :] + 1e-6 >= least[at][:, None]
        rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(cols):
            continue
        at, may = at[rows], may[np.ix_(rows, cols)]
        if page.radii is None:
            take(at, page, cols, may)
            continue
        products = product(at, page.vectors[cols], may)
        bounds = products + norm[at][:, None] * page.radii[cols][None, :] + 1e-6
        may = bounds >= least[at][:, None]
        for j in np.flatnonzero(may.any(axis=0)):
            on = np.flatnonzero(may[:, j])
            nth += 1
            heapq.heappush(wait, (-float(bounds[on, j].max()), nth, page.below[cols[j]], at[on], bounds[on, j], products[on, j]))
    return [[(int(s), -i) for s, i in heap] for heap in best]


def brute(x: np.ndarray, ids: list[np.ndarray], q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """For components so large that doubles aren't exact: Python's integers, scores held within a long."""
    found = [(max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(row, q)))), i) for row, own_ids in zip(x, ids) for i in own_ids if i != own]
    return heapq.nsmallest(k, found, key=lambda y: (-y[0], y[1]))


def block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in a block of different rows of the same dimension, of those that reach its floor."""
    q, x, ids = np.array(queries["v"].tolist(), float), np.array(rows["v"].tolist(), float), [np.asarray(i).tolist() for i in rows["ids"]]
    pivot = x.mean(axis=0)
    root = None if exceeds(max(np.abs(x).max(), np.abs(q).max()), x.shape[1]) else build(x, np.arange(len(x)), pivot, np.random.default_rng(7))
    own, floors = queries["vec_id"].to_numpy(np.int64), queries["floor"].to_numpy(float)
    for at in range(0, len(q), TOGETHER):
        some = slice(at, at + TOGETHER)
        if root is None:
            found = [brute(x, ids, v, o, k) for o, v in zip(own[some].tolist(), q[some])]
        else:
            found = search_group(root, pivot, q[some], ids, own[some], k, floors[some])
        yield from ((o, i, s) for o, each in zip(own[some].tolist(), found) for s, i in each)


def exceeds(most: float, dim: int) -> bool:
    """Whether products may not be exact in doubles."""
    return most * most * dim >= 2**52


def chosen(rows: DataFrame) -> list[np.ndarray]:
    """The pivots, a number that grows with the candidates up to PIVOTS: of DRAWN times as many candidates, drawn by hash, those farthest from the pivots
    before them, so that few radii are large; none if products aren't exact in doubles or dimensions differ."""
    n, most, low, high = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.min("dim"), F.max("dim")).first()
    if not n or low != high or exceeds(most, high):
        return []
    number = min(PIVOTS, -(-n // BELOW))
    x = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(DRAWN * number).collect()], float)
    out, away = [x[0]], ((x - x[0]) ** 2).sum(axis=1)
    while len(out) < number and away.max() > 0:
        out.append(x[away.argmax()])
        away = np.minimum(away, ((x - out[-1]) ** 2).sum(axis=1))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors by the integer inner
    product of floor(scale * component), all if fewer, ties to the smaller vec_id. Both: (vec_id, embedding).

    Rows without a vec_id, null or empty vectors and those with a null or non-finite component take no part. A
    row that repeats vec_id and vector counts once. A query's own row, found by vec_id, is
    left out. Vectors of other dimensions than the query's are no candidates. Equal vectors are one entry
    with their k + 1 smallest ids, so any number of copies is one candidate. Tables may be empty: then the result is. Other columns don't matter.
    """

    def whole(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
        return df.where("vec_id IS NOT NULL").where(F.size("embedding") > 0).where(fine).select(F.col("vec_id").cast("long"), v.alias("v")).distinct()

    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = whole(vectors).withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut(entries.withColumn("dim", F.size("v")))
    pivots = chosen(entries)
    rows, asked = cut(below(entries, pivots)), cut(whole(queries).withColumn("dim", F.size("v")))
    sizes = {r["pivot"]: (r["n"], r["radius"]) for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # as many rows as pivots
    if not sizes:
        return asked.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    radii = np.array([sizes.get(p, (0, -np.inf))[1] for p in range(max(1, len(pivots)))])
    first = cut(searched(home(asked, pivots, radii), rows, sizes, k))
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("found")).where(F.col("found") >= k).select("query_id", "floor")
    known = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "dim", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    near = first.union(searched(cut(onward(known, pivots, radii)), rows, sizes, k)) if len(pivots) > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def below(entries: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """entries with the number of the pivot that is nearest and the distance to it."""
    if not pivots:
        return entries.select("v", "ids", "dim", F.lit(0).alias("pivot"), F.lit(float("inf")).alias("away"))
    p = np.array(pivots)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), float)
            nearest = ((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
            yield batch.assign(pivot=nearest.astype(np.int32), away=np.sqrt(((x - p[nearest]) ** 2).sum(axis=1)))

    return entries.select("v", "ids", "dim").mapInPandas(each, "v array<double>, ids array<long>, dim int, pivot int, away double")


SENT = "vec_id long, v array<double>, dim int, floor double, pivot int"


def home(asked: DataFrame, pivots: list[np.ndarray], radii: np.ndarray) -> DataFrame:
    """The queries, each with the pivot of the greatest product that has candidates."""
    if len(pivots) < 2:
        return asked.select("vec_id", "v", "dim", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("pivot"))
    p, some = np.array(pivots), np.isfinite(radii)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[batch["dim"] == p.shape[1]]
            q = np.array(own["v"].tolist(), float).reshape(-1, p.shape[1])
            best = np.where(some[None, :], q @ p.T, -np.inf).argmax(axis=1)
            yield own.assign(floor=-np.inf, pivot=best.astype(np.int32))

    return asked.mapInPandas(each, SENT)


def onward(known: DataFrame, pivots: list[np.ndarray], radii: np.ndarray) -> DataFrame:
    """The queries, once for each pivot but their home below which something may reach their floor."""
    p, some = np.array(pivots), np.isfinite(radii)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[batch["dim"] == p.shape[1]]
            for at in range(0, len(own), 256):
                part = own.iloc[at : at + 256]
                q = np.array(part["v"].tolist(), float)
                products = np.where(some[None, :], q @ p.T, -np.inf)
                reach = products + np.sqrt((q * q).sum(axis=1))[:, None] * (1 + 1e-9) * np.where(some, radii, 0)[None, :] + 1e-6
                may = some[None, :] & (reach >= part["floor"].to_numpy()[:, None])
                may[np.arange(len(part)), products.argmax(axis=1)] = False
                i, j = np.nonzero(may)
                yield part.iloc[i].assign(pivot=j.astype(np.int32))

    return known.mapInPandas(each, SENT)


def searched(sent: DataFrame, rows: DataFrame, sizes: dict[int, tuple[int, float]], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each query below the pivot it is sent to. A pivot's candidates are dealt
    into blocks of CANDIDATES, the queries sent to it into groups of QUERIES; each two of these meet in a task."""
    asked = {r["pivot"]: r["n"] for r in sent.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    number = lambda of, most: F.coalesce(F.create_map(*[F.lit(x) for p, n in of.items() for x in (p, max(1, math.ceil(n / most)))])[F.col("pivot")], F.lit(1))
    blocks, groups = number({p: n for p, (n, _) in sizes.items()}, CANDIDATES), number(asked or {0: 1}, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = sent.withColumns({"c": every(blocks), "q": F.pmod(F.xxhash64("vec_id"), groups).cast("int")})
    right = rows.select("v", "ids", "dim", "pivot", F.pmod(F.xxhash64("v"), blocks).cast("int").alias("c"), every(groups).alias("q"))

    def find(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = block(queries, rows, k) if len(queries) and len(rows) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    by = ["pivot", "q", "c", "dim"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(find, "query_id long, vec_id long, score long")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE_SQL = {
    "op3_exact_top_k": f"""
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
    """
}
