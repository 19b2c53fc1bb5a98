"""The distribution of products over pairs of vectors: of a seeded sample in which every pair can be drawn, or exactly over all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.numbering import numbered
from quern.operators.vectors import remove_components, vector_mean
from quern.sources.shared import written

QUANTILES = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
#: Pairs that are drawn at most: two positions each, which may be broadcast.
DRAWN = 200_000


def unranked(r):
    """(i, j) with i < j of a pair's number: j (j - 1) / 2 + i. The root is corrected by whole numbers, so it holds up to 2^62."""
    j = F.floor((F.sqrt(8.0 * r + 1.0) + 1.0) / 2.0).cast("long")
    half = lambda x: F.shiftright(x * (x - 1), 1)
    j = F.when(half(j) > r, j - 1).when(half(j + 1) <= r, j + 1).otherwise(j)
    return (r - half(j)).alias("i"), j.alias("j")


def drawn_pairs(spark, n: int, most: int = DRAWN, seed: int = 42) -> DataFrame:
    """(i, j) of all pairs of positions 0 to n - 1, if there are `most` at most, else of `most` pair numbers that hashes of the seed draw, each as likely, repeats
    too."""
    total = n * (n - 1) // 2
    k = spark.range(min(total, most))
    r = F.col("id") if total <= most else F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % total
    return k.select(r.alias("r")).select(*unranked(F.col("r")))


def sampled_products(df: DataFrame, ident: str, vector: str, most: int = DRAWN, seed: int = 42) -> DataFrame:
    """(x) products of the vectors of drawn pairs; positions are those of `ident` (a key) in order. The ids alone are numbered; only
    vectors that were drawn leave the scan."""
    spark = df.sparkSession
    ids = written(numbered(df.select(F.col(ident).alias("_id")), [], ["_id"], "_pos", 0), "positions")
    pairs = written(drawn_pairs(spark, ids.count(), most, seed), "pairs")
    wanted = pairs.select(F.explode(F.array("i", "j")).alias("_pos")).distinct()
    own = ids.join(F.broadcast(wanted), "_pos")  # two positions for each pair at most
    held = written(df.select(F.col(ident).alias("_id"), F.col(vector).alias("_v")).join(F.broadcast(own), "_id").select("_pos", "_v"), "drawn")
    one, two = held.select(F.col("_pos").alias("i"), F.col("_v").alias("a")), held.select(F.col("_pos").alias("j"), F.col("_v").alias("b"))
    return pairs.join(one, "i").join(two, "j").select(V.dot("a", "b").alias("x"))


def summary(x: DataFrame) -> DataFrame:
    """n, mean, std, min, max and quantiles of products; the values are bounded by what was drawn."""
    q = F.percentile("x", F.array(*map(F.lit, QUANTILES.values())))
    out = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), q.alias("q"))
    return out.select("n", "mean", "std", "min", "max", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)])


def centred(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """df with the vectors less the mean of all, of length 1 again."""
    mean = vector_mean(df.withColumn("_all", F.lit(0)), ["_all"], vector, dim, "_mean").select("_mean")
    return df.crossJoin(F.broadcast(mean)).withColumn(vector, V.l2_added(F.zip_with(vector, "_mean", lambda a, b: a - b), 1e-12)).drop("_mean")  # one row


def variants(df: DataFrame, vector: str, dim: int, k: int = 2, names: tuple[str, ...] = ("raw", "centred", "removed")) -> dict[str, DataFrame]:
    """raw: of length 1; centred: less their mean; removed: those without their k leading directions. Each named one is worked out."""
    out = {"raw": df.withColumn(vector, V.l2_added(vector, 1e-12))}
    if {"centred", "removed"} & {*names}:
        out["centred"] = written(centred(out["raw"], vector, dim), "centred")
    if "removed" in names:
        out["removed"] = remove_components(out["centred"], vector, k, vector)
    return out


#: Vectors of a group at least, bins of a round, and values that a round may send to the driver.
BLOCK, BINS, FEW = 2048, 4096, 20_000
#: Groups that vectors are dealt into, and vectors of a group, about, at most: a vector travels once for each group, and two groups meet in a task.
GROUPS, LARGEST = 16, 65_536
#: Rows and columns of a tile of products, which stays in a core's cache; pairs that the first spans are taken from; values that a task holds before equal ones are added up.
TILE, LOOKED, HELD = (256, 512), 400_000, 1_000_000
#: Deviations of an estimate from pairs within groups that a span reaches to either side; too few only cost another pass.
SURE = 6.0
_MET = "kind int, s int, at double, n long"
_BELOW, _INSIDE, _ENDS, _ALL = range(4)


class _Side:
    """Vectors of a group in order of how often they occur: x as they are, f in single precision over the greatest length, w times each."""

    def __init__(self, rows: pa.ChunkedArray, length: float, dim: int):
        x, w = rows.combine_chunks().flatten().flatten()
        w = w.to_numpy(zero_copy_only=False)
        order = np.argsort(w, kind="stable")
        self.w, self.x = w[order], x.flatten().to_numpy(zero_copy_only=False).reshape(len(w), dim)[order]  # fails if a vector is null or shorter
        if not np.isfinite(self.x).all():
            raise ValueError("exact_summary takes vectors of finite numbers only")
        self.f = (self.x / length).astype(np.float32)

    def cuts(self, step: int) -> list[slice]:
        """Tiles' edges: every `step` rows, and where w changes if it does so seldom."""
        changes = np.flatnonzero(np.diff(self.w)) + 1
        at = np.unique(np.concatenate([np.arange(0, len(self.w), step), changes if len(changes) <= 32 else changes[:0], [len(self.w)]]))
        return [slice(int(a), int(b)) for a, b in zip(at, at[1:])]


class _Met:
    """What the products of a task come to: how many lie below each span, which lie in it (values, or bins of it), the least and the greatest.

    A tile is multiplied in single precision. No product is off by more than `off` there, so one that is farther than that from a span's ends is on the
    side where it seems to be; the others, and those that may be the least or greatest, are worked out in double precision."""

    def __init__(self, spans: list[tuple[float, float]], bins: int | None, length: float, dim: int):
        self.spans, self.bins, self.scale = spans, bins, length * length
        self.off = (dim + 8) * 2.0**-24 + 1e-30
        self.ends = np.array([e for a, b in spans for e in (a / self.scale - self.off, b / self.scale + self.off)], np.float32)
        self.below, self.n, self.low, self.high = [0] * len(spans), 0, np.inf, -np.inf
        self.counts = [np.zeros(bins or 0, np.int64) for _ in spans]
        self.held, self.many = [[] for _ in spans], [0] * len(spans)

    def exact(self, s: int, x: np.ndarray, w: np.ndarray) -> None:
        a, b = self.spans[s]
        self.below[s] += int(w[x < a].sum())
        inside = (x >= a) & (x < b)
        x, w = x[inside], w[inside]
        if self.bins:
            at = np.clip(((x - a) * (self.bins / (b - a))).astype(np.int64), 0, self.bins - 1)
            self.counts[s] += np.bincount(at, w, self.bins).astype(np.int64)
        elif len(x):
            self.held[s].append((x, w))
            self.many[s] += len(x)
            if self.many[s] > HELD:
                self.held[s] = [_added_up(self.held[s])]
                self.many[s] = len(self.held[s][0][0]) // 2  # what can't be added up is gone through again only after as much has come

    def widen(self, x: np.ndarray) -> None:
        if len(x):
            self.low, self.high = min(self.low, float(x.min())), max(self.high, float(x.max()))

    def whole(self, x: np.ndarray, w: np.ndarray) -> None:
        """Products in double precision, each with how many pairs have it."""
        x, w = x[w > 0], w[w > 0]
        self.n += int(w.sum())
        self.widen(x)
        for s in range(len(self.spans)):
            self.exact(s, x, w)

    def tile(self, one: _Side, i: slice, two: _Side, j: slice, x: np.ndarray, less: np.ndarray, odd: np.ndarray) -> None:
        wi, wj = one.w[i], two.w[j]
        if (one is two and i == j) or wi[0] != wi[-1] or wj[0] != wj[-1] or self.high < self.low:
            w = np.multiply.outer(wi, wj)
            if one is two and i == j:
                w = np.triu(w, 1) + np.diag(wi * (wi - 1) // 2)
            return self.whole((one.x[i] @ two.x[j].T).ravel(), w.ravel())
        np.matmul(one.f[i], two.f[j].T, out=x)
        odd[:] = False
        below = []
        for k, end in enumerate(self.ends):
            np.less(x, end, out=less)
            np.logical_xor(odd, less, out=odd)  # below an odd number of ends: within a span
            if k % 2 == 0:
                below.append(int(np.count_nonzero(less)))
        near = np.flatnonzero(odd)
        low, high = float(x.min()), float(x.max())
        least = np.flatnonzero(x <= low + 2 * self.off) if low - self.off <= self.low / self.scale else near[:0]
        most = np.flatnonzero(x >= high - 2 * self.off) if high + self.off >= self.high / self.scale else near[:0]
        w = wi[0] * wj[0]
        if 50 * (len(near) + len(least) + len(most)) > x.size:
            return self.whole((one.x[i] @ two.x[j].T).ravel(), np.full(x.size, w))
        self.n += int(w) * x.size
        for s, k in enumerate(below):
            self.below[s] += int(w) * k

        def products(at):
            return np.einsum("ij,ij->i", one.x[i][at // x.shape[1]], two.x[j][at % x.shape[1]])

        self.widen(products(np.concatenate([least, most])))
        if len(near):
            of, value = np.searchsorted(self.ends, x.ravel()[near], "right") // 2, products(near)
            for s in np.unique(of):
                self.exact(s, value[of == s], np.full(int((of == s).sum()), w))

    def all(self, one: _Side, two: _Side, step: tuple[int, int]) -> None:
        room = {}
        for a, i in enumerate(one.cuts(step[0])):
            # a group meets itself by square tiles, each pair of them once
            for j in one.cuts(step[0])[a:] if one is two else two.cuts(step[1]):
                shape = (i.stop - i.start, j.stop - j.start)
                if shape not in room:
                    room = {k: v for k, v in room.items() if len(room) < 8}
                    room[shape] = np.empty(shape, np.float32), np.empty(shape, bool), np.empty(shape, bool)
                self.tile(one, i, two, j, *room[shape])

    def rows(self) -> pa.Table:
        kind, s, at, n = [[_ALL]], [[0]], [[0.0]], [[self.n]]
        if self.n:
            kind, s, at, n = kind + [[_ENDS] * 2], s + [[0, 0]], at + [[self.low, self.high]], n + [[0, 0]]
        for k in range(len(self.spans)):
            if self.bins:
                x = np.flatnonzero(self.counts[k])
                w = self.counts[k][x]
            else:
                x, w = _added_up(self.held[k]) if self.held[k] else ([], [])
            kind, s, at, n = kind + [[_BELOW], np.full(len(x), _INSIDE)], s + [[k], np.full(len(x), k)], at + [[0.0], x], n + [[self.below[k]], w]
        types = {"kind": np.int32, "s": np.int32, "at": np.float64, "n": np.int64}
        return pa.table({k: np.concatenate([np.asarray(v, t) for v in c]) for (k, t), c in zip(types.items(), (kind, s, at, n))})


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, with the sum of its counts."""
    at, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    n = np.zeros(len(at), np.int64)
    np.add.at(n, of, np.concatenate([w for _, w in held]))
    return at, n


def _apart(spans: dict[str, tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    """The spans in order, those closer than `gap` as one."""
    out = []
    for a, b in sorted(spans.values()):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def exact_summary(df: DataFrame, ident: str, vector: str, block: int = BLOCK, bins: int = BINS, few: int = FEW) -> dict[str, float]:
    """What summary says, over all pairs. Equal vectors are one with a count. Number, mean and deviation follow from the vectors' moments. For the rest
    vectors are dealt into groups by hash; pairs within groups, a sixteenth of all or so, tell narrow spans that the quantiles are likely in; then each
    two groups meet once, tile by tile, and count what lies below the spans; only values within them leave a task. A span that turns out not
    to hold its ranks is widened and the groups meet again, so the result is that of all pairs in any case. The work is that of all products of
    different vectors, once; use it where they are few enough for that. None for fewer than two vectors."""
    own = written(df.groupBy(V.doubles(vector).alias("x")).agg(F.count("*").alias("n")), "vectors")
    n, rows, square, dim = own.agg(F.count("*"), F.sum("n"), F.max(V.dot("x", "x")), F.max(F.size("x"))).first()
    if (rows or 0) < 2:
        return None
    length = square**0.5 or 1.0
    size = max(block, min(-(-n // GROUPS), LARGEST))
    count = -(-n // size)
    dealt = F.pmod(F.xxhash64("x"), F.lit(count)).cast("int").alias("b")
    groups = written(own.select(dealt, F.array(F.struct("x", "n")).alias("v")), "block_pairs")  # a vector a row: a reader's batch of large rows would fill the heap
    step = (min(block, TILE[0]), min(block, TILE[1]))

    def look(found: pa.Table) -> pa.Table:
        """A group's moments and products of pairs drawn in it, i and j in any order and equal ones too, each with what it stands for."""
        side = _Side(found["v"], length, dim)
        k, x, w = len(side.w), side.x, side.w.astype(float)
        if k * k <= LOOKED // count:
            i, j = (a.ravel() for a in np.indices((k, k)))
        else:
            i, j = np.random.default_rng(found["b"][0].as_py()).integers(0, k, (2, -(-LOOKED // count)))
        of = np.where(i == j, w[i] * (w[i] - 1), w[i] * w[j]) * (k * k / len(i))
        own = np.einsum("ij,ij->i", x, x)
        sums = [w @ x, [w @ own, w @ own**2], ((x * w[:, None]).T @ x).ravel(), np.einsum("ij,ij->i", x[i], x[j])[of > 0], of[of > 0]]
        return pa.table({"at": pa.array([np.concatenate(sums).tobytes()], pa.binary())})

    s, own_, m, seen = np.zeros(dim), np.zeros(2), np.zeros(dim * dim), []
    for (raw,) in groups.groupBy("b").applyInArrow(look, "at binary").collect():  # the moments of each group, LOOKED products in all
        x = np.frombuffer(raw)
        a, b, c, d = np.split(x[: dim + 2 + dim * dim], [dim, dim + 2, dim + 2 + dim * dim])
        s, own_, m = s + a, own_ + b, m + c
        seen.append(x[dim + 2 + dim * dim :].reshape(2, -1))
    total = rows * (rows - 1) // 2
    x, w = np.concatenate(seen, 1)
    if n * n <= LOOKED and count == 1:  # x holds all pairs; moments of so few would lose digits
        mean = np.average(x, weights=w)
        variance = np.average((x - mean) ** 2, weights=w)
    else:
        mean = (s @ s - own_[0]) / 2 / total
        variance = max((m @ m - own_[1]) / 2 / total - mean * mean, 0.0)
    out = {"n": total, "mean": float(mean), "std": float(variance**0.5)}
    places = {k: p * (total - 1) for k, p in QUANTILES.items()}
    ranks = {k: (int(p), min(int(p) + 1, total - 1)) for k, p in places.items()}
    whole = (-1.001 * length * length, 1.001 * length * length)

    def run(pairs: DataFrame, spans: list[tuple[float, float]], binned: int | None) -> DataFrame:
        def meet(found: pa.Table) -> pa.Table:
            b = found["b"].to_numpy()
            one = _Side(found["v"].filter(pa.array(b == b.min())), length, dim)
            met = _Met(spans, binned, length, dim)
            met.all(one, one if b.min() == b.max() else _Side(found["v"].filter(pa.array(b == b.max())), length, dim), step)
            return met.rows()

        return pairs.groupBy("hi", "lo").applyInArrow(meet, _MET)

    same = groups.select(F.col("b").alias("hi"), F.col("b").alias("lo"), "b", "v")
    met = groups.select("b", "v", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("c")).select(F.greatest("b", "c").alias("hi"), F.least("b", "c").alias("lo"), "b", "v")
    every = met.repartition(min(count * (count + 1), 1024), "hi", "lo")  # more parts than pairs of groups, so that few parts hold several
    gap = 4 * (dim + 8) * 2.0**-24 * length * length

    # spans from the drawn products, then from all pairs within groups; either by SURE deviations of what such pairs tell
    order = np.argsort(x)
    x, w = x[order], np.cumsum(w[order])
    spans = {}
    for k, p in QUANTILES.items():
        off = SURE * ((p * (1 - p) / max(len(x), 1)) ** 0.5 + 1 / max(len(x), 1))
        low, high = (np.searchsorted(w, q * w[-1]) if len(w) else 0 for q in (p - off, p + off))
        spans[k] = (float(x[low]) if len(x) and p > off else whole[0], float(np.nextafter(x[high], np.inf)) if high < len(x) and p + off < 1 else whole[1])
    for _ in range(4):
        apart = _apart(spans, gap)
        found = run(same, apart, bins).groupBy("kind", "s", "at").agg(F.sum("n").alias("n")).toPandas()  # bins for each span, two ends for each group
        looked = int(found["n"][found["kind"] == _ALL].sum())
        again = False
        for k, p in QUANTILES.items():
            i = next(i for i, (a, b) in enumerate(apart) if a <= spans[k][0] and spans[k][1] <= b)
            of, (a, b) = found[found["s"] == i], apart[i]
            edges, counts = np.linspace(a, b, bins + 1), np.zeros(bins, np.int64)
            inside = of[of["kind"] == _INSIDE]
            counts[inside["at"].astype(int)] = inside["n"]
            upto = of["n"][of["kind"] == _BELOW].sum() + np.concatenate([[0], np.cumsum(counts)])
            off = SURE * ((p * (1 - p)) ** 0.5 * (max(looked, 1) ** -0.5 + count**0.5 / n) + 1 / max(looked, 1))
            low = max(int(np.searchsorted(upto, (p - off) * looked, "right")) - 1, 0)
            high = min(int(np.searchsorted(upto, (p + off) * looked, "left")), bins)
            if high > low and b - a > 1e-12 * length * length:
                spans[k] = (float(edges[low]), float(edges[high]))
                again |= upto[high] - upto[low] > max(8 * off * looked, few)
        if not again:
            break

    where, kept, ends = {}, [], []
    while todo := {k: v for k, v in spans.items() if k not in where}:
        apart = _apart(todo, gap)
        values = written(run(every, apart, None), "values")
        got = {(r["kind"], r["s"]): r for r in values.groupBy("kind", "s").agg(F.sum("n").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()}
        if got[_ALL, 0]["n"] != total:
            raise RuntimeError(f"{got[_ALL, 0]['n']} pairs met of {total}")
        ends = got[_ENDS, 0]
        for k, span in todo.items():
            i = next(i for i, (a, b) in enumerate(apart) if a <= span[0] and span[1] <= b)
            (a, b), before, held = apart[i], got[_BELOW, i]["n"], got[_INSIDE, i]["n"] if (_INSIDE, i) in got else 0
            under, over = ranks[k][0] < before, ranks[k][1] >= before + held
            if under or over:
                more = 8 * max(b - a, 1e-6 * length * length)
                spans[k] = (a - more if under else a, b + more if over else b)
            else:
                where[k] = (len(kept), a, b, before, held)
        kept.append(values.where(F.col("kind") == _INSIDE).select("at", "n"))
    out |= {"min": ends["low"], "max": ends["high"]}
    for i, values in enumerate(kept):
        wanted = {r: v[1:] for k, v in where.items() if v[0] == i for r in ranks[k]}
        value = _of_rank(values, wanted, bins, few)
        for k, v in where.items():
            if v[0] == i:
                low, high = (value[r] for r in ranks[k])
                out[k] = low + (high - low) * (places[k] - int(places[k]))
    return out


def _of_rank(values: DataFrame, where: dict[int, tuple[float, float, int, int]], bins: int, few: int) -> dict[int, float]:
    """The value of each rank: `where` has the span that holds it, the values below the span and those in it. Each round splits the spans into finer ones, until
    so few values are left in them that they can be sorted (or they are all equal)."""

    def bin_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The bin of each value, as a search among the edges has it: by division, put right by the edges themselves."""
        low, high = edges[0], edges[-1]
        if high - low < 1e-9 * max(abs(low), abs(high)):
            return np.searchsorted(edges, x, "right") - 1
        i = np.clip(((x - low) * (bins / (high - low))).astype(np.int64), 0, bins - 1)
        return i + (x >= edges[i + 1]) - (x < edges[i])

    while True:
        wide = sorted({(a, b) for a, b, _, c in where.values() if c > few and b - a > 4e-16 * max(1.0, abs(a), abs(b))})
        if not wide:
            break
        edges = [np.linspace(a, b, bins + 1) for a, b in wide]  # the driver's too, so that a bin and the span that it becomes hold the same values

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(edges), bins))
            for batch in batches:
                x, n = (c.to_numpy() for c in batch.columns)
                for s, e in enumerate(edges):
                    inside = (x >= e[0]) & (x < e[-1])
                    counts[s] += np.bincount(bin_of(x[inside], e), n[inside], bins)[:bins]
            s, at = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"s": s.astype(np.int32), "at": at.astype(np.int32), "n": counts[s, at].astype(np.int64)})

        found = values.mapInArrow(counted, "s int, at int, n long").groupBy("s", "at").agg(F.sum("n").alias("n")).collect()  # bins for each span at most
        for rank, (a, b, before, _) in list(where.items()):
            if (a, b) in wide:
                s = wide.index((a, b))
                for r in sorted((r for r in found if r["s"] == s), key=lambda r: r["at"]):
                    if before + r["n"] > rank:
                        where[rank] = (float(edges[s][r["at"]]), float(edges[s][r["at"] + 1]), before, r["n"])
                        break
                    before += r["n"]
    left = F.lit(False)
    for a, b in {v[:2] for v in where.values()}:
        left |= (F.col("at") >= a) & (F.col("at") < b)
    found = sorted(tuple(r) for r in values.where(left).groupBy("at").agg(F.sum("n")).collect())
    value = {}
    for rank, (a, b, before, _) in where.items():
        for v, k in found:
            if a <= v < b:
                before += k
                value[rank] = v
                if before > rank:
                    break
    return value
