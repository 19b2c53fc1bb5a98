"""A Merkle manifest of a dataset: a hash of every row, a root that covers all, and a proof for each row.

Rows are leaves. Each language's leaves, by doc_id, are folded in runs of eight until one node, its
subroot, is left; the subroots, by language, are folded alike to the root.

A task holds a sparse forest: the nodes that it can't resolve yet, by level and index. As a level's number of
nodes is known, so is each run's, and a run that is complete becomes its parent at once. Merging
forests is associative and commutative; they are merged in rounds over spans of eight to the
fourth, eighth, ... leaves, so that no task and no driver holds more than a span's nodes. Proofs come back the same way: a span's
rows learn their siblings below its node from its rows, and those above from the span around it.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.numbering import numbered

from .common import cut, table

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels of a span: it holds 8^4 nodes of the level that it begins at.
SPAN = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(digests: list[bytes]) -> bytes:
    return hashlib.sha256(hexlify(b"".join(digests))).digest()


def nodes_at(n: int, level: int) -> int:
    return -(-n >> ARITY_BITS * level)


def height(n: int) -> int:
    """The level at which n leaves are one node."""
    h = 0
    while nodes_at(n, h) > 1:
        h += 1
    return h


def encoded(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(fields[c]) for c in FIELDS]), 256))


def lowered(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


class Forest:
    """Unresolved nodes of some languages; `sizes` has each one's number of leaves."""

    def __init__(self, sizes: dict[str, int]):
        self.sizes = sizes
        self.heights = {k: height(n) for k, n in sizes.items()}
        self.open: dict[tuple[str, int, int], dict[int, bytes]] = {}
        self.done: list[tuple[str, int, int, bytes]] = []  # nodes that end a span or are a subroot

    def add(self, lang: str, level: int, index: int, digest: bytes, given: bool = True) -> None:
        """A node joins; complete runs become their parents, up to the subroot. given: it came from another forest, which has reported it."""
        n = self.sizes[lang]
        while True:
            if not given and (level == self.heights[lang] or level % SPAN == 0):
                self.done.append((lang, level, index, digest))
            if level == self.heights[lang]:
                return
            run = index >> ARITY_BITS
            slot = self.open.setdefault((lang, level, run), {})
            slot[index & ARITY - 1] = digest
            if len(slot) < min(ARITY, nodes_at(n, level) - (run << ARITY_BITS)):
                return
            del self.open[lang, level, run]
            digest, level, index, given = node([slot[k] for k in sorted(slot)]), level + 1, run, False

    def unresolved(self) -> list[tuple[str, int, int, bytes]]:
        return [(lang, level, run << ARITY_BITS | k, digest) for (lang, level, run), slot in self.open.items() for k, digest in slot.items()]


NODES = "lang_key string, level int, idx long, digest binary, done boolean"
_NODES = pa.schema([("lang_key", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("done", pa.bool_())])


def _emitted(forest: Forest) -> pa.Table:
    own = [(*x, True) for x in forest.done] + [(*x, False) for x in forest.unresolved()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*own)) or [[]] * 5, _NODES.types)], schema=_NODES)


def resolved(leaves: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(lang_key, level, idx, digest): of leaves (lang_key, idx, leaf) the nodes of every SPAN-th level above them, and the subroots."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(sizes)
        for b in batches:
            for k, i, x in zip(*[b.column(c).to_pylist() for c in range(3)]):
                forest.add(k, 0, i, x)
        yield from _emitted(forest).to_batches()

    def merge(nodes: pa.Table) -> pa.Table:
        forest = Forest(sizes)
        for k, level, i, x in zip(*[nodes.column(c).to_pylist() for c in ("lang_key", "level", "idx", "digest")]):
            forest.add(k, level, i, x)
        return _emitted(forest)

    now = cut(leaves.select("lang_key", "idx", "leaf").mapInArrow(fold, NODES))
    done = [now.where("done")]
    for upto in range(SPAN, max(map(height, sizes.values())) + SPAN, SPAN):
        rest = now.where("NOT done")
        span = F.expr(f"shiftright(idx, {ARITY_BITS} * greatest({upto} - level, 0))")
        now = cut(rest.groupBy("lang_key", span.alias("span")).applyInArrow(merge, NODES))
        done.append(now.where("done"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out.drop("done"))


PATHS = "lang_key string, idx long, path binary"


def _paths(own: list[tuple[int, bytes]], n: int, levels: int, above: bytes) -> dict[int, bytes]:
    """For each (index, digest) of a span's nodes at some level, n of them in the language: its siblings up to the span's node, then `above`. A level is a byte of the
    place in its run, one of the run's length, and the others' digests."""
    digests = [d for _, d in own]
    chain: list[list[bytes]] = []
    for _ in range(levels):
        if n == 1:
            break
        part, up = [], []
        for at in range(0, len(digests), ARITY):
            run = digests[at : at + ARITY]
            part += [bytes((k, len(run))) + b"".join(run[:k] + run[k + 1 :]) for k in range(len(run))]
            up.append(node(run))
        chain.append(part)
        digests, n = up, nodes_at(n, 1)
    suffix = [above] * max(len(digests), 1)
    for part in reversed(chain):
        suffix = [p + suffix[k >> ARITY_BITS] for k, p in enumerate(part)]
    return dict(zip((i for i, _ in own), suffix))


def proof_of(path: bytes) -> bytes:
    """All siblings' digests of a path, level by level, left to right."""
    out, at = [], 0
    while at < len(path):
        size = 32 * (path[at + 1] - 1)
        out.append(path[at + 2 : at + 2 + size])
        at += 2 + size
    return b"".join(out)


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    at = 0
    while at < len(path):
        k, size = 32 * path[at], 32 * (path[at + 1] - 1)
        others = path[at + 2 : at + 2 + size]
        digest = hashlib.sha256(hexlify(others[:k] + digest + others[k:])).digest()
        at += 2 + size
    return digest


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _together(nodes: DataFrame, above: DataFrame, fn, schema: str) -> DataFrame:
    """fn for each span of nodes and the path above it; both are dealt by (lang_key, span), a span has 8^SPAN nodes at most."""
    own = nodes.withColumn("span", F.shiftright("idx", ARITY_BITS * SPAN))
    return own.groupBy("lang_key", "span").cogroup(above.withColumnRenamed("idx", "span").groupBy("lang_key", "span")).applyInArrow(fn, schema)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """MANIFEST of docs (doc_id, text, lang, source, n_chars): every row's leaf, its language's subroot, the root, the hash of its proof and the root that its
    leaf as read again, where `when` holds with the columns in `tampered` in place of the stored ones, and the stored siblings lead to; verified: that is the root.

    Leaves stand in order of doc_id (null first), rows of one doc_id in order of their digests, so exact repeats are leaves each and interchangeable.
    A null field is its own value, apart from an empty one; null languages are one language, the first; other columns don't matter; an empty
    table gives an empty result. One language may hold all rows: its leaves are numbered over ranges and folded in spans. The driver has one
    number for each partition and one row for each language.
    """
    c = {x: docs[f"`{x}`"] for x in FIELDS}
    again = leaf(c | (tampered or {}))
    stored = docs.select(F.when(c["lang"].isNull(), "-").otherwise(F.concat(F.lit(":"), c["lang"])).alias("lang_key"), c["doc_id"].cast("long").alias("doc_id"), leaf(c).alias("leaf"), F.when(when if when is not None else F.lit(tampered is not None), again).alias("again"), F.monotonically_increasing_id().alias("tie"))
    # "-" sorts before ":", so null comes first and languages by their bytes
    leaves = cut(numbered(cut(stored), ["lang_key"], ["doc_id", "leaf", "tie"], "idx", 0).drop("tie"))
    sizes = {r["lang_key"]: r["n"] for r in leaves.groupBy("lang_key").agg(F.count("*").alias("n")).collect()}  # languages are few
    if not sizes:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    spark, nodes = docs.sparkSession, resolved(leaves, sizes)
    heights, order = {k: height(n) for k, n in sizes.items()}, sorted(sizes, key=str.encode)
    tops = F.broadcast(spark.createDataFrame(list(heights.items()), "lang_key string, level int"))
    found = {r["lang_key"]: bytes(r["digest"]) for r in nodes.join(tops, ["lang_key", "level"]).collect()}  # a language's subroot
    found |= {r["lang_key"]: bytes(r["leaf"]) for r in leaves.where(F.col("lang_key").isin([k for k in order if not heights[k]])).select("lang_key", "leaf").collect()}
    subroots = [(i, found[k]) for i, k in enumerate(order)]
    tails = _paths(subroots, len(order), height(len(order)), b"")
    root = folded(subroots[0][1], tails[0])
    ends = {k: (found[k].hex(), tails[i]) for i, k in enumerate(order)}

    def inner(level: int):
        def fn(own: pa.Table, above: pa.Table) -> pa.Table:
            rows = sorted(zip(own["idx"].to_pylist(), own["digest"].to_pylist()))
            k, paths = (own["lang_key"][0].as_py() if rows else ""), above["path"].to_pylist()
            out = _paths(rows, nodes_at(sizes[k], level), SPAN, paths[0]) if rows else {}
            return pa.table({"lang_key": pa.array([k] * len(out), pa.string()), "idx": pa.array(list(out), pa.int64()), "path": pa.array(list(out.values()), pa.binary())})

        return fn

    def last(own: pa.Table, above: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([pa.array([], t) for t in types], schema=schema)
        own = own.sort_by("idx")
        k, path = own["lang_key"][0].as_py(), above["path"].to_pylist()[0]
        leaf_of, again_of = own["leaf"].to_pylist(), own["again"].to_pylist()
        paths = _paths(list(enumerate(leaf_of)), sizes[k], SPAN, path)
        out = [(x.hex(), ends[k][0], root.hex(), hashlib.sha256(hexlify(proof_of(paths[i]))).hexdigest(), (f := folded(y or x, paths[i])).hex(), f == root) for i, (x, y) in enumerate(zip(leaf_of, again_of))]
        return pa.Table.from_arrays([own["doc_id"].combine_chunks(), *[pa.array(v, t) for v, t in zip(zip(*out), types[1:])]], schema=schema)

    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    schema = pa.schema(list(zip([x.split()[0] for x in MANIFEST.split(", ")], types)))

    def known(level: int) -> DataFrame:
        """The paths of the languages that are one node at this level already."""
        own = [(k, 0, ends[k][1]) for k in order if level - SPAN < heights[k] <= level or level == SPAN and not heights[k]]
        return spark.createDataFrame(own, PATHS)

    most = -(-max(*heights.values(), 1) // SPAN) * SPAN
    above = known(most)
    for level in range(most - SPAN, 0, -SPAN):
        own = nodes.where((F.col("level") == level) & F.col("lang_key").isin([k for k in order if heights[k] > level]))
        above = cut(_together(own.select("lang_key", "idx", "digest"), above, inner(level), PATHS)).unionByName(known(level))
    return _together(leaves.select("lang_key", "idx", "doc_id", "leaf", "again"), above, last, MANIFEST)


TAMPERED_EVERY = 3


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return manifest(docs, {"text": lowered(F.col("text"))}, F.coalesce(odd, F.lit(False)))


def _oracle(levels: int = 7, above: int = 2) -> str:
    """The manifest in SQL for up to 8^levels rows of a language and 8^above languages, a pair of relations for each level."""
    code = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(code(c if c != "text" else text) for c in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))"
    out = [
        f"d AS (SELECT doc_id, lang, {hashed('text')} AS leaf, CASE WHEN xor({crc}, 4294967295::UBIGINT) % {TAMPERED_EVERY} = 0 THEN {hashed(low)} ELSE {hashed('text')} END AS again FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, again AS h FROM d)",
        "n0 AS (SELECT lang AS g, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p0)",
    ]
    for k in range(levels + above):
        if k == levels:  # from here on the subroots are the leaves
            out += [f"s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{k})", f"u{k} AS (SELECT NULL AS g, NULL AS lang, i, subroot AS h, n FROM s)",
                    f"q{k} AS (SELECT p.* EXCLUDE (i), s.i, s.subroot FROM p{k} p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang)"]
        n, p = (f"u{k}", f"q{k}") if k == levels else (f"n{k}", f"p{k}")
        key = "g" if k < levels else "NULL"
        out += [
            f"r{k} AS (SELECT g, i // {ARITY} AS i, list(h ORDER BY i) AS l, any_value(n) AS n FROM {n} GROUP BY 1, 2)",
            f"n{k + 1} AS (SELECT g, g AS lang, i, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM r{k})",
            f"""p{k + 1} AS (SELECT p.* REPLACE (p.i // {ARITY} AS i, p.proof || CASE WHEN r.n > 1 THEN array_to_string(l[: p.i % {ARITY}] || l[p.i % {ARITY} + 2 :], '') ELSE '' END AS proof,
                CASE WHEN r.n > 1 THEN sha256(array_to_string(l[: p.i % {ARITY}] || [p.h] || l[p.i % {ARITY} + 2 :], '')) ELSE p.h END AS h) FROM {p} p JOIN r{k} r ON r.i = p.i // {ARITY} AND r.g IS NOT DISTINCT FROM {'p.lang' if key == 'g' else 'NULL'})""",
        ]
    end = levels + above
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, p{end}.h AS folded_root, p{end}.h = root.h AS verified FROM p{end}, n{end} root"


ORACLE_SQL = {"op11_merkle_manifest": _oracle()}
