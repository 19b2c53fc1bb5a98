"""Search, vector algebra and pair statistics over embeddings.

The tables stand in for the engine's own: embeddings for a vector pack, its label for the domain, three slices of a vector, each of
length 1, for a document's sections, four neighbouring vectors for a document's chunks, the row of vec_id 0 for the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import pairs as P
from quern.operators import search as S
from quern.operators import vectors as O
from quern.sources import corpus as C
from quern.sources import packs, sinks
from quern.sources.shared import own_folder

DIM, SECTION_DIM = 64, 20
SECTIONS = {"abstract": 1, "claims": 21, "description": 41}
MODES = {"half": 0.5, "full": 1.0}


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).where("vec_id <> 0").select(F.col("vec_id").alias("doc_id"), "label", V.doubles("embedding").alias("vector"))


def query(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).where("vec_id = 0").select(V.doubles("embedding").alias("q"), F.col("label").alias("q_label"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """(section, doc_id, label, vector) with vectors of length 1."""
    rows = F.array(*[F.struct(F.lit(s).alias("section"), V.l2_floor(F.slice("embedding", at, SECTION_DIM)).alias("vector")) for s, at in SECTIONS.items()])
    return embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "label", F.explode(rows).alias("r")).select("r.section", "doc_id", "label", "r.vector")


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- SQL that several oracles begin with
_q = "q AS (SELECT embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id = 0)"
_c = "c AS (SELECT vec_id AS doc_id, label, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id <> 0)"


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def _mean(name: str, src: str, keys: str, vector: str = "vector") -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"{name} AS (SELECT {k}list(m ORDER BY p) AS mean FROM (SELECT {k}p, avg(v) AS m FROM (SELECT {k}unnest({vector})::DOUBLE AS v, generate_subscripts({vector}, 1) AS p FROM {src}) "
        f"GROUP BY {k}p) {'GROUP BY ' + keys if keys else ''})"
    )


def _minus(a: str, b: str, k: str = "1.0") -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - {k} * z[2])"


def _added(v: str, eps: str = "1e-8") -> str:
    return f"list_transform({v}, lambda x: x / ({_norm(v)} + {eps}))"


def _floor(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest({_norm(v)}, 1e-8))"


_raw = "raw AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, vec_id AS doc_id, label, embedding[{at}:{at + SECTION_DIM - 1}]::DOUBLE[] AS v FROM embeddings" for s, at in SECTIONS.items()) + ")"
_s = f"{_raw}, s AS (SELECT section, doc_id, label, {_floor('v')} AS vector FROM raw)"


# ---- search


def whitened(first: int, gap: float):
    return lambda spark, d: r6(S.whitened_search(corpus(spark, d), query(spark, d), DIM, first, gap))


def _whitened_sql(first: int, gap: float) -> str:
    return f"""
        WITH {_q}, {_c}, {_mean('m', 'c', 'label')},
        f AS (SELECT m.label, list_dot_product(q, {_added('mean')}) AS score FROM m, q ORDER BY score DESC, label LIMIT 1),
        w AS (SELECT {_added('dv')} AS qw FROM (SELECT {_minus('q', 'mean')} AS dv FROM q, f JOIN m USING (label))),
        x AS (SELECT doc_id, label, {_minus('vector', 'mean')} AS v FROM c JOIN m USING (label)),
        sc AS (SELECT doc_id, label, list_dot_product({_added('v')}, qw) AS score FROM x, w),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score - lead(score) OVER (ORDER BY score DESC, doc_id) AS gap FROM sc),
        k AS (SELECT least(coalesce(min(rank), 10), 15) AS n FROM r WHERE rank - 1 >= {first} AND gap > {gap} AND rank <= 15)
        SELECT doc_id, label, round(score, 6) AS score, rank::INTEGER AS rank FROM r, k WHERE rank <= n"""


def fields(spark, d):
    return r6(S.detect_fields(O.vector_mean(corpus(spark, d), ["label"], "vector", DIM), query(spark, d)))


def best_field(spark, d):
    return fields(spark, d).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))


_fields_sql = f"WITH {_q}, {_c}, {_mean('m', 'c', 'label')} SELECT label, round(list_dot_product(q, {_added('mean')}), 6) AS score FROM m, q"


def own_domain(spark, d):
    """The ten nearest of the query's own domain."""
    q = query(spark, d)
    own = corpus(spark, d).join(F.broadcast(q), F.col("label") == F.col("q_label"))
    return S.top_k(own.select("doc_id", "label", V.dot("vector", "q").alias("score")), 10)


_own_sql = f"own AS (SELECT doc_id, label, list_dot_product(vector, q) AS score FROM c JOIN q ON label = q_label ORDER BY score DESC, doc_id LIMIT 10)"  # noqa: F541


def domain_topk(spark, d):
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    return r6(S.with_text(own_domain(spark, d), texts))


def ranked(spark, d):
    return own_domain(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id")))  # ten rows


def fewshots(spark, d):
    return r6(S.few_shots(ranked(spark, d), 5))


def hit_report(spark, d):
    from quern.sources.sinks import report

    return report(ranked(spark, d))


def one_domain(spark, d):
    """A constant domain: the filter is pushed to the scan."""
    return r6(S.domain_search(corpus(spark, d), query(spark, d).select("q"), 3))


# ---- algebra


def center_of(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", V.norm("mean"))


def long_mean(df: DataFrame, *keys: str) -> DataFrame:
    return r6(df.select(*keys, F.posexplode("mean").alias("pos", "value")))


def field_means(spark, d):
    return long_mean(O.vector_mean(corpus(spark, d), ["label"], "vector", DIM), "label")


def section_centers(spark, d):
    return r6(center_of(O.vector_mean(sections(spark, d), ["section"], "vector", SECTION_DIM)).select("section", "norm", F.col("mean")[0].alias("first")))


def global_center(spark, d):
    return long_mean(O.vector_mean(sections(spark, d), [], "vector", SECTION_DIM))


def normalized(spark, d):
    """The variants of length 1 on a tenth of a vector, and on its zero multiple, where they differ."""
    v = F.col("v")
    cols = {f"{n}_{w}": f(x)[0] for n, f in (("floor", V.l2_floor), ("added", V.l2_added), ("zero", V.l2_or_zero), ("guarded", V.l2_guarded)) for w, x in (("tenth", v), ("null", V.scale(v, 0.0)))}
    return r6(embeddings(spark, d).select("vec_id", V.scale("embedding", 0.1).alias("v")).select("vec_id", *[c.alias(n) for n, c in cols.items()]))


def cosines(spark, d):
    rows = corpus(spark, d).join(F.broadcast(query(spark, d)), F.lit(True))
    return r6(rows.select("doc_id", V.dot("vector", "q").alias("dot"), V.cosine_or_zero("vector", "q").alias("guarded"), V.cosine_added("vector", "q").alias("added")))


def centered(spark, d):
    c = corpus(spark, d)
    m = O.vector_mean(c, ["label"], "vector", DIM)
    moved = c.join(m, "label", "left").withColumn("v", V.center("vector", "mean", 0.5))
    return r6(moved.select("doc_id", F.col("v")[0].alias("first"), F.col("v")[63].alias("last")))


def zscored(spark, d):
    return r6(O.zscore_l2(corpus(spark, d), ["label"], "vector", DIM).select("doc_id", F.col("z")[0].alias("first"), F.col("z")[63].alias("last")))


def chunks(spark, d):
    return embeddings(spark, d).select(F.floor(F.col("vec_id") / 4).alias("doc_id"), V.doubles("embedding").alias("vector"))


def pooled_mean(spark, d):
    return r6(O.mean_pool(chunks(spark, d), ["doc_id"], "vector", DIM).select("doc_id", F.col("pooled")[0].alias("first"), F.col("pooled")[63].alias("last")))


def pooled_mean_max(spark, d):
    return r6(O.mean_max_pool(chunks(spark, d), ["doc_id"], "vector", DIM).select("doc_id", F.col("pooled")[0].alias("first"), F.col("pooled")[63].alias("last")))


def same_as_query(spark, d):
    rows = embeddings(spark, d).select("vec_id", V.doubles("embedding").alias("v")).join(F.broadcast(query(spark, d)), F.lit(True))
    return rows.select("vec_id", V.bound_rows(V.minus("v", "q")).alias("duplicate"))


def components_removed(spark, d):
    return r6(O.remove_components(corpus(spark, d), "vector").select("doc_id", F.col("vector_out")[0].alias("first")))


def embedding_csv(spark, d):
    from quern.sources.sinks import embedding_columns

    return r6(embedding_columns(corpus(spark, d), 4, "doc_id").withColumn("d_0", F.col("d_0")))


# ---- pair statistics and weights


def stats_global(spark, d):
    return r6(O.pair_stats(sections(spark, d), "label", "vector", ["section"]))


def stats_domain(spark, d):
    return r6(O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain"))


_pairs = f"""{_s}, p AS (
    SELECT a.section, a.label AS la, b.label AS lb, a.doc_id AS ia, b.doc_id AS ib, list_dot_product(a.vector, b.vector) AS x FROM s a JOIN s b ON a.section = b.section AND a.doc_id <> b.doc_id)"""


def _stats_sql(scope: str) -> str:
    key = "section" if scope == "global" else "section, la AS label"
    across = "la < lb" if scope == "global" else "la <> lb"
    return f"""SELECT {key}, coalesce(avg(x) FILTER (la = lb), 0) AS mu_in, coalesce(avg(x) FILTER ({across}), 0) AS mu_out, coalesce(stddev_pop(x) FILTER (la = lb), 0) AS sigma_in,
        coalesce(stddev_pop(x) FILTER ({across}), 0) AS sigma_out, count(*) FILTER (la = lb) AS count_in, count(*) FILTER ({across}) AS count_out FROM p GROUP BY section{'' if scope == 'global' else ', la'}"""


def _round(select: str, columns: str, keys: str) -> str:
    return f"SELECT {keys}, {', '.join(f'round({c}, 6) AS {c}' for c in columns.split())} FROM ({select})"


def _weights_sql(scope: str) -> str:
    over = "" if scope == "global" else "PARTITION BY label"
    key = "section" if scope == "global" else "section, label"
    return f"""WITH {_pairs}, st AS ({_stats_sql(scope)}), j AS (SELECT *, mu_in - mu_out AS "J", sqrt(sigma_in * sigma_in + sigma_out * sigma_out) AS sigma FROM st),
        z AS (SELECT *, greatest("J" - 0.05, 0) / (sigma + 1e-6) AS "S" FROM j), e AS (SELECT *, exp("S" / 1.5 - max("S" / 1.5) OVER ({over})) AS e FROM z)
        SELECT {key}, round("J", 6) AS "J", round(sigma, 6) AS sigma, round("S", 6) AS "S", round(e / sum(e) OVER ({over}), 6) AS "W" FROM e"""


def weights_global(spark, d):
    return r6(O.dynamic_weights(O.pair_stats(sections(spark, d), "label", "vector", ["section"])).select("section", "J", "sigma", "S", "W"))


def weights_domain(spark, d):
    st = O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain")
    return r6(O.dynamic_weights(st, ["label"]).select("section", "label", "J", "sigma", "S", "W"))


def matrix(spark, d):
    unit = corpus(spark, d).withColumn("vector", V.l2_floor("vector"))
    return r6(O.mean_matrix(unit, "label", "vector"))


def separation(spark, d):
    st = O.pair_stats(sections(spark, d), "label", "vector", ["section"])
    return r6(st.select("section", F.col("mu_in").alias("intra_mean"), F.col("mu_out").alias("inter_mean"), (F.col("mu_in") - F.col("mu_out")).alias("separation")).orderBy(F.desc("separation")))


def modes(spark, d):
    """Separation of each section after centering by its mean with two strengths, and the better one."""
    s = sections(spark, d)
    m = O.vector_mean(s, ["section"], "vector", SECTION_DIM)
    rows = F.array(*[F.struct(F.lit(n).alias("mode"), V.center("vector", "mean", a).alias("v")) for n, a in MODES.items()])
    moved = s.join(m, "section").select("section", "label", F.explode(rows).alias("r")).select("section", "label", "r.mode", F.col("r.v").alias("vector"))
    st = O.pair_stats(moved, "label", "vector", ["section", "mode"])
    return st.select("section", "mode", (F.col("mu_in") - F.col("mu_out")).alias("separation"))


def mode_separation(spark, d):
    return r6(modes(spark, d))


def chosen_mode(spark, d):
    return r6(O.best_mode(modes(spark, d), list(MODES)).select("section", "mode"))


_modes_sql = f"""{_s}, {_mean('m', 's', 'section')}, t AS ({' UNION ALL '.join(f"SELECT section, '{n}' AS mode, doc_id, label, {_minus('vector', 'mean', str(a))} AS v FROM s JOIN m USING (section)" for n, a in MODES.items())}),
    u AS (SELECT section, mode, doc_id, label, {_floor('v')} AS vector FROM t),
    sep AS (SELECT a.section, a.mode, avg(list_dot_product(a.vector, b.vector)) FILTER (a.label = b.label) - avg(list_dot_product(a.vector, b.vector)) FILTER (a.label < b.label) AS separation
        FROM u a JOIN u b ON a.section = b.section AND a.mode = b.mode AND a.doc_id <> b.doc_id GROUP BY 1, 2)"""


def aligned(spark, d):
    s = sections(spark, d)
    return O.align({n: s.where(F.col("section") == n) for n in SECTIONS}, [2, 0, 1])


def align_ranks(spark, d):
    return aligned(spark, d).select("label", "doc_id", "domain_rank")


def _fused(spark, d, weights: dict):
    a = aligned(spark, d)
    for w in weights.values():
        if isinstance(w, DataFrame):
            a = a.join(w, "label")
            break
    return a


def fused_equal(spark, d):
    v = V.l2_floor(V.weighted_sum([f"v_{s}" for s in SECTIONS], [F.lit(1 / 3)] * 3))
    return r6(aligned(spark, d).select("doc_id", v[0].alias("first"), v[19].alias("last")))


def _weight_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("section") == s, F.col("W"))).alias(f"w_{s}") for s in SECTIONS])


def fused_global(spark, d):
    w = _weight_columns(O.dynamic_weights(O.pair_stats(sections(spark, d), "label", "vector", ["section"])), [])
    v = V.l2_floor(V.weighted_sum([f"v_{s}" for s in SECTIONS], [F.col(f"w_{s}") for s in SECTIONS]))
    return r6(aligned(spark, d).join(F.broadcast(w), F.lit(True)).select("doc_id", v[0].alias("first"), v[19].alias("last")))


def fused_domain(spark, d):
    st = O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain")
    w = _weight_columns(O.dynamic_weights(st, ["label"]), ["label"])
    v = V.l2_floor(V.weighted_sum([f"v_{s}" for s in SECTIONS], [F.coalesce(F.col(f"w_{s}"), F.lit(1 / 3)) for s in SECTIONS]))
    return r6(aligned(spark, d).join(w, "label", "left").select("doc_id", v[0].alias("first"), v[19].alias("last")))


def saved_weights(spark, d):
    """Each domain's weights, saved and loaded again."""
    w = O.dynamic_weights(O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain"), ["label"]).select("label", "section", "W")
    folder = own_folder(spark, "weights")
    sinks.write_weights(w, folder)
    return C.saved_table(spark, folder, "label int, section string, W double", "json")


def saved_stats(spark, d):
    """Statistics of two fields as loaded from what was saved."""
    st = O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain")
    folder = own_folder(spark, "stats")
    sinks.write_weights(st, folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in st.schema)
    return r6(C.for_fields(C.saved_table(spark, folder, schema, "csv"), [1, 3], "label"))


def _by_saved(spark, d, normal):
    v = normal(V.weighted_sum([f"v_{s}" for s in SECTIONS], [F.col(f"w_{s}") for s in SECTIONS]))
    own = aligned(spark, d).join(_weight_columns(saved_weights(spark, d), ["label"]), "label")
    return r6(own.select("doc_id", v[0].alias("first"), v[19].alias("last")))


def fused_saved(spark, d):
    return _by_saved(spark, d, V.l2_or_zero)


def fused_at_embedding(spark, d):
    return _by_saved(spark, d, V.l2_guarded)


def cached_sections(spark, d):
    """Every section vector of a cache that lacks none."""
    cache = C.whole_cache(sections(spark, d).withColumnRenamed("label", "field"))
    return r6(cache.select("field", "doc_id", "section", F.col("vector")[0].alias("first")))


TOKENS = 8  # slices of a vector that stand for token states; two vectors' halves for layers


def _tokens(spark, d):
    states = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.slice(V.doubles("embedding"), i * TOKENS + 1, TOKENS))
    mask = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: (i < F.col("vec_id") % (TOKENS + 1)).cast("int"))
    return embeddings(spark, d).select("vec_id", states.alias("states"), mask.alias("mask"))


def pooled_tokens(spark, d):
    a, b = V.token_mean("states", "mask"), V.norm_softmax_pool("states")
    return r6(_tokens(spark, d).select("vec_id", a[0].alias("mean_first"), a[7].alias("mean_last"), b[0].alias("soft_first"), b[7].alias("soft_last")))


def pooled_layers(spark, d):
    """Layers of two tokens each; the last four of these, masked mean and soft pooling."""
    layers = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.slice(F.col("states"), i + 1, 2))
    own = _tokens(spark, d).select("vec_id", V.last_layers(layers).alias("s"))
    a, b = V.token_mean("s", F.array(F.lit(1), F.lit(0))), V.norm_softmax_pool("s")
    return r6(own.select("vec_id", a[0].alias("mean_first"), b[0].alias("soft_first"), b[7].alias("soft_last")))


def _fused_sql(weights: str, join: str, w: str) -> str:
    sums = "list_transform(list_zip(a.vector, b.vector, c.vector), lambda z: " + " + ".join(f"{w.format(s)} * z[{i}]" for i, s in enumerate(SECTIONS, 1)) + ")"
    return f"""{weights}, f AS (SELECT a.doc_id, {sums} AS v FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.section = 'claims' JOIN s c ON a.doc_id = c.doc_id AND c.section = 'description' {join} WHERE a.section = 'abstract')
        SELECT doc_id, round(v[1] / greatest({_norm('v')}, 1e-8), 6) AS "first", round(v[20] / greatest({_norm('v')}, 1e-8), 6) AS "last" FROM f"""


def _wide(scope: str) -> str:
    key = "" if scope == "global" else "label, "
    inner = _weights_sql(scope).replace("round(e / sum(e) OVER", "(e / sum(e) OVER").replace(', 6) AS "W"', ') AS "W"')
    with_, select = inner.rsplit("SELECT section", 1)
    cols = ", ".join(f"max(\"W\") FILTER (section = '{s}') AS w_{s}" for s in SECTIONS)
    return f"{with_.rstrip()}, ww AS (SELECT section{select}), wide AS (SELECT {key}{cols} FROM ww {'' if scope == 'global' else 'GROUP BY label'})"


def prototypes(spark, d):
    return r6(O.prototype_weights(sections(spark, d), "label", "section", "vector", SECTION_DIM))


_prototypes_sql = f"""WITH {_s}, {_mean('m', 's', 'label, section')}, x AS (SELECT m.label AS target, section, m.label = s.label AS inside, CASE WHEN {_norm('vector')} < 1e-8 OR {_norm('mean')} < 1e-8 THEN 0
        ELSE list_dot_product(vector, mean) / ({_norm('vector')} * {_norm('mean')}) END AS cos FROM s JOIN m USING (section)),
    g AS (SELECT target, section, coalesce(avg(cos) FILTER (inside), 0) AS mu_in, coalesce(avg(cos) FILTER (NOT inside), 0) AS mu_out, coalesce(stddev_pop(cos) FILTER (inside), 0) AS sigma_in,
        coalesce(stddev_pop(cos) FILTER (NOT inside), 0) AS sigma_out FROM x GROUP BY 1, 2), h AS (SELECT *, (mu_in - mu_out) / greatest(sqrt(sigma_in * sigma_in + sigma_out * sigma_out), 1e-6) AS snr FROM g),
    e AS (SELECT *, exp(snr - max(snr) OVER (PARTITION BY target)) AS e FROM h)
    SELECT target, section, round(mu_in, 6) AS mu_in, round(mu_out, 6) AS mu_out, round(sigma_in, 6) AS sigma_in, round(sigma_out, 6) AS sigma_out, round(snr, 6) AS snr, round(e / sum(e) OVER (PARTITION BY target), 6) AS weight FROM e"""


def alignment(spark, d):
    c = corpus(spark, d)
    m = O.vector_mean(c, ["label"], "vector", DIM).withColumn("mean", V.l2_added("mean"))
    x = c.join(m, "label").select("label", V.dot("vector", "mean").alias("x"))
    return x.groupBy("label").agg(*[F.round(f("x"), 4).alias(n) for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def _variants(spark, d, *names):
    return P.variants(embeddings(spark, d).select("vec_id", V.doubles("embedding").alias("v")), "v", DIM, names=names)


def _distribution(own, name):
    return r6(P.summary(P.sampled_products(own, "vec_id", "v"))).select(F.lit(name).alias("variant"), "*")


def cosine_quantiles(spark, d):
    """The distribution of cosines over drawn pairs of all vectors, as they are and less their mean."""
    own = _variants(spark, d, "raw", "centred")
    return _distribution(own["raw"], "raw").unionByName(_distribution(own["centred"], "centred"))


def cosine_removed(spark, d):
    """The same without the two leading directions, which SQL can't find."""
    return _distribution(_variants(spark, d, "removed")["removed"], "removed")


def cosine_exact(spark, d):
    """The same over all pairs, counted in blocks."""
    own = embeddings(spark, d).select("vec_id", V.l2_added("embedding", 1e-12).alias("v"))
    found = P.exact_summary(own, "vec_id", "v")
    schema = "n long, mean double, std double, min double, max double, " + ", ".join(f"{q} double" for q in P.QUANTILES)
    return r6(spark.createDataFrame([tuple(found[x.split()[0]] for x in schema.split(", "))] if found else [], schema))


def _cross(spark, d):
    """One document of a field, the one of the smallest id, against all of another field."""
    one = embeddings(spark, d).where("label = 0").orderBy("vec_id").limit(1).select(V.doubles("embedding").alias("q"))
    own = embeddings(spark, d).where("label = 1").select(F.col("vec_id").alias("doc_id"), V.doubles("embedding").alias("v"))
    return own.join(F.broadcast(one), F.lit(True)).select("doc_id", V.dot("v", "q").alias("score"))


def cross_field_top(spark, d):
    return r6(S.top_k(_cross(spark, d), 10))


def cross_field_stats(spark, d):
    x = _cross(spark, d)
    return r6(x.agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_pop("score").alias("std"), F.count("*").alias("n")))


def query_fusion(spark, d):
    """Every query's sections with its domain's weights, a third each where the domain has none."""
    st = O.pair_stats(sections(spark, d), "label", "vector", ["section"], "domain")
    return fused_queries(aligned(spark, d), _weight_columns(O.dynamic_weights(st, ["label"]), ["label"]))


def fused_queries(queries, weights):
    own = queries.join(weights, "label", "left")
    v = V.weighted_sum([f"v_{s}" for s in SECTIONS], [F.coalesce(F.col(f"w_{s}"), F.lit(1 / 3)) for s in SECTIONS])
    return r6(own.select("doc_id", v[0].alias("first"), v[19].alias("last")))


#: Long vectors: so many multiples of an embedding one behind the other.
TIMES = 12


def wide(spark, d):
    times = lambda k: F.transform("embedding", lambda x: x.cast("double") * k)
    parts = [times(k + 1) for k in range(TIMES)]
    return embeddings(spark, d).select("label", "vec_id", F.concat(*parts).alias("vector"))


def wide_stats(spark, d):
    """Means and deviations of vectors of 768 dimensions."""
    st = O.vector_stats(wide(spark, d), ["label"], "vector", DIM * TIMES)
    return r6(st.select("label", "n", F.posexplode(F.arrays_zip("mean", "std"))).select("label", "n", "pos", F.col("col.mean").alias("mean"), F.col("col.std").alias("std")))


def wide_pooled(spark, d):
    """Mean and maximum of vectors of 768 dimensions, four to a document."""
    own = O.mean_max_pool(wide(spark, d).withColumn("doc_id", F.expr("vec_id div 4")), ["doc_id"], "vector", DIM * TIMES)
    return r6(own.select("doc_id", F.col("pooled")[0].alias("first"), F.element_at("pooled", -1).alias("last")))


def _packed(spark, d) -> str:
    folder = own_folder(spark, "packs")
    packs.write_packs(embeddings(spark, d).select("label", F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), folder)
    return folder


def pack_scan(spark, d):
    """Every vector written to packs and read back by ranges of rows."""
    own = packs.read_packs(spark, _packed(spark, d), rows="300")
    return r6(own.select("label", "doc_id", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")))


def pack_label(spark, d):
    """One label of the packs, by a filter that the source takes over."""
    return r6(packs.read_packs(spark, _packed(spark, d)).where("label = '3'").select("doc_id", F.element_at("vector", 1).cast("double").alias("first")))


def searched_each(first: int, gap: float):
    """Every vector whose id 100 divides as a query, against all of another id, with texts."""

    def q(spark, d):
        every = embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "label", V.doubles("embedding").alias("vector"))
        asked = every.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("q"))
        hits = S.whitened_search_each(every, asked, DIM, first, gap)
        texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.length("text").alias("length"))
        return r6(hits.join(texts, "doc_id", "left").select("query_id", "field", "rank", "doc_id", "score", "lang", "length"))

    return q


def _each_sql(first: int, gap: float) -> str:
    unit = lambda v: _added(v, "1e-8")
    less = "list_transform({0}, lambda x, i: x - mean[i])"
    return f"""WITH e AS (SELECT vec_id AS doc_id, label, embedding::DOUBLE[] AS vector FROM embeddings), {_mean('m', 'e', 'label')}, q AS (SELECT doc_id AS query_id, vector AS q FROM e WHERE doc_id % 100 = 0),
        f AS (SELECT query_id, q, label AS field, mean FROM q, m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, {unit('mean')}) DESC, label) = 1), a AS (SELECT query_id, field, {less.format('q')} AS q FROM f),
        w AS (SELECT doc_id, {less.format('vector')} AS v FROM e JOIN m USING (label)), x AS (SELECT query_id, field, doc_id, list_dot_product({unit('v')}, {unit('q')}) AS score FROM a, w),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM x QUALIFY rank <= 16), g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM r),
        c AS (SELECT query_id, least(coalesce(min(rank) FILTER (rank - 1 >= {first} AND gap > {gap}), 10), 15) AS upto FROM g GROUP BY 1)
        SELECT query_id, field, rank, doc_id, round(score, 6) AS score, lang, length(text)::INTEGER AS length FROM r JOIN c USING (query_id) LEFT JOIN documents USING (doc_id) WHERE rank <= upto"""


QUERIES = {
    "pack_scan": pack_scan, "pack_label": pack_label, "wide_stats": wide_stats, "wide_pooled": wide_pooled,
    "search_each_gap_a": searched_each(3, 0.05), "search_each_gap_b": searched_each(2, 0.03),
    "cross_field_top": cross_field_top, "cross_field_stats": cross_field_stats, "query_fusion": query_fusion,
    "search_whitened_gap_a": whitened(3, 0.05), "search_whitened_gap_b": whitened(2, 0.03), "search_domain_topk": domain_topk, "search_one_domain": one_domain,
    "fewshot_threshold": fewshots, "hit_report": hit_report, "detect_field_rank": fields, "detect_field_best": best_field,
    "field_mean_vector": field_means, "section_center": section_centers, "global_center": global_center, "l2_normalize": normalized, "cosine_variants": cosines,
    "centering_alpha": centered, "zscore_l2": zscored, "pool_mean": pooled_mean, "pool_mean_max": pooled_mean_max, "embedding_duplicate": same_as_query,
    "pc_removal": components_removed, "embedding_columns": embedding_csv,
    "pair_stats_global": stats_global, "pair_stats_domain": stats_domain, "domain_mean_matrix": matrix, "separation": separation, "mode_separation": mode_separation, "best_mode": chosen_mode,
    "dynamic_weights_global": weights_global, "dynamic_weights_domain": weights_domain, "snr_prototype_weights": prototypes,
    "align_sections": align_ranks, "fuse_equal": fused_equal, "fuse_global": fused_global, "fuse_domain": fused_domain,
    "centroid_alignment": alignment, "cosine_quantiles": cosine_quantiles, "cosine_removed": cosine_removed, "cosine_exact": cosine_exact,
    "saved_stats": saved_stats, "fuse_saved_weights": fused_saved, "fuse_at_embedding": fused_at_embedding, "cached_sections": cached_sections, "pool_tokens": pooled_tokens, "pool_layers": pooled_layers,
}

_raw = f"v AS (SELECT vec_id, {_added('embedding::DOUBLE[]', '1e-12')} AS v FROM embeddings)"
_quantiles = "count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, " + ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in P.QUANTILES.items())
_tenth, _null = "list_transform(embedding::DOUBLE[], lambda x: x * 0.1)", "list_transform(embedding::DOUBLE[], lambda x: x * 0.0)"
_pool = "chunk AS (SELECT vec_id // 4 AS doc_id, embedding::DOUBLE[] AS vector FROM embeddings)"
_stats_cols = "mu_in mu_out sigma_in sigma_out"
_cross_sql = "x AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 1)) AS score FROM embeddings WHERE label = 1)"
_states = f"""t AS (SELECT vec_id, unnest(range(0, {TOKENS})) AS i, embedding::DOUBLE[] AS e FROM embeddings), st AS (SELECT vec_id, i, e[i * {TOKENS} + 1 : i * {TOKENS} + {TOKENS}] AS s FROM t)"""
_soft = lambda src: f"sz AS (SELECT *, {_norm('s')} AS z FROM {src}), ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM sz)"
ORACLES = {
    "saved_stats": f"WITH {_pairs} SELECT * FROM ({_round(_stats_sql('domain'), _stats_cols, 'section, label, count_in, count_out')}) WHERE label IN (1, 3)",
    "fuse_saved_weights": _fused_sql(_wide("domain"), "JOIN wide ON wide.label = a.label", "w_{}"), "fuse_at_embedding": _fused_sql(_wide("domain"), "JOIN wide ON wide.label = a.label", "w_{}"),
    "cached_sections": f"WITH {_s} SELECT label AS field, doc_id, section, round(vector[1], 6) AS \"first\" FROM s",
    "pool_tokens": f"""WITH {_states}, {_soft('st')} SELECT vec_id, round(coalesce(sum(s[1]) FILTER (i < vec_id % {TOKENS + 1}), 0) / greatest(count(*) FILTER (i < vec_id % {TOKENS + 1}), 1), 6) AS mean_first,
        round(coalesce(sum(s[8]) FILTER (i < vec_id % {TOKENS + 1}), 0) / greatest(count(*) FILTER (i < vec_id % {TOKENS + 1}), 1), 6) AS mean_last, round(sum(s[1] * x) / sum(x), 6) AS soft_first, round(sum(s[8] * x) / sum(x), 6) AS soft_last FROM ex GROUP BY vec_id""",
    "pool_layers": f"""WITH {_states},
        tk AS (SELECT vec_id, j, p, avg(s[p]) AS v FROM st, (VALUES (0), (1)) v(j), (SELECT unnest(range(1, 9)) AS p) WHERE i - j BETWEEN 2 AND 5 GROUP BY 1, 2, 3), av AS (SELECT vec_id, j, list(v ORDER BY p) AS s FROM tk GROUP BY 1, 2), {_soft('av')}
        SELECT vec_id, round(max(s[1]) FILTER (j = 0), 6) AS mean_first, round(sum(s[1] * x) / sum(x), 6) AS soft_first, round(sum(s[8] * x) / sum(x), 6) AS soft_last FROM ex GROUP BY vec_id""",
    "cross_field_top": f"WITH {_cross_sql} SELECT doc_id, round(score, 6) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 10",
    "cross_field_stats": f"WITH {_cross_sql} SELECT round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(min(score), 6) AS min, round(stddev_pop(score), 6) AS std, count(*) AS n FROM x",
    "query_fusion": f"""{_wide("domain")}, every AS (SELECT section, doc_id, label, {_floor('v')} AS vector FROM raw),
        f AS (SELECT a.doc_id, list_transform(list_zip(a.vector, b.vector, c.vector), lambda z: coalesce(w_abstract, 1.0 / 3) * z[1] + coalesce(w_claims, 1.0 / 3) * z[2] + coalesce(w_description, 1.0 / 3) * z[3]) AS v
        FROM every a JOIN every b ON a.doc_id = b.doc_id AND b.section = 'claims' JOIN every c ON a.doc_id = c.doc_id AND c.section = 'description' LEFT JOIN wide ON wide.label = a.label WHERE a.section = 'abstract')
        SELECT doc_id, round(v[1], 6) AS "first", round(v[20], 6) AS "last" FROM f""",
    "wide_stats": f"WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT label, i, count(*) AS n, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY 1, 2) SELECT label, n, (k * {DIM} + i)::INTEGER AS pos, round(m * (k + 1), 6) AS mean, round(d * (k + 1), 6) AS std FROM s, range({TIMES}) t(k)",
    "wide_pooled": f"""WITH e AS (SELECT vec_id // 4 AS doc_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT doc_id, i, (avg(x) + max(x)) / 2 AS p FROM e GROUP BY 1, 2),
        w AS (SELECT doc_id, i, k, p * (k + 1) AS p FROM s, range({TIMES}) t(k)), z AS (SELECT doc_id, sqrt(sum(p * p)) + 1e-8 AS z FROM w GROUP BY 1) SELECT doc_id, round(max(p / z) FILTER (k = 0 AND i = 0), 6) AS first, round(max(p / z) FILTER (k = {TIMES - 1} AND i = {DIM - 1}), 6) AS last FROM w JOIN z USING (doc_id) GROUP BY 1""",
    "pack_scan": "SELECT label::VARCHAR AS label, vec_id::VARCHAR AS doc_id, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "pack_label": "SELECT vec_id::VARCHAR AS doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3",
    "search_each_gap_a": _each_sql(3, 0.05), "search_each_gap_b": _each_sql(2, 0.03),
    "search_whitened_gap_a": _whitened_sql(3, 0.05), "search_whitened_gap_b": _whitened_sql(2, 0.03),
    "search_domain_topk": f"WITH {_q}, {_c}, {_own_sql} SELECT doc_id, lang, n_chars, label, round(score, 6) AS score FROM own LEFT JOIN documents USING (doc_id)",
    "search_one_domain": f"WITH {_q}, {_c} SELECT doc_id, label, round(list_dot_product(vector, q), 6) AS score FROM c, q WHERE label = 3 ORDER BY list_dot_product(vector, q) DESC, doc_id LIMIT 10",
    "fewshot_threshold": f"WITH {_q}, {_c}, {_own_sql}, r AS (SELECT *, (row_number() OVER (ORDER BY score DESC, doc_id))::INTEGER AS rank FROM own) SELECT doc_id, label, round(score, 6) AS score, rank FROM r WHERE (score >= 0.05 OR rank <= 2) AND rank <= 5",
    "hit_report": f"WITH {_q}, {_c}, {_own_sql}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM own) SELECT string_agg(format('{{:2d}}. {{}} [{{}}] {{:.2f}}%', rank, doc_id, label, least(100.0, greatest(0.0, score * 100))), chr(10) ORDER BY rank) AS report FROM r",
    "detect_field_rank": _fields_sql, "detect_field_best": f"SELECT label FROM ({_fields_sql}) ORDER BY score DESC, label LIMIT 1",
    "field_mean_vector": f"WITH {_c}, {_mean('m', 'c', 'label')} SELECT label, (generate_subscripts(mean, 1) - 1)::INTEGER AS pos, round(unnest(mean), 6) AS value FROM m",
    "section_center": f"WITH {_s}, {_mean('m', 's', 'section')} SELECT section, round({_norm('mean')}, 6) AS norm, round(mean[1], 6) AS \"first\" FROM m",
    "global_center": f"WITH {_s}, {_mean('m', 's', '')} SELECT (generate_subscripts(mean, 1) - 1)::INTEGER AS pos, round(unnest(mean), 6) AS value FROM m",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, {_tenth} AS t, {_null} AS n FROM embeddings), w AS (SELECT *, {_norm('t')} AS lt, {_norm('n')} AS ln FROM v)
        SELECT vec_id, round(t[1] / greatest(lt, 1e-8), 6) AS floor_tenth, round(n[1] / greatest(ln, 1e-8), 6) AS floor_null, round(t[1] / (lt + 1e-8), 6) AS added_tenth, round(n[1] / (ln + 1e-8), 6) AS added_null,
        round(CASE WHEN lt < 1e-8 THEN 0 ELSE t[1] / lt END, 6) AS zero_tenth, 0.0::DOUBLE AS zero_null, round(t[1] / lt, 6) AS guarded_tenth, round(n[1], 6) AS guarded_null FROM w""",
    "cosine_variants": f"WITH {_q}, {_c} SELECT doc_id, round(list_dot_product(vector, q), 6) AS dot, round(list_dot_product(vector, q) / ({_norm('vector')} * {_norm('q')}), 6) AS guarded, round(list_dot_product(vector, q) / ({_norm('vector')} * {_norm('q')} + 1e-8), 6) AS added FROM c, q",
    "centering_alpha": f"WITH {_c}, {_mean('m', 'c', 'label')}, x AS (SELECT doc_id, {_minus('vector', 'mean', '0.5')} AS v FROM c JOIN m USING (label)) SELECT doc_id, round(v[1] / greatest({_norm('v')}, 1e-8), 6) AS \"first\", round(v[64] / greatest({_norm('v')}, 1e-8), 6) AS \"last\" FROM x",
    "zscore_l2": f"""WITH {_c}, x AS (SELECT doc_id, label, unnest(vector) AS v, generate_subscripts(vector, 1) AS p FROM c), z AS (SELECT doc_id, p, (v - avg(v) OVER (PARTITION BY label, p)) / (stddev_pop(v) OVER (PARTITION BY label, p) + 1e-8) AS z FROM x),
        n AS (SELECT doc_id, sqrt(sum(z * z)) AS n, max(z) FILTER (p = 1) AS f, max(z) FILTER (p = 64) AS l FROM z GROUP BY 1) SELECT doc_id, round(f / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS "first", round(l / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS "last" FROM n""",
    "pool_mean": f"WITH {_pool}, {_mean('m', 'chunk', 'doc_id')} SELECT doc_id, round(mean[1] / ({_norm('mean')} + 1e-8), 6) AS \"first\", round(mean[64] / ({_norm('mean')} + 1e-8), 6) AS \"last\" FROM m",
    "pool_mean_max": f"""WITH {_pool}, x AS (SELECT doc_id, unnest(vector) AS v, generate_subscripts(vector, 1) AS p FROM chunk), y AS (SELECT doc_id, p, (avg(v) + max(v)) / 2 AS m FROM x GROUP BY 1, 2), m AS (SELECT doc_id, list(m ORDER BY p) AS mean FROM y GROUP BY 1)
        SELECT doc_id, round(mean[1] / ({_norm('mean')} + 1e-8), 6) AS "first", round(mean[64] / ({_norm('mean')} + 1e-8), 6) AS "last" FROM m""",
    "embedding_duplicate": f"WITH {_q}, x AS (SELECT vec_id, {_minus('embedding::DOUBLE[]', 'q')} AS v FROM embeddings, q) SELECT vec_id, {_norm('v')} < 1e-6 AS duplicate FROM x",
    "embedding_columns": "SELECT vec_id AS file, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS d_{i}" for i in range(4)) + " FROM embeddings WHERE vec_id <> 0",
    "pair_stats_global": f"WITH {_pairs} {_round(_stats_sql('global'), _stats_cols, 'section, count_in, count_out')}",
    "pair_stats_domain": f"WITH {_pairs} {_round(_stats_sql('domain'), _stats_cols, 'section, label, count_in, count_out')}",
    "domain_mean_matrix": f"WITH {_c}, u AS (SELECT doc_id, label, {_floor('vector')} AS v FROM c), g AS (SELECT DISTINCT label FROM u), p AS (SELECT a.label AS i, b.label AS j, avg(list_dot_product(a.v, b.v)) AS x FROM u a JOIN u b ON a.doc_id <> b.doc_id GROUP BY 1, 2) SELECT a.label AS domain_i, b.label AS domain_j, round(coalesce(x, 0), 6) AS mean_sim FROM g a CROSS JOIN g b LEFT JOIN p ON p.i = a.label AND p.j = b.label",
    "separation": f"WITH {_pairs}, st AS ({_stats_sql('global')}) SELECT section, round(mu_in, 6) AS intra_mean, round(mu_out, 6) AS inter_mean, round(mu_in - mu_out, 6) AS separation FROM st",
    "mode_separation": f"WITH {_modes_sql} SELECT section, mode, round(separation, 6) AS separation FROM sep",
    "best_mode": f"WITH {_modes_sql} SELECT section, arg_max(mode, separation) AS mode FROM sep GROUP BY section",
    "dynamic_weights_global": _weights_sql("global"), "dynamic_weights_domain": _weights_sql("domain"), "snr_prototype_weights": _prototypes_sql,
    "align_sections": "SELECT label, vec_id AS doc_id, CASE label WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 999 END AS domain_rank FROM embeddings",
    "fuse_equal": _fused_sql(f"WITH {_s}", "", "(1.0 / 3)"), "fuse_global": _fused_sql(_wide("global"), ", wide", "w_{}"), "fuse_domain": _fused_sql(_wide("domain"), "JOIN wide ON wide.label = a.label", "w_{}"),
    "centroid_alignment": f"WITH {_c}, {_mean('m', 'c', 'label')}, x AS (SELECT label, list_dot_product(vector, {_added('mean')}) AS x FROM c JOIN m USING (label)) SELECT label, round(avg(x), 4) AS avg, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max FROM x GROUP BY 1",
    "cosine_quantiles": f"""WITH {_raw}, c AS (SELECT vec_id, {_added("list_transform(v, lambda x, i: x - m[i])", "1e-12")} AS v FROM v, (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY 1))),
        a AS (SELECT 'raw' AS variant, * FROM v UNION ALL SELECT 'centred', * FROM c), o AS (SELECT variant, v, row_number() OVER (PARTITION BY variant ORDER BY vec_id) - 1 AS at FROM a), t AS (SELECT count(*) * (count(*) - 1) // 2 AS t FROM v),
        k AS (SELECT unnest(range(0, least(t, {P.DRAWN}))) AS k, t FROM t), r AS (SELECT CASE WHEN t <= {P.DRAWN} THEN k ELSE ('0x' || substr(md5('42:' || k), 1, 15))::BIGINT % t END AS r FROM k),
        u AS (SELECT r, floor((1 + sqrt(1 + 8.0::DOUBLE * r)) / 2)::BIGINT AS j FROM r), z AS (SELECT r, CASE WHEN j * (j - 1) // 2 > r THEN j - 1 WHEN (j + 1) * j // 2 <= r THEN j + 1 ELSE j END AS j FROM u),
        x AS (SELECT one.variant, list_dot_product(one.v, two.v) AS x FROM z JOIN o one ON one.at = r - j * (j - 1) // 2 JOIN o two ON two.at = j AND two.variant = one.variant) SELECT variant, {_quantiles} FROM x GROUP BY 1""",
    "cosine_exact": f"WITH {_raw}, x AS (SELECT list_dot_product(a.v, b.v) AS x FROM v a JOIN v b ON a.vec_id < b.vec_id) SELECT {_quantiles} FROM x",
}
