"""Lookups, joins, sets and states over the tables: conversations stand in for chat rooms (owner: conv_id modulo 10), events for
signals and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import app as A
from quern.operators import vectors as O
from quern.operators.numbering import numbered
from quern.sources import corpus as C
from quern.sources import sinks
from quern.sources.shared import own_folder
from quern.streaming import expiry as E
from quern.streaming import phases as Ph
from quern.streaming import queue as Q
from quern.streaming import signals as S


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rooms(spark, d):
    talks = t(spark, d, "conversations")
    return talks.groupBy("conv_id").agg(F.max("turn").alias("updated_at")).withColumn("owner", F.col("conv_id") % 10)


def recent_rooms(spark, d):
    return A.recent(rooms(spark, d), ["owner"], "updated_at", "conv_id").select("owner", "conv_id", "updated_at", "nth")


def room_messages(spark, d):
    own = t(spark, d, "conversations").where("conv_id = 3")
    return own.orderBy("turn").select("turn", "role", F.length("text").alias("n"))


def owned_rooms(spark, d):
    return A.owned(rooms(spark, d).withColumn("user_email", F.col("owner").cast("string")), "4").select("conv_id")


def message_rooms(spark, d):
    m = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return m.join(rooms(spark, d), "conv_id").groupBy("owner", "role").agg(F.count("*").alias("n"))


def latest_verification(spark, d):
    return A.latest(t(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def outcomes(spark, d):
    """Codes that users send, held against their latest ones: an event's own id in six digits or more, so that no two events share one."""
    code = F.format_string("%06d", "event_id")
    last = A.latest(t(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", F.when(F.col("event_id").isNotNull(), code).alias("stored"), F.expr("ts + INTERVAL 5 MINUTES").alias("expires_at"))
    sent = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id").isNotNull(), code).alias("code"), F.col("ts").alias("now"))
    return sent.join(last, "user_id", "left").groupBy(A.verification_outcome(F.col("code"), F.col("stored"), F.col("expires_at"), F.col("now")).alias("outcome")).agg(F.count("*").alias("n"))


def live_codes(spark, d):
    e = t(spark, d, "events").withColumn("expires_at", F.expr("ts + INTERVAL 1 HOUR"))
    return S.live(e, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


def queue(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending").otherwise("completed").alias("status"), F.col("ts").alias("created_at"))


def pending(spark, d):
    return A.oldest_pending(queue(spark, d)).select("id", "status")


def updated_queue(spark, d):
    done = A.oldest_pending(queue(spark, d)).select("id", F.lit("failed").alias("new_status"))
    return A.with_status(queue(spark, d), done).groupBy("status").agg(F.count("*").alias("n"))


def known_users(spark, d):
    users = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("email"))
    return A.registered(t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("email"), "o_orderkey"), users).agg(F.count("*").alias("n"))


def unknown_users(spark, d):
    users = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("email")).distinct()
    return A.unregistered(t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("email")), users).select("email")


def role_semi(spark, d):
    m = t(spark, d, "conversations")
    return m.select("conv_id").distinct().join(m.where("role = 'system'").select("conv_id"), "conv_id", "left_semi")


def cascade(spark, d):
    m = t(spark, d, "conversations").select(F.col("conv_id").alias("room_id"), "turn")
    r = rooms(spark, d).select(F.col("conv_id").alias("id"), F.col("owner").cast("string").alias("user_email"))
    users = r.select(F.col("user_email").alias("email")).distinct()
    left = A.delete_user(users, users, r, m, "7")
    return left["messages"].groupBy("room_id").agg(F.count("*").alias("n"))


def first_seen(spark, d):
    return O.first_wins(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


def last_duplicate(spark, d):
    return O.last_wins(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


def index_scan(spark, d):
    index = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("doc_id").alias("load_seq"))
    vectors = t(spark, d, "embeddings").select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("filename"), F.col("label").alias("vector"))
    return C.indexed_vectors(index, vectors).select("id", "filename", F.col("vector").alias("label"))


def text_lookup(spark, d):
    hits = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return hits.join(t(spark, d, "labels"), "doc_id", "left").fillna(-1)


def shared_keys(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").select("doc_id"))


def stacked(spark, d):
    own = t(spark, d, "documents").select("doc_id", "lang")
    packs = [own.where(F.col("lang").eqNullSafe(r["lang"])) for r in own.select("lang").distinct().orderBy("lang").collect()]  # a few languages
    return C.union_packs(packs or [own]).groupBy("lang").agg(F.count("*").alias("n"))


def paths(spark, d):
    one = t(spark, d, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("path"))
    return C.distinct_paths(one, one.where("path LIKE '%/en'"))


def elements(spark, d):
    """Elements of two inventions that both have, and that only the first has."""
    words = F.array_distinct(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    own = t(spark, d, "documents").select("doc_id", words.alias("w"))
    two = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return own.join(two, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).alias("both"), F.size(F.array_except("w", "v")).alias("only"))


def to_parse(spark, d):
    return C.to_parse(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"))


def missing(spark, d):
    cache = t(spark, d, "documents").select(F.col("lang").alias("field"), "doc_id", F.element_at(F.array(*[F.lit(s) for s in C.SECTIONS]), ((F.col("doc_id") % 2) + 1).cast("int")).alias("section"))
    return C.missing_sections(cache)


def images(spark, d):
    own = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_partkey", "l_suppkey", "l_quantity")]).alias("filename"), (F.col("l_quantity") * 10).alias("width"), F.lit(200).alias("height"))
    return C.usable_images(own, 100, 2).select("doc_id", "page", "width")


def sampled(spark, d):
    return C.sampled(t(spark, d, "documents").select("doc_id"), "doc_id", 50)


def surrogates(spark, d):
    """Index rows with ids by path within their type, and their documents' ids."""
    own = t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.col("source").alias("type"))
    return numbered(own, ["type"], ["path"])


def document_of(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def signals(spark, d):
    return t(spark, d, "events").select("event_id", "ts", "user_id", F.concat(F.lit("1000"), ((F.col("event_id") % 4) + 1).cast("string")).alias("code"))


def status_latest(spark, d):
    return S.last_status(signals(spark, d), ["user_id"])


def status_stream(spark, d):
    """The same state kept by a stream; its last table. (Extension)"""
    e = t(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(_folder(spark, d))
    coded = stream.select("event_id", "ts", "user_id", F.concat(F.lit("1000"), ((F.col("event_id") % 4) + 1).cast("string")).alias("code"))
    folder = own_folder(spark, "status")
    S.start_status(coded, folder, ["user_id"]).awaitTermination()
    return S.read_status(spark, folder, ["user_id"])


def expired_stream(spark, d):
    """Codes and tokens that a stream of grants lets expire."""
    e = t(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(_folder(spark, d)).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    folder = own_folder(spark, "expiries")
    E.start_expiries(spark, stream, folder).awaitTermination()
    return E.read_expiries(spark, folder)


def phase_signals(spark, d):
    """The signals of a job over a stream of events, read back in their order."""
    e = t(spark, d, "events")
    folder = own_folder(spark, "phases")
    stream = spark.readStream.schema(e.schema).parquet(_folder(spark, d))
    count = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    Ph.run_noted(stream, count, lambda found, batch: found.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), folder, folder.rsplit("/", 1)[-1])
    own = Ph.notes(spark, folder)
    made = spark.read.parquet(f"{folder}/out").agg(F.sum("n").alias("n_made"))
    return numbered(own, [], ["at"], "nth").crossJoin(F.broadcast(made)).select("nth", "code", "message", "running", "batch", "n_rows", "n_made")


def drained_queue(spark, d):
    """The queue's end state behind a stream whose handler breaks down in the first attempt, halfway through a batch, and is started again; the
    handler can't do rows of some users."""
    from pyspark.errors import StreamingQueryException

    e = t(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(_folder(spark, d))
    asked = lambda x: x.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending").otherwise("completed").alias("status"), "user_id")
    folder, calls = own_folder(spark, "queue"), []

    def handle(rows: DataFrame, attempt: int) -> DataFrame:
        calls.append(attempt)
        if len(calls) == Q.SLICES // 2:
            raise RuntimeError("broke down")
        return rows.select("id", F.when(F.col("user_id") % 50 == 0, "failed").otherwise("completed").alias("status"))

    try:
        Q.drain(asked(stream), handle, folder).awaitTermination()
    except StreamingQueryException:
        Q.drain(asked(stream), handle, folder).awaitTermination()
    return Q.states(asked(e), Q.results(spark, folder)).select("id", "status")


def _folder(spark, d):
    """A stream reads a folder: the table's, or the tables' with the one table's name as its filter."""
    return f"{d}/events.parque[t]"


def window_counts(spark, d):
    """Events by hour and type, as the stream's plan on a batch. (Extension)"""
    return S.windowed_counts(t(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def fused_meta(spark, d):
    own = t(spark, d, "documents").select(F.col("lang").alias("field"), "doc_id", (F.col("n_chars") / 7).alias("w_a"))
    return sinks.fused_meta(own, ["w_a"])


QUERIES = {
    "recent_rooms": recent_rooms, "room_messages": room_messages, "owned_rooms": owned_rooms, "message_rooms": message_rooms, "latest_verification": latest_verification,
    "verification_outcome": outcomes, "live_codes": live_codes, "pending_queue": pending, "queue_status": updated_queue, "registered_semi": known_users, "unregistered_anti": unknown_users,
    "role_semi": role_semi, "cascade_anti": cascade, "first_seen_dedup": first_seen, "last_duplicate_wins": last_duplicate, "index_scan": index_scan,
    "text_lookup": text_lookup, "key_intersection": shared_keys, "vertical_stack": stacked, "distinct_paths": paths, "element_sets": elements, "parse_cache_anti": to_parse,
    "missing_sections": missing, "image_cap": images, "sampled_listing": sampled, "surrogate_ids": surrogates, "document_join": document_of, "status_latest": status_latest,
    "status_stream": status_stream, "expired_stream": expired_stream, "queue_drained": drained_queue, "phase_signals": phase_signals, "window_counts": window_counts, "fused_meta": fused_meta,
}

_rooms = "rooms AS (SELECT conv_id, max(turn) AS updated_at, conv_id % 10 AS owner FROM conversations GROUP BY 1)"
_last = "last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_messages = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MESSAGES.items()) + f" ELSE '{S.OTHER}' END"
_status = f"WITH s AS (SELECT *, '1000' || (event_id % 4 + 1) AS code FROM events), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, code, ts, {_messages} AS message, true AS running FROM l"
_sent = "sent AS (SELECT * FROM (VALUES (1, '10001', NULL), (2, '10002', 0), (3, '10003', 0), (4, 'BATCH', 0), (5, 'DONE', NULL)) s(nth, code, batch))"
ORACLES = {
    "recent_rooms": f"WITH {_rooms} SELECT owner, conv_id, updated_at, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, conv_id) AS nth FROM rooms QUALIFY nth <= 5",
    "room_messages": "SELECT turn, role, length(text) AS n FROM conversations WHERE conv_id = 3",
    "owned_rooms": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 4",
    "message_rooms": "SELECT conv_id % 10 AS owner, role, count(*) AS n FROM conversations GROUP BY 1, 2",
    "latest_verification": f"WITH {_last} SELECT user_id, event_id, event_type FROM last",
    "verification_outcome": f"WITH {_last} SELECT CASE WHEN l.event_id IS NULL THEN 'no code' WHEN l.ts + INTERVAL 5 MINUTE < e.ts THEN 'expired' WHEN e.event_id <> l.event_id THEN 'wrong code' ELSE 'ok' END AS outcome, count(*) AS n FROM events e LEFT JOIN last l USING (user_id) GROUP BY 1",
    "live_codes": "SELECT event_type, count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1",
    "pending_queue": "SELECT event_id AS id, 'pending' AS status FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1",
    "queue_status": "WITH q AS (SELECT CASE WHEN event_type = 'click' THEN 'pending' ELSE 'completed' END AS status, row_number() OVER (PARTITION BY event_type = 'click' ORDER BY ts, event_id) AS nth FROM events) SELECT CASE WHEN status = 'pending' AND nth = 1 THEN 'failed' ELSE status END AS status, count(*) AS n FROM q GROUP BY 1",
    "registered_semi": "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "unregistered_anti": "SELECT c_custkey::VARCHAR AS email FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "role_semi": "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'",
    "cascade_anti": "SELECT conv_id AS room_id, count(*) AS n FROM conversations WHERE conv_id % 10 <> 7 GROUP BY 1",
    "first_seen_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "last_duplicate_wins": "SELECT max(doc_id) AS doc_id FROM documents GROUP BY text",
    "index_scan": "SELECT doc_id AS id, 'f' || doc_id AS filename, label FROM documents JOIN embeddings ON vec_id = doc_id QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) = 1",
    "text_lookup": "SELECT vec_id AS doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM embeddings LEFT JOIN labels ON doc_id = vec_id",
    "key_intersection": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "vertical_stack": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "distinct_paths": "SELECT DISTINCT '/' || source || '/' || lang AS path FROM documents",
    "element_sets": """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[ \n]+')) AS x FROM documents), o AS (SELECT * FROM w WHERE x <> ''),
        n AS (SELECT a.doc_id, a.x, b.x IS NOT NULL AS too FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id + 1 AND b.x = a.x)
        SELECT d.doc_id, count(*) FILTER (too)::INTEGER AS "both", count(*) FILTER (NOT too)::INTEGER AS "only" FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "parse_cache_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "missing_sections": "WITH c AS (SELECT lang AS field, doc_id, CASE doc_id % 2 WHEN 0 THEN 'abstract' ELSE 'claims' END AS has FROM documents) SELECT field, doc_id, section FROM c CROSS JOIN (VALUES ('abstract'), ('claims'), ('description')) s(section) WHERE section <> has",
    "image_cap": "SELECT l_orderkey AS doc_id, l_linenumber AS page, l_quantity * 10 AS width FROM lineitem WHERE l_quantity * 10 >= 100 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) <= 2",
    "sampled_listing": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "surrogate_ids": "SELECT source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, source AS type, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id FROM documents",
    "document_join": "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "status_latest": _status, "status_stream": _status,
    "expired_stream": "WITH k AS (SELECT * FROM (VALUES ('code', 5), ('token', 60)) k(kind, m)), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ts) OVER () AS upto FROM events) SELECT kind, user_id, event_id, ts + m * INTERVAL 1 MINUTE AS expires_at FROM n, k WHERE coalesce(next, upto) > ts + m * INTERVAL 1 MINUTE",
    "phase_signals": "WITH " + _sent + f" SELECT nth, code, {_messages} AS message, code <> 'DONE' AS running, batch, CASE WHEN code = 'BATCH' THEN n END AS n_rows, n AS n_made FROM sent, (SELECT count(*) AS n FROM events)",
    "queue_drained": "SELECT event_id AS id, CASE WHEN event_type = 'click' AND user_id % 50 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events",
    "window_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "fused_meta": "SELECT lang AS field, doc_id, format('{:.8f}', n_chars / 7) AS w_a FROM documents",
}
