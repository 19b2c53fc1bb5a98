"""Text rules over documents and pages where plain texts tell them apart; quern.plans.wrapped has those that need Korean around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import prompts as P
from quern.functions import text as T
from quern.functions import vectors as V
from quern.sources import corpus as C


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into three sections."""
    t = F.col("text")
    return documents(spark, d).select(
        F.col("lang").alias("domain"), "doc_id", F.substring(t, 1, 200).alias("abstract"), F.substring(t, 201, 400).alias("claims"), F.expr("substring(text, 601)").alias("description")
    )


_records = "records AS (SELECT lang AS domain, doc_id, substr(text, 1, 200) AS abstract, substr(text, 201, 400) AS claims, substr(text, 601) AS description FROM documents)"


def md5(c: F.Column) -> F.Column:
    return F.md5(c.cast("binary"))


# ---- over the tables


def text_basic(spark, d):
    return documents(spark, d).select("doc_id", md5(T.normalize_basic("text")).alias("hash"), F.length(T.normalize_basic("text")).alias("n"))


def artifacts(spark, d):
    return documents(spark, d).select("doc_id", md5(T.cleanup_artifacts("text", "claims")).alias("hash"))


def quality(spark, d):
    return documents(spark, d).select("doc_id", T.low_quality("text").alias("low"))


def phrases(spark, d):
    t = T.squeeze(T.remove_phrases("text", ["of the", "the", "and", "in"]))
    return documents(spark, d).select("doc_id", md5(t).alias("hash"))


def unpivoted(spark, d):
    return C.by_section(records(spark, d)).select("section", "domain", "doc_id", md5(F.col("text")).alias("hash"))


def expanded(spark, d):
    return C.by_mode(records(spark, d)).select("section", "mode", "domain", "doc_id", md5(F.col("text")).alias("hash"))


def domain_phrases(spark, d):
    """Abstracts in every mode, with phrases of one domain's own."""
    own = C.by_mode(records(spark, d), ["abstract"], extra={"en": {"conservative": ["of the"], "strong": ["the"]}})
    return own.select("mode", "domain", "doc_id", md5(F.col("text")).alias("hash"))


def mode_text(spark, d):
    return C.text_by_mode(records(spark, d), "abs_claims", 80).select("doc_id", md5(F.col("text")).alias("hash"))


def long_text(spark, d):
    return C.text_by_mode(records(spark, d), "abs_claims", 200).select("doc_id", F.length("text").alias("n"))


def core(spark, d):
    return records(spark, d).select("doc_id", F.length(C.core_text()).alias("n"), md5(C.core_text()).alias("hash"))


def snippets(spark, d):
    return documents(spark, d).select("doc_id", md5(T.snippet("text")).alias("hash"), md5(T.snippet_always("text", 150)).alias("always"), T.content_hash("text").alias("md5"))


def percents(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.percent(F.col("o_totalprice") / 200000 - 0.25).alias("percent"))


def codes(spark, d):
    return documents(spark, d).select("doc_id", T.code("doc_id").alias("code"))


def props(spark, d):
    own = F.from_json(T.json_object(F.concat(F.lit("noise "), "props", F.lit(" tail"))), "map<string,string>")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.size(own).alias("n"), F.array_join(F.array_sort(F.map_keys(own)), ",").alias("keys"))


def chunked(length: int, step: int, most: int | None, least: int):
    def q(spark, d):
        tokens = F.filter(F.split(F.regexp_replace("text", "[ \\n]+", " "), " "), lambda w: w != "")
        w = V.windows(tokens, length, step, most, least)
        return documents(spark, d).select("doc_id", F.posexplode(w).alias("chunk", "w")).select("doc_id", "chunk", F.size("w").alias("n"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))

    top = "" if most is None else f" AND i < {most}"
    return q, f"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \n]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(0, (len(w) + {step} - 1) // {step}))::INTEGER AS i FROM t), c AS (SELECT doc_id, i, w[i * {step} + 1 : i * {step} + {length}] AS c FROM i WHERE true{top})
        SELECT doc_id, i AS chunk, len(c)::INTEGER AS n, c[1] AS "first", c[-1] AS "last" FROM c WHERE len(c) >= {least}"""


def escaped(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", md5(T.html_escape("html")).alias("hash"))


def line_classes(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.line_class("line").alias("class")).agg(F.count("*").alias("n"))


def prompts(spark, d):
    t = T.labelled_parts([("[A]", F.substring("text", 1, 20)), ("[B]", F.col("source"))])
    return documents(spark, d).select("doc_id", md5(t).alias("hash"))


def few_shot_prompt(spark, d):
    """Ranked examples of each language as one text with scores."""
    from pyspark.sql import Window

    own = documents(spark, d).select("lang", "doc_id", (F.col("n_chars") / 1000).alias("score"))
    top = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).where("rank <= 3")
    line = F.format_string("%d. %d %.4f", "rank", "doc_id", "score")
    return top.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def prompt_flow(spark, d):
    """The prompts of the drafting flow with short wording, one of each for a document."""
    own = records(spark, d)
    listed = F.filter(F.array(F.nullif("domain", F.lit("fr")), F.col("domain"), F.substring("abstract", 1, 20)), lambda x: x.isNotNull())
    some = F.when(F.col("domain") == "de", F.array().cast("array<string>")).otherwise(listed)
    examples = F.when(F.col("domain") == "es", F.array().cast("array<struct<abstract:string,claims:string>>")).otherwise(F.array(F.struct("abstract", "claims")))
    made = {
        "summary": P.summary("claims", "[in]", "(short)", "[do]"), "claim_parts": P.claim_parts("claims", "[claim]", "(none)", "[do]"),
        "difference": P.difference("abstract", some, ("[idea]", "[prior]"), "(none)", "[do]"), "consensus": P.consensus(some, "[drafts]", "(none)", "[do]"),
        "draft": P.draft(P.shown_examples(examples, "[examples]", ("[a]", "[c]"), "--", (50, 70)), F.nullif("domain", F.lit("en")), "abstract", some, ("[idea]", "[only]"), "[do]"),
        "document": P.document("[pdf]", [("title", F.nullif("domain", F.lit("fr")))], [("[A]", F.col("abstract")), ("[C]", F.col("claims"))], some, "[image]", "N/A"),
    }
    return own.select("doc_id", *[md5(c).alias(n) for n, c in made.items()])


def final_prompt(spark, d):
    """The last prompt: the three longest documents of each language as examples, the smallest id's document as the one to write."""
    from pyspark.sql import Window

    own = records(spark, d).join(documents(spark, d).select("doc_id", (F.col("n_chars") / 1000).alias("score")), "doc_id")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "doc_id"))
    top = own.withColumn("rank", rank).where("rank <= 3").groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "abstract", F.nullif(F.substring("claims", 1, 30), F.lit("")).alias("claims")))).alias("examples"))
    new = own.groupBy("domain").agg(F.min_by("abstract", "doc_id").alias("abstract"))
    made = P.final("examples", [("type", F.nullif("domain", F.lit("fr"))), ("summary", F.col("abstract"))], ("[examples]", "[write]"), "### example", ("id", "score", "summary", "claims"), "[rules]", "N/A", 60)
    return top.join(new, "domain").select("domain", md5(made).alias("hash"), F.length(made).alias("n"))


def ranked_records(spark, d):
    from pyspark.sql import Window

    return records(spark, d).where("domain = 'en'").orderBy(F.desc("doc_id")).limit(8).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("doc_id"))))  # eight rows


def shaped_examples(spark, d):
    return C.examples(ranked_records(spark, d)).select("rank", md5(F.col("abstract")).alias("abstract"), md5(F.col("claims")).alias("claims"))


def prior_art_text(spark, d):
    return C.prior_art(ranked_records(spark, d)).select(md5(F.col("text")).alias("hash"))


QUERIES, ORACLES = {}, {}
for _name, _p in {"chunk_windows_a": (254, 256, 8, 1), "chunk_windows_b": (512, 256, 30, 1), "chunk_windows_c": (512, 512, None, 10)}.items():
    QUERIES[_name], ORACLES[_name] = chunked(*_p)
QUERIES |= {
    "text_basic": text_basic, "cleanup_artifacts": artifacts, "low_quality": quality, "remove_phrases": phrases, "section_unpivot": unpivoted, "mode_expand": expanded, "domain_phrases": domain_phrases, "text_by_mode": mode_text,
    "text_min_length": long_text, "core_text": core, "snippet": snippets, "percent_clamp": percents, "code_format": codes, "json_extract": props, "html_escape": escaped, "answer_line_class": line_classes,
    "prompt_parts": prompts, "fewshot_prompt": few_shot_prompt, "fewshot_examples": shaped_examples, "prior_art_text": prior_art_text,
    "prompt_flow": prompt_flow, "final_prompt": final_prompt,
}
# The documents hold no character that NFKC changes and no Hangul, which the phrases of the modes are in; other rules are in quern.plans.wrapped.
_strip = lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_lines = lambda t: f"array_to_string(list_filter(list_transform(string_split(replace({t}, chr(13), chr(10)), chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10))"
_basic = lambda t: _strip(f"regexp_replace(regexp_replace(replace({t}, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_squeeze = lambda t: _strip(f"regexp_replace({t}, '\\s+', ' ', 'g')")
_clean = lambda t: _squeeze(f"regexp_replace(regexp_replace({_basic(t)}, '\\[[0-9]{{4}}\\]', ' ', 'g'), '-\\s*[0-9]+\\s*-', ' ', 'g')")
_json = lambda l: f"CASE WHEN len({l}) > 0 THEN '[' || chr(10) || '  ' || array_to_string(list_transform({l}, lambda x: to_json(x)::VARCHAR), ',' || chr(10) || '  ') || chr(10) || ']' ELSE '[]' END"  # noqa: E731, E741
_headed = lambda h, t: f"CASE WHEN {_strip(t)} <> '' THEN '{h}' || chr(10) || {_strip(t)} || chr(10) ELSE '' END"
_phrases = "text"
for _p in ("of the", "and", "the", "in"):
    _phrases = f"regexp_replace({_phrases}, '{_p.replace(' ', chr(92) + 's*')}', ' ', 'gi')"
ORACLES |= {
    "text_basic": f"SELECT doc_id, md5({_basic('text')}) AS hash, length({_basic('text')}) AS n FROM documents",
    "cleanup_artifacts": f"SELECT doc_id, md5({_clean('text')}) AS hash FROM documents",
    "low_quality": f"SELECT doc_id, length({_strip('text')}) < 300 OR length(regexp_replace(text, '[^가-힣]', '', 'g')) / greatest(length(text), 1) < 0.15 AS low FROM documents",
    "remove_phrases": f"SELECT doc_id, md5({_squeeze(_phrases)}) AS hash FROM documents",
    "section_unpivot": f"WITH {_records} SELECT section, domain, doc_id, md5(text) AS hash FROM (UNPIVOT records ON abstract, claims, description INTO NAME section VALUE text)",
    "mode_expand": f"""WITH {_records}, s AS (SELECT 'abstract' AS section, domain, doc_id, abstract AS text FROM records UNION ALL SELECT 'claims', domain, doc_id, claims FROM records
        UNION ALL SELECT 'description', domain, doc_id, {_lines('description')} FROM records) SELECT section, mode, domain, doc_id, md5({_clean('text')}) AS hash FROM s CROSS JOIN (VALUES ('x'), ('conservative'), ('strong')) m(mode)""",
    "domain_phrases": f"""WITH {_records}, c AS (SELECT mode, domain, doc_id, {_clean('abstract')} AS t FROM records CROSS JOIN (VALUES ('x'), ('conservative'), ('strong')) m(mode)),
        o AS (SELECT mode, domain, doc_id, CASE WHEN domain = 'en' AND mode <> 'x' THEN regexp_replace(t, 'of\\s*the', ' ', 'gi') ELSE t END AS t FROM c), p AS (SELECT mode, domain, doc_id, CASE WHEN domain = 'en' AND mode = 'strong' THEN regexp_replace(t, 'the', ' ', 'gi') ELSE t END AS t FROM o)
        SELECT mode, domain, doc_id, md5({_squeeze('t')}) AS hash FROM p""",
    "text_by_mode": f"WITH {_records}, t AS (SELECT doc_id, concat_ws(chr(10), nullif(abstract, ''), nullif(claims, '')) AS text FROM records) SELECT doc_id, md5(text) AS hash FROM t WHERE length({_strip('text')}) >= 80",
    "text_min_length": f"WITH {_records}, t AS (SELECT doc_id, concat_ws(chr(10), nullif(abstract, ''), nullif(claims, '')) AS text FROM records) SELECT doc_id, length(text) AS n FROM t WHERE length({_strip('text')}) >= 200",
    "core_text": f"WITH {_records}, t AS (SELECT doc_id, concat_ws(chr(10) || chr(10), claims, substr(description, 2001, 6000)) AS t FROM records) SELECT doc_id, length(t) AS n, md5(t) AS hash FROM t",
    "snippet": "SELECT doc_id, md5(CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END) AS hash, md5(substr(text, 1, 150) || '...') AS always, substr(md5(text), 1, 10) AS md5 FROM documents",
    "percent_clamp": "SELECT o_orderkey, format('{:.2f}', greatest(0.0, least(100.0, (o_totalprice / 200000 - 0.25) * 100))) AS percent FROM orders",
    "code_format": "SELECT doc_id, lpad(doc_id::VARCHAR, 6, '0') AS code FROM documents",
    "json_extract": "SELECT event_id, len(json_keys(props))::INTEGER AS n, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS hash FROM pages",
    "answer_line_class": "WITH l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS t FROM documents) SELECT CASE WHEN t = '' THEN 'break' WHEN t[1] = '[' AND t[-1] = ']' THEN 'ai-section-title' WHEN regexp_matches(t, '^[0-9]+\\.') THEN 'ai-sub-title' WHEN t[1] = '-' THEN 'ai-list-item' ELSE 'ai-paragraph' END AS class, count(*) AS n FROM l GROUP BY 1",
    "prompt_parts": "SELECT doc_id, md5('[A]' || chr(10) || substr(text, 1, 20) || chr(10) || chr(10) || '[B]' || chr(10) || source) AS hash FROM documents",
    "fewshot_prompt": "WITH t AS (SELECT lang, doc_id, n_chars / 1000 AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT lang, string_agg(format('{}. {} {:.4f}', rank, doc_id, score), chr(10) ORDER BY rank) AS prompt FROM t WHERE rank <= 3 GROUP BY lang",
    "fewshot_examples": f"WITH {_records}, r AS (SELECT *, (row_number() OVER (ORDER BY doc_id DESC))::INTEGER AS rank FROM records WHERE domain = 'en') SELECT rank, md5(abstract) AS abstract, md5(claims) AS claims FROM r WHERE rank <= 3",
    "prior_art_text": f"WITH {_records}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM records WHERE domain = 'en') SELECT md5(string_agg('<' || rank || '. ' || doc_id || '> ' || abstract || ' | ' || substr(claims, 1, 300) || '...', chr(10) ORDER BY rank)) AS hash FROM r WHERE rank <= 5",
    "prompt_flow": f"""WITH {_records}, x AS (SELECT *, CASE domain WHEN 'de' THEN [] WHEN 'fr' THEN [domain, abstract[:20]] ELSE [domain, domain, abstract[:20]] END AS l FROM records), j AS (SELECT *, {_json('l')} AS j, {_headed('[idea]', 'abstract')} AS idea FROM x)
        SELECT doc_id, md5(CASE WHEN length({_strip('claims')}) >= 50 THEN '[in]' || chr(10) || {_strip('claims')} || chr(10) ELSE '[in]' || chr(10) || '(short)' || chr(10) END || chr(10) || '[do]') AS summary,
        md5(CASE WHEN {_strip('claims')} <> '' THEN '[claim]' || chr(10) || {_strip('claims')} || chr(10) ELSE '[claim]' || chr(10) || '(none)' || chr(10) END || chr(10) || '[do]') AS claim_parts,
        md5(concat_ws(chr(10), nullif(idea, ''), '[prior]' || chr(10) || CASE WHEN len(l) > 0 THEN j ELSE '(none)' END || chr(10), '[do]')) AS difference, md5('[drafts]' || chr(10) || CASE WHEN len(l) > 0 THEN j ELSE '(none)' END || chr(10) || chr(10) || '[do]') AS consensus,
        md5(concat_ws(chr(10), CASE WHEN domain <> 'es' THEN '[examples]' || chr(10) || '[a]' || chr(10) || abstract[:50] || '...' || chr(10) || chr(10) || '[c]' || chr(10) || claims[:70] || '...' || chr(10) || chr(10) || '--' || chr(10) END, nullif(domain, 'en'),
            '[idea]' || chr(10) || abstract || chr(10) || chr(10) || '[only]' || chr(10) || j || chr(10), '[do]')) AS draft,
        md5('[pdf]' || chr(10) || 'title: ' || coalesce(nullif(domain, 'fr'), 'N/A') || chr(10) || chr(10) || '[A]' || chr(10) || coalesce(nullif(abstract, ''), 'N/A') || chr(10) || chr(10) || '[C]' || chr(10) || coalesce(nullif(claims, ''), 'N/A')
            || CASE WHEN len(l) > 0 THEN chr(10) || chr(10) || array_to_string([z FOR z IN list_transform(l, lambda v, i: CASE WHEN {_strip('v')} <> '' THEN '[image] ' || i || chr(10) || {_strip('v')} END) IF z IS NOT NULL], chr(10) || chr(10)) ELSE '' END) AS document FROM j""",
    "final_prompt": f"""WITH {_records}, o AS (SELECT r.*, n_chars / 1000 AS score FROM records r JOIN documents USING (doc_id)), t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, doc_id) AS rank FROM o),
        e AS (SELECT domain, string_agg('### example ' || rank || chr(10) || '- id: ' || doc_id || chr(10) || '- score: ' || format('{{:.4f}}', score) || chr(10) || '- summary: ' || CASE WHEN length(abstract) > 60 THEN abstract[:60] || '...' ELSE coalesce(nullif(abstract, ''), 'N/A') END
            || chr(10) || '- claims: ' || coalesce(nullif(claims[:30], ''), 'N/A'), chr(10) ORDER BY rank) AS e FROM t WHERE rank <= 3 GROUP BY 1), n AS (SELECT domain, arg_min(abstract, doc_id) AS a FROM o GROUP BY 1),
        m AS (SELECT domain, '[examples]' || chr(10) || e || chr(10) || chr(10) || '[write]' || chr(10) || '- type: ' || coalesce(nullif(domain, 'fr'), 'N/A') || chr(10) || '- summary: ' || coalesce(nullif(a, ''), 'N/A') || chr(10) || chr(10) || '[rules]' AS m FROM e JOIN n USING (domain))
        SELECT domain, md5(m) AS hash, length(m) AS n FROM m""",
}
