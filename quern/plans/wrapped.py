"""Rules of patent texts, answers, accounts and uploads over whole tables.

The tables hold no Korean, so each query wraps their texts in the headings, phrases and marks that its rule is about: the input is one SQL
expression that Spark and the oracle share, and the oracle states the result from the parts that went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.headings import with_sections
from quern.operators import app as A
from quern.sources import corpus as C
from quern.sources.hooks import text_hook

#: Four parts of a whole text.
PARTS = """coalesce(text, '') AS t, substr(coalesce(text, ''), 1, CAST(floor(length(coalesce(text, '')) / 4) AS INT)) AS a,
    substr(coalesce(text, ''), CAST(floor(length(coalesce(text, '')) / 4) AS INT) + 1, CAST(floor(length(coalesce(text, '')) / 4) AS INT)) AS b,
    substr(coalesce(text, ''), 2 * CAST(floor(length(coalesce(text, '')) / 4) AS INT) + 1, CAST(floor(length(coalesce(text, '')) / 4) AS INT)) AS c,
    substr(coalesce(text, ''), 3 * CAST(floor(length(coalesce(text, '')) / 4) AS INT) + 1) AS d"""
_FROM = {
    "documents": f"SELECT doc_id AS id, lang, source, coalesce(n_chars, 0) AS n, {PARTS} FROM documents",
    "conversations": f"SELECT conv_id * 1000 + turn AS id, role, {PARTS} FROM conversations",
    "orders": "SELECT o_orderkey AS id, * FROM orders", "customer": "SELECT c_custkey AS id, * FROM customer",
    "events": "SELECT event_id AS id, * FROM events", "pages": "SELECT page_id AS id, url FROM pages",
}


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(f"_quern_{name}")
    return spark.sql(_FROM[name].replace(f"FROM {name}", f"FROM _quern_{name}"))


# ---- what the oracles are made of: the parts hold ASCII and Latin letters and the white space of ASCII

NL, NN = "chr(10)", "chr(10) || chr(10)"


def rx(t: str, pattern: str, to: str = "' '") -> str:
    return f"regexp_replace({t}, '{pattern}', {to}, 'g')"


def st(t: str) -> str:
    return rx(t, r"^\s+|\s+$", "''")


def sq(t: str) -> str:
    return st(rx(t, r"\s+"))


def clean(t: str) -> str:
    return rx(rx(t, r"\[[0-9]{4}\]"), r"-\s*[0-9]+\s*-")


def lines(t: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({t}, {NL}), lambda x: {st('x')}), lambda x: x <> ''), {NL})"


def v1(t: str) -> str:
    return st(rx(rx(rx(t, r"\(\s*[0-9]{2,6}\s*[a-zA-Z]?\s*\)", "''"), r"[ \t\f\x0B]+"), r"\n{3,}", NN))


BLANKS, PARAGRAPH = r"[ \t\r\f\x0B]+", r"(?:\[\s*[0-9]{3,5}\s*\]|\(\s*[0-9]{3,5}\s*\))"


def v2(t: str) -> str:
    """Numbers in brackets go, but lists of single digits; those are put aside, as patterns here can't look ahead."""
    alone = r"(\s*[0-9](?:\s*[,~-]\s*[0-9])*\s*[)\]}])"
    for k, mark in enumerate(("\\(", "\\[", "\\{")):
        t = rx(t, mark + alone, f"chr({k + 1}) || '\\1'")
    t = rx(t, r"[(\[{]\s*[0-9]{1,6}[a-zA-Z]?(?:\s*[,~-]\s*[0-9]{1,6}[a-zA-Z]?)*\s*[)\]}]", "''")
    for k, mark in enumerate("([{"):
        t = f"replace({t}, chr({k + 1}), '{mark}')"
    return st(rx(rx(t, BLANKS), r"\n{3,}", NN))


def worth(p: str, least: int) -> str:
    words = "AI|GAN|SIFT|CNN|RNN|LSTM|GRU|Transformer|BERT|GPU|TPU|CPU|NPU|DSP|FPGA|ASIC|SoC|SRAM|DRAM"
    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"(length(regexp_replace({p}, '[^가-힣A-Za-z_/-]', '', 'g')) >= {least} OR regexp_matches({p}, '(?i)(?:^|{edge})(?:{words})(?:$|{edge})'))"


# ---- name: (table, rule over its columns, input expressions by column, the result in the oracle's SQL)

PATENT = f"""concat('발명의 명칭 T', a, {NL}, {NL}, '(57) 요 약', {NL}, 'A', b, {NL}, '청구범위', {NL}, '청구항 1', {NL}, c, {NL}, '발명의 설명', {NL}, '기술분야', {NL}, d, ' G06F 17/30')"""
_unmarked = lambda t: rx(t, r"-\s*[0-9]+\s*-", "''")
PATENT_PARTS = {
    "title": st(f"split_part({_unmarked(chr(39) + 'T' + chr(39) + ' || a')}, {NN}, 1)"), "abstract": st(f"'A' || {_unmarked('b')}"),
    "claims": st(f"'청구범위' || {NL} || '청구항 1' || {NL} || {_unmarked('c')}"), "description": st(f"'기술분야' || {NL} || {_unmarked('d')} || ' G06F 17/30'"),
    "ipc": f"regexp_extract({_unmarked(PATENT)}, '[A-H][0-9]{{2}}[A-Z]\\s*[0-9]+/[0-9]+')",
}


def _pairs(m: Column) -> Column:
    """A map as text, keys in order."""
    return T.let(m, lambda x: F.array_join(F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(k, F.lit("="), F.element_at(x, k))), "|"))


_v1_line = lambda x: sq(rx(rx(x, r"\s*;\s*", "'; '"), r"([0-9]\))\s*", "' \\1 '"))
_v1_lines = f"list_filter(list_transform(string_split({v1('t')}, {NL}), lambda x: {_v1_line('x')}), lambda x: x <> '')"
_sentences = lambda body: f"list_filter(list_transform(string_split({rx(body, '([.?!])' + chr(92) + 's+', chr(39) + chr(92) + '1' + chr(39) + ' || ' + NL)}, {NL}), lambda x: {st('x')}), lambda x: x <> '' AND {worth('x', 5)})"
_clauses = f"list_filter(list_transform(string_split(x, ';'), lambda y: {st('y')}), lambda y: y <> '' AND {worth('y', 8)})"
_v2_line = st(rx(f"CASE WHEN len({_clauses}) > 0 THEN array_to_string({_clauses}, '; ') ELSE {st('x')} END", BLANKS))
_v2_lines = f"list_filter(list_transform(string_split({rx(rx(v2('t'), PARAGRAPH), r'\s*;\s*', chr(39) + '; ' + chr(39))}, {NL}), lambda x: {_v2_line}), lambda x: x <> '')"
_legacy = f"concat('장치', {NL}, '를 ', t, '- 3 -', {NL}, '① 가')"
_block = f"concat('기술분야 ', a, {NL}, '실시예 ', b, {NL}, '발명의  내용 ', c, d)"
_own_block = st(lines("'발명의  내용 ' || c || d"))
_answer = rx(rx(rx(f"'장치 가다. ' || {rx('t', ',' + chr(92) + 's*' + chr(92) + 'n+' + chr(92) + 's*', chr(39) + ', ' + chr(39))} || ' ' || {NN} || '[발명의 명칭]' || {NL} || ' 끝'", r"\s-\s", f"{NL} || '- '"), r"\s\(([0-9]+)\)\s", f"{NL} || '(\\1) '"), r"\n{3,}", NN)
_claimed = f"concat('x ', a, ' What is claimed is ', b, ' Detailed description ', c, d)"  # noqa: F541
_date = "CASE WHEN o_orderkey % 7 = 0 THEN concat('soon ', o_orderkey) WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS STRING) END"
_word = "CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN concat(lower(c_mktsegment), c_custkey) WHEN c_custkey % 5 = 2 THEN concat('a', c_custkey, '!') WHEN c_custkey % 5 = 3 THEN '' ELSE concat(lower(c_mktsegment), '#') END"
_word_ok = f"length({_word}) >= 8 AND regexp_matches({_word}, '[A-Za-z]') AND regexp_matches({_word}, '[0-9]') AND regexp_matches({_word}, '[^A-Za-z0-9]')"
_upload = "CASE WHEN page_id % 3 = 0 THEN concat(url, '.PDF ') WHEN page_id % 3 = 1 THEN concat(' ', url, '.pdf') ELSE url END"
_line = f"""CASE CAST(id % 8 AS INT) WHEN 0 THEN concat('[', source, ']') WHEN 1 THEN concat(' 청구항 ', id, ' ') WHEN 2 THEN concat('청구항 ', id, '에 있어서, ', t) WHEN 3 THEN concat(id, '. ', t)
    WHEN 4 THEN concat('가. ', t) WHEN 5 THEN concat('- ', t) WHEN 6 THEN concat('문장 ', t) ELSE concat(' ', {NL}) END"""

TABLED = {
    "phrases_conservative": ("documents", lambda x: T.preprocess_section(x, "abstract", "conservative"), "concat('본발명은', a, '일 실시예에서 ', b, '를  제공한다', c, '본 발명의 일 실시예에 따르면', d)", sq(" || ' ' || ".join(map(clean, "abcd")))),
    "phrases_strong": ("documents", lambda x: T.preprocess_section(x, "claims", "strong"), "concat('상기', a, '컴퓨팅 장치에서 수행되는 방법으로서', b, '메모리를 구비하고', c, '제1항에  있어서 ', d)", sq(" || ' ' || ".join(map(clean, "abcd")))),
    "cleanup_claims": ("documents", lambda x: T.cleanup_artifacts(x, "claims"), "concat('[0001] 청구항 1 제 1 항에 있어서, ', a, b, ' 등록특허 10-123 ', c, '제2항에있어서', d)", sq(f"', ' || {clean('a || b')} || ' ' || {clean('c')} || ' ' || {clean('d')}")),
    "nfkc_basic": ("documents", T.normalize_basic, "concat('ＡＢ　', t, chr(13), chr(10), chr(10), chr(10), 'ｘ')", st(rx(rx(f"'AB ' || t || {NN} || {NN} || 'x'", r"[ \t]+"), r"\n{3,}", NN))),
    "query_clean": ("documents", T.clean_query, "concat('상기 ', t, ' 본 발명은 (가) A-B_C/D; 특징으로 한다')", sq(f"{rx('lower(t)', '[^0-9a-z' + chr(92) + 's' + chr(92) + '-_/;]')} || ' 가 a-b_c/d;'")),
    "embedding_clean": ("documents", T.clean_for_embedding, "concat('본 발명 제 1 항 ', t, ' 도 2 장치 회로 가 [0001]')", f"array_to_string(list_filter(string_split({sq(rx('lower(t)', '[^a-z' + chr(92) + 's]'))}, ' ') || ['회로'], lambda w: length(w) > 1), ' ')"),
    "v1_common": ("documents", T.v1_common, "concat('가(100a) ', t, ' (1)', chr(13), '다\u200b')", v1(f"'가 ' || t || ' (1)' || {NL} || '다'")),
    "v1_abstract": ("documents", T.v1_abstract, "concat('본 발명은 ', t, '를 제공하는 데 그 목적이 있다.')", sq(f"{v1('t')} || '를 제공한다.'").replace("|| '를 제공한다.'", "|| CASE WHEN regexp_matches(t, '\\s$') THEN ' ' ELSE '' END || '를 제공한다.'")),
    "v1_claims": ("documents", T.v1_claims, f"concat('청구항 1. 가를 포함하는 것을 특징으로 하는 장치', {NL}, t, {NL}, '청구항 2 삭제', {NL}, '제 3 항. 청구항 1에 있어서, 나')", f"array_to_string(['가를 포함하는; 장치'] || {_v1_lines} || ['나'], {NL})"),
    "v1_description": ("documents", T.v1_description, "concat('[0001] 도 1에 도시된 바와 같이, ', t, ' 본 발명의 일 실시예에 따른 가')", sq(f"{rx(v1('t'), r'\[\s*[0-9]{4,5}\s*\]', chr(39) * 2)} || ' 가'")),
    "v2_abstract": ("documents", T.v2_abstract, "concat('요약: ', t)", st(rx(f"CASE WHEN len({_sentences(rx(v2('t'), PARAGRAPH, chr(39) * 2))}) > 0 THEN array_to_string({_sentences(rx(v2('t'), PARAGRAPH, chr(39) * 2))}, ' ') ELSE {rx(v2('t'), PARAGRAPH, chr(39) * 2)} END", BLANKS))),
    "v2_claims": ("documents", T.v2_claims, f"concat('청구항 1: 상기 가나다라마바사아 회로; 짧다; GPU', {NL}, t, {NL}, '청구항 2 삭제', {NL}, '제 3 항. 청구항 1에 있어서, 가나다라마바사아자')", f"array_to_string(['가나다라마바사아 회로; GPU'] || {_v2_lines} || ['가나다라마바사아자'], {NL})"),
    "v2_description": ("documents", T.v2_description, f"concat('[0001] 도면의 간단한 설명', {NL}, '도 1은 구성도이다.', {NL}, '100: 회로', {NL}, t)", st(rx(rx(rx(rx(v2("t"), PARAGRAPH, "''"), r"(?m)^\s*[0-9]{2,6}[a-zA-Z]?\s*[:\-]\s*.*$"), BLANKS), r"\n{3,}", NN))),
    "legacy_normalize": ("documents", T.normalize_legacy, _legacy, st(rx(rx(rx(rx(f"'장치를 ' || t || '- 3 -' || {NL} || '① 가'", r"[ \t]+"), r"\n{3,}", NN), r"-\s*[0-9]+\s*-", "''"), r"\n\s*①\s*", NL))),
    "claims_split": ("documents", lambda x: _pairs(T.split_claims(x)), "concat('청구항 1 ', a, ' 청구항 2 ', b, ' 청구항 3 청구항 1에 있어서, ', c, ' 청구항  4 ', d)", f"'청구항  4=' || {st('d')} || '|청구항 1=' || {st(chr(39) + '에 있어서, ' + chr(39) + ' || c')} || '|청구항 2=' || {st('b')} || '|청구항 3='"),
    "claims_fallback": ("documents", T.fallback_claims, _claimed, st("'What is claimed is ' || b")),
    "detect_tables": ("documents", lambda x: F.array_join(T.tables(x), "|"), f"concat('표 1 ', a, {NL}, {NL}, b, ' 표 2 ', c, {NL}, {NL}, d)", f"{st(f'split_part({chr(39)}표 1 {chr(39)} || a || {NN}, {NN}, 1)')} || '|' || {st(f'split_part({chr(39)}표 2 {chr(39)} || c || {NN}, {NN}, 1)')}"),
    "detect_equations": ("documents", lambda x: F.array_join(T.equations(x), "|"), f"concat('수학식 1 ', a, {NL}, {NL}, b, ' 수학식 2 ', c, {NL}, {NL}, d)", f"split_part('수학식 1 ' || a || {NN}, {NN}, 1) || '|' || split_part('수학식 2 ' || c || {NN}, {NN}, 1)"),
    "description_block": ("documents", T.without_background, _block, f"CASE WHEN length({_own_block}) >= 30 THEN {_own_block} ELSE {lines(_block)} END"),
    "low_quality_hangul": ("documents", lambda x: T.low_quality(x).cast("string"), "concat(repeat('가', CAST(n % 700 AS INT)), t)", f"(length({st('repeat(chr(44032), (n % 700)::INTEGER) || t')}) < 300 OR (n % 700) / greatest(n % 700 + length(t), 1) < 0.15)::VARCHAR"),
    "json_slice": ("documents", T.json_object, "concat('noise {\"a\": \"', t, '\"} tail')", "'{\"a\": \"' || t || '\"}'"),
    "dependent_claim": ("documents", lambda x: T.renumber_dependent(x, F.lit(2)), "concat('제 3 항에 있어서, ', t)", f"'제2항. 제1항에 있어서, ' || {st('t')}"),
    "answer_format": ("documents", T.format_answer, f"concat('장치 가', {NL}, '다. ', t, ' [발명의 명칭] 끝')", st(_answer)),
    "title_maker": ("conversations", T.title, "CASE WHEN role = 'system' THEN concat(' ', chr(10)) WHEN role = 'user' THEN concat(' ', t) ELSE substr(t, 1, 20) END", "CASE WHEN role = 'system' THEN '새 채팅' WHEN role = 'user' THEN CASE WHEN length(trim(t, chr(10) || ' ')) > 20 THEN substr(trim(t, chr(10) || ' '), 1, 20) || '…' ELSE coalesce(nullif(trim(t, chr(10) || ' '), ''), '새 채팅') END ELSE coalesce(nullif(trim(substr(t, 1, 20), chr(10) || ' '), ''), '새 채팅') END"),
    "caption_cleanup": ("conversations", T.caption, "CASE WHEN role = 'user' THEN concat(t, '<end_of_utterance>') ELSE concat('USER: x ASSISTANT: ', t, '<end_of_utterance>') END", sq("t")),
    "answer_line_korean": ("documents", T.line_class, _line, "CASE id % 8 WHEN 0 THEN 'ai-section-title' WHEN 1 THEN 'ai-claim-title' WHEN 2 THEN 'ai-paragraph' WHEN 3 THEN 'ai-sub-title' WHEN 4 THEN 'ai-sub-title' WHEN 5 THEN 'ai-list-item' WHEN 6 THEN 'ai-paragraph' ELSE 'break' END"),
    "date_text": ("orders", T.date_text, _date, "CASE WHEN o_orderkey % 7 = 0 THEN 'soon ' || o_orderkey WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN '-' ELSE year(o_orderdate) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '.' END"),
    "password_policy": ("customer", lambda x: A.password_ok(x).cast("string"), _word, f"({_word_ok})::VARCHAR"),
    "code_shape": ("events", lambda x: A.code_ok(x).cast("string"), "CASE WHEN event_type = 'click' THEN lpad(CAST(event_id AS STRING), 6, '0') WHEN event_type = 'view' THEN concat(event_id, '') ELSE concat('a', user_id) END", "CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN length(event_id::VARCHAR) = 6 ELSE false END::VARCHAR"),
    "not_blank": ("conversations", lambda x: A.not_blank(x).cast("string"), "CASE WHEN role = 'system' THEN concat(' \u3000', chr(10)) WHEN role = 'user' THEN concat('\u3000', t) ELSE NULL END", f"CASE WHEN role = 'user' THEN {st('t')} <> '' ELSE false END::VARCHAR"),
    "input_type": ("pages", lambda x: T.input_type(x, F.lit(True)), _upload, "CASE WHEN page_id % 3 < 2 THEN 'pdf' ELSE 'text' END"),
}


def _query(table: str, rule, given: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        own = rows(spark, d, table)
        own = own.withColumn("page_id", F.col("id")) if table == "pages" else own
        made = own.select("id", F.expr(given).alias("x")).select("id", rule(F.col("x")).alias("r"))
        return made.select("id", F.md5(F.col("r").cast("binary")).alias("hash"), F.length("r").alias("length"))

    return q


def _oracle(table: str, result: str) -> str:
    return f"WITH s AS ({_FROM[table]}), r AS (SELECT id, {result.replace('page_id', 'id') if table == 'pages' else result} AS r FROM s) SELECT id, md5(r) AS hash, length(r) AS length FROM r"


# ---- whole patents


def patents(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, "documents").selectExpr("id AS doc_id", f"{PATENT} AS text")


def section(*names: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        own = with_sections(patents(spark, d), "text")
        return own.select("doc_id", *[F.md5(F.col(n).cast("binary")).alias(n) for n in names])

    s = f"WITH s AS ({_FROM['documents']}) SELECT id AS doc_id, " + ", ".join(f"md5({PATENT_PARTS[n]}) AS {n}" for n in names) + " FROM s"
    return q, s


def section_record(spark, d):
    """Whole patents as records: sections, tables, equations and claims of each."""
    own = C.section_records(patents(spark, d))
    return own.select("id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in PATENT_PARTS], F.size("tables_raw").alias("n_tables"), F.size("equations_detected").alias("n_equations"), F.md5(_pairs(F.col("claims_structured")).cast("binary")).alias("structured"))


def chosen_claims(spark, d):
    """A part's claims, or what a whole text falls back to where they are short."""
    return rows(spark, d, "documents").select("id", F.md5(T.claims_or_fallback("a", "t").cast("binary")).alias("hash"))


def prompt_inputs(spark, d):
    return rows(spark, d, "documents").select("id", F.md5(T.prompt_input("t", F.when(F.col("lang") == "de", F.col("a")).otherwise("")).cast("binary")).alias("hash"))


def default_records(spark, d):
    """Sectioned queries from answers: whole ones, broken ones and ones that lack a part."""
    own = rows(spark, d, "documents")
    whole = F.to_json(F.struct(F.lit("Ai").alias("type"), *[F.struct(F.col(c).alias("raw"), F.lit("x").alias("clean")).alias(s) for s, c in zip(C.SECTIONS, "abc")]))
    lacks = F.to_json(F.struct(F.col("lang").alias("type"), F.struct(F.col("a").alias("raw")).alias("abstract")))
    answer = F.when(F.col("lang") == "en", F.concat(F.lit("Here: "), whole, F.lit(" done"))).when(F.col("lang") == "de", lacks).otherwise(F.concat(F.lit("broken "), "t"))
    q = C.parsed_query(answer, F.col("t"))
    return own.select("id", q["type"].alias("type"), F.md5(q["abstract"]["raw"].cast("binary")).alias("abstract"), F.md5(q["claims"]["raw"].cast("binary")).alias("claims"))


def page_texts(spark, d):
    """Four pages of each document, Korean enough or for the OCR hook; of the latter the first alone is read."""
    own = rows(spark, d, "documents")
    page = lambda k, c: F.struct(F.lit(k).alias("page"), F.concat(F.when((F.col("id") + k) % 2 == 0, F.concat(F.repeat(F.lit("가"), F.greatest(F.length(c), F.lit(300))), F.lit(" "))).otherwise(""), c).alias("text"))
    pages = own.select(F.col("id").alias("doc_id"), F.explode(F.array(*[page(k + 1, c) for k, c in enumerate("abcd")])).alias("p")).select("doc_id", "p.page", "p.text", F.concat_ws("-", "doc_id", "p.page").alias("image"))
    return C.page_texts(pages, text_hook(), "ver1").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.length("text").alias("length"))


def signups(spark, d):
    """Sign-ups with each customer's data, of which some break a rule."""
    c = rows(spark, d, "customer")
    k, good = F.col("c_custkey"), F.concat(F.lower("c_mktsegment"), F.lit("1!"))
    word = F.when(k % 9 == 1, F.lower("c_mktsegment")).otherwise(good)
    made = A.signup_outcome(F.when(k % 9 == 0, " ").otherwise(F.concat("c_name", F.lit("@b"))), F.col("c_name"), word, F.when(k % 9 == 2, good).otherwise(F.when(k % 9 == 3, "x").otherwise(word)), k % 9 != 4, k % 9 != 5, k % 9 == 6)
    return c.select("id", made.alias("outcome"))


PHRASED = {
    "abstract": "concat('본 발명은 ', a, ' 적어도 하나 이상의 ', b, '를 제공한다')", "claims": "concat('청구항 1 상기 ', c, ' 단계 제 1 항에 있어서 ')",
    "description": f"concat('배경기술 ', a, {NL}, '발명의 내용 ', repeat('가나 ', 10), {NL}, d, ' 예를 들어')",
}


def phrased_modes(spark, d):
    """Every mode of sections that hold headings, artifacts and phrases of every mode."""
    own = rows(spark, d, "documents").select(F.col("lang").alias("domain"), F.col("id").alias("doc_id"), *[F.expr(x).alias(s) for s, x in PHRASED.items()])
    return C.by_mode(own).select("section", "mode", "doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))


_pad = "repeat('가나 ', 10)"
_phrased = {
    ("abstract", "x"): f"'본 발명은 ' || {clean('a')} || ' 적어도 하나 이상의 ' || {clean('b')} || '를 제공한다'", ("abstract", "conservative"): f"{clean('a')} || ' 적어도 하나 이상의 ' || {clean('b')}", ("abstract", "strong"): f"{clean('a')} || ' ' || {clean('b')}",
    ("claims", "x"): f"'상기 ' || {clean('c')} || ' 단계'", ("claims", "conservative"): f"{clean('c')} || ' 단계'", ("claims", "strong"): clean("c"),
    ("description", "x"): f"'발명의 내용 ' || {_pad} || {clean('d')} || ' 예를 들어'", ("description", "conservative"): f"'발명의 내용 ' || {_pad} || {clean('d')}", ("description", "strong"): f"{_pad} || {clean('d')}",
}

QUERIES = {name: _query(table, rule, given) for name, (table, rule, given, _) in TABLED.items()}
ORACLES = {name: _oracle(table, result) for name, (table, _, _, result) in TABLED.items()}
for _name, _own in {"section_abstract": ["abstract"], "section_claims": ["claims"], "section_description": ["description"], "section_title_ipc": ["title", "ipc"]}.items():
    QUERIES[_name], ORACLES[_name] = section(*_own)
QUERIES |= {
    "section_record": section_record, "claims_or_fallback": chosen_claims, "prompt_input": prompt_inputs, "default_record": default_records, "page_text": page_texts, "signup_outcome": signups,
    "mode_expand_phrases": phrased_modes,
}
_s = f"s AS ({_FROM['documents']})"
_chosen = "CASE WHEN length({0}) < 300 AND {1} <> '' THEN {1} ELSE {0} END"
_record_claims = PATENT_PARTS["claims"]
_fallen = st(f"'청구항 1' || {NL} || c || {NL}")
_good = lambda c: v1(f"repeat('가', greatest(length({c}), 300)::INTEGER) || ' ' || {c}")
_page = lambda k, c: f"CASE WHEN (id + {k}) % 2 = 0 THEN {_good(c)} WHEN {k} <= 2 THEN 'text:' || substr(md5(id || '-{k}'), 1, 8) WHEN {c} <> '' THEN {v1(c)} END"
ORACLES |= {
    "section_record": f"""WITH {_s}, r AS (SELECT *, {', '.join(f'{v} AS r_{k}' for k, v in PATENT_PARTS.items())}, {_fallen} AS f FROM s), z AS (SELECT *, CASE WHEN length(r_claims) < 300 AND f <> '' THEN f ELSE r_claims END AS z FROM r)
        SELECT id, md5(r_title) AS title, md5(r_abstract) AS abstract, md5(z) AS claims, md5(r_description) AS description, md5(r_ipc) AS ipc, 0 AS n_tables, 0 AS n_equations, md5('청구항 1=' || {st("split_part(z, '청구항 1', 2)")}) AS structured FROM z""",
    "claims_or_fallback": f"WITH {_s} SELECT id, md5({_chosen.format('a', 't')}) AS hash FROM s",
    "prompt_input": f"""WITH {_s}, r AS (SELECT id, '[사용자 텍스트 입력]' || {NL} || {st('t')} AS head, CASE WHEN lang = 'de' THEN {st('a')} ELSE '' END AS seen FROM s)
        SELECT id, md5(CASE WHEN seen = '' THEN head ELSE head || {NN} || '[이미지 기반 도면 설명]' || {NL} || '이미지 d에 대한 설명: ' || seen END) AS hash FROM r""",
    "default_record": f"WITH {_s} SELECT id, 'Ai' AS type, md5(CASE WHEN lang = 'en' THEN a ELSE t END) AS abstract, md5(CASE WHEN lang = 'en' THEN b ELSE t END) AS claims FROM s",
    "page_text": f"""WITH {_s}, p AS (SELECT id, list_filter([{', '.join(_page(k + 1, c) for k, c in enumerate('abcd'))}], lambda x: x IS NOT NULL) AS l FROM s)
        SELECT id AS doc_id, md5(array_to_string(l, {NN})) AS hash, length(array_to_string(l, {NN})) AS length FROM p""",
    "signup_outcome": "SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'blank' WHEN 1 THEN 'password' WHEN 3 THEN 'different' WHEN 4 THEN 'unverified' WHEN 5 THEN 'terms' WHEN 6 THEN 'registered' ELSE 'ok' END AS outcome FROM customer",
    "mode_expand_phrases": f"WITH {_s} " + " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS mode, id AS doc_id, md5({sq(r)}) AS hash FROM s" for (s, m), r in _phrased.items()),
}
