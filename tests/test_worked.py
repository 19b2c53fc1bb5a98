"""Rules on short Korean sentences with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.headings import with_sections
from quern.operators import app as A
from quern.sources import corpus as C
from quern.sources.hooks import text_hook


def _pairs(m: F.Column) -> F.Column:
    """A map as text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k))), "|")


WORKED = {
    "phrases_conservative": (lambda x: T.preprocess_section(x, "abstract", "conservative"), [("본발명은 장치", "장치"), ("본 발명은  장치를 포함하는 것", "장치 것"), ("", "")]),
    "phrases_strong": (lambda x: T.preprocess_section(x, "claims", "strong"), [("상기 장치의 단계", "장치의"), ("제1항에 있어서 가", "가")]),
    "cleanup_claims": (lambda x: T.cleanup_artifacts(x, "claims"), [("[0001] 청구항 1 제 1 항에 있어서, - 3 - 장치", ", 장치"), ("등록특허 10-123  가", "가")]),
    "nfkc_basic": (T.normalize_basic, [("ＡＢ Ｃ\r\n\n\n\nｘ", "AB C\n\nx"), ("  가  ", "가"), (None, "")]),
    "query_clean": (T.clean_query, [("상기 AI 장치; 본 발명은 (가)!", "ai 장치; 가"), ("A-B_C/D", "a-b_c/d")]),
    "embedding_clean": (T.clean_for_embedding, [("본 발명 Neural 장치 10 학습 a 가", "neural 학습"), ("제 1 항 도 2 회로", "회로")]),
    "v1_common": (T.v1_common, [("가(100a) 나 (1)\r다​", "가 나 (1)\n다"), ("", "")]),
    "v1_abstract": (T.v1_abstract, [("본 발명은 가를 제공하는 데 그 목적이 있다.", "가를 제공한다."), ("가를 제공하는 것을 목적으로 한다", "가를 제공한다.")]),
    "v1_claims": (T.v1_claims, [("청구항 1. 가를 포함하는 것을 특징으로 하는 장치\n청구항 2 삭제\n제 3 항. 청구항 1에 있어서, 나", "가를 포함하는; 장치\n나")]),
    "v1_description": (T.v1_description, [("[0001] 도 1에 도시된 바와 같이, 본 발명의 일 실시예에 따른 가", "가"), ("【0012】 나  다", "나 다")]),
    "v2_abstract": (T.v2_abstract, [("요약: 가나다라마바사. 나. GPU. 둘째 문장입니다.", "가나다라마바사. GPU. 둘째 문장입니다."), ("가", "가")]),
    "v2_claims": (T.v2_claims, [("청구항 1: 상기 가나다라마바사아 회로; 짧다; GPU", "가나다라마바사아 회로; GPU"), ("짧다", "짧다")]),
    "v2_description": (T.v2_description, [("[0001] 도면의 간단한 설명\n도 1은 구성도이다.\n100: 회로\n본문 (100) 끝", "본문 끝")]),
    "legacy_normalize": (T.normalize_legacy, [("장치\n를 - 3 - 본다\n① 가", "장치를  본다\n가")]),
    "claims_split": (lambda x: _pairs(T.split_claims(x)), [("청구항 1 가를 포함한다. 청구항 2 청구항 1에 있어서, 나.", "청구항 1=에 있어서, 나.|청구항 2="), ("청구항 1 가", "청구항 1=가"), ("없음", None)]),
    "claims_fallback": (T.fallback_claims, [("앞 청 구 항 가나 발명의 설명 끝", "청 구 항 가나"), ("x What is claimed is a. Detailed description b", "What is claimed is a."), ("none", "")]),
    "claims_or_fallback": (lambda x: T.claims_or_fallback(x, F.lit("대신")), [("짧다", "대신"), ("가" * 300, "가" * 300)]),
    "detect_tables": (lambda x: F.array_join(T.tables(x), "|"), [("표 1 가\n나\n\n본문 표 2 다", "표 1 가\n나|표 2 다"), ("없음", "")]),
    "detect_equations": (lambda x: F.array_join(T.equations(x), "|"), [("수학식 1 a=b\n\n본문 수학식 2 c", "수학식 1 a=b|수학식 2 c")]),
    "description_block": (T.without_background, [("기술분야 가\n발명의 내용 " + "나" * 30 + "\n끝", "발명의 내용 " + "나" * 30 + "\n끝"), ("실시예 짧다\n 둘 ", "실시예 짧다\n둘"), ("실시예 " + "가" * 30 + "\n해결하려는 과제 " + "나" * 30, "해결하려는 과제 " + "나" * 30)]),
    "low_quality_hangul": (lambda x: T.low_quality(x).cast("string"), [("가" * 299, "true"), ("가" * 300, "false"), ("a" * 300, "true"), ("", "true"), (None, "true")]),
    "json_slice": (T.json_object, [('noise {"a":1} tail', '{"a":1}'), ("none", "")]),
    "title_maker": (T.title, [("가" * 20, "가" * 20), ("가" * 21, "가" * 20 + "…"), ("  ", "새 채팅"), (None, "새 채팅")]),
    "dependent_claim": (lambda x: T.renumber_dependent(x, F.lit(2)), [("제 3 항에 있어서, 가", "제2항. 제1항에 있어서, 가"), ("나", "제2항. 제1항에 있어서, 나")]),
    "caption_cleanup": (T.caption, [("USER: x ASSISTANT: a  b<end_of_utterance>", "a b"), (" c ", "c")]),
    "prompt_input": (lambda x: T.prompt_input(F.lit("가"), x), [("", "[사용자 텍스트 입력]\n가"), ("나", "[사용자 텍스트 입력]\n가\n\n[이미지 기반 도면 설명]\n이미지 d에 대한 설명: 나")]),
    "answer_format": (T.format_answer, [("장치 가\n다. 끝,\n나 [발명의 명칭] 장치", "장치 가다. 끝, 나 \n\n[발명의 명칭]\n 장치"), ("방법. 청구항 2 가나", "방법.\n\n청구항 2\n 가나"), ("가 - 나 - 다", "가\n- 나\n- 다")]),
    "answer_line_korean": (T.line_class, [("[발명의 명칭]", "ai-section-title"), ("청구항 1", "ai-claim-title"), ("청구항 1에 있어서, 가", "ai-paragraph"), ("1. 기술분야", "ai-sub-title"), ("가. 과제", "ai-sub-title"), ("- 항목", "ai-list-item"), ("문장", "ai-paragraph"), (" ", "break")]),
    "date_text": (T.date_text, [("2024-01-05T10:00:00", "2024. 1. 5."), ("soon", "soon"), (None, "-"), ("", "-")]),
    "password_policy": (lambda x: A.password_ok(x).cast("string"), [("abcd123!", "true"), ("abcd1234", "false"), ("ab1!", "false"), ("12345678!", "false")]),
    "code_shape": (lambda x: A.code_ok(x).cast("string"), [("012345", "true"), ("12345", "false"), ("12345a", "false")]),
    "not_blank": (lambda x: A.not_blank(x).cast("string"), [("a", "true"), (" 　", "false"), (None, "false")]),
    "input_type": (lambda x: T.input_type(x, F.lit(True)), [("a.PDF ", "pdf"), ("a text", "text")]),
}


@pytest.mark.parametrize("name", sorted(WORKED))
def test_worked(spark, name):
    rule, pairs = WORKED[name]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "id int, x string").select("id", rule(F.col("x")).alias("result")).orderBy("id").collect()
    assert [r["result"] for r in rows] == [w for _, w in pairs]


PATENT = "(57) 요 약\n본 장치.\n청구범위\n청구항 1\n가.\n발명의 설명\n기술분야\n나."


def test_sections(spark):
    df = spark.createDataFrame([(1, PATENT), (2, "없음"), (3, "발명의 명칭 가나 장치\n\n(57) 요약\nG06F 17/30")], "id int, text string")
    found = {r["id"]: tuple(r)[2:] for r in with_sections(df).collect()}
    assert found == {1: ("", "본 장치.", "청구범위\n청구항 1\n가.", "기술분야\n나.", ""), 2: ("",) * 5, 3: ("가나 장치", "", "", "", "G06F 17/30")}


def test_records(spark):
    rows = spark.createDataFrame([(0, '{"type": "Ai", "abstract": {"raw": "a", "clean": "b"}, "claims": {"raw": "c"}, "description": {"raw": "d"}}'), (1, "broken"), (2, '{"type": "Ai"}')], "id int, answer string")
    q = C.parsed_query(F.col("answer"), F.lit("input"))
    assert [tuple(r) for r in rows.orderBy("id").select(q["type"], q["abstract"]["raw"], q["claims"]["raw"]).collect()] == [("Ai", "a", "c"), ("Ai", "input", "input"), ("Ai", "input", "input")]
    one = spark.createDataFrame([(1, "발명의 명칭 가\n\n(57) 요약\n나.\n청구범위\n청구항 1\n다.\n발명의 설명\n기술분야\n라. 표 1 x")], "doc_id int, text string")
    r = C.section_records(one).first()
    assert (r["id"], r["title"], r["abstract"], r["claims"], r["description"], len(r["tables_raw"]), len(r["claims_structured"])) == (1, "가", "나.", "청구항 1\n다.", "기술분야\n라. 표 1 x", 1, 1)


def test_pages(spark):
    good = "가" * 300
    rows = spark.createDataFrame([(1, 1, good, "a"), (1, 2, "나", "b"), (1, 3, "다", "c"), (2, 1, good, "d")], "doc_id int, page int, text string, image string")
    assert {r["doc_id"]: len(r["text"].split("\n\n")) for r in C.page_texts(rows, text_hook()).collect()} == {1: 3, 2: 1}
