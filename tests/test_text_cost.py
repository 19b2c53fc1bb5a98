"""What text rules cost, told by a plain pass of one class over the same texts or by their plans, and that the cheaper forms say the same."""

import time

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.phrases import Phrases, _blanks
from quern.sources import corpus as C


@pytest.fixture(scope="module")
def texts(spark):
    """400 texts of 40,000 characters, of Latin words behind a Korean one."""
    own = spark.range(400, numPartitions=4).select("id", F.concat(F.lit("청구항 "), F.repeat(F.lit("Ein Wort über Geräte, und 12 more words here.\n"), 860)).alias("t")).cache()
    own.count()
    return own


def seconds(df, c) -> float:
    def once() -> float:
        at = time.perf_counter()
        df.select(F.length(c).alias("n")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - at

    return min(once() for _ in range(4))


def test_nfkc_does_not_try_every_range_on_stable_texts(spark, texts):
    """What nfkc looks for, found in its plan, takes well less than what the whole class takes."""
    plan = texts.select(T.nfkc("t").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    looked = next(p for p in (T.UNSTABLE, f"[^{T.STABLE}]") if p in plan)
    found = lambda p: F.when(F.col("t").rlike(p), "aa").otherwise("b")
    assert texts.where(F.col("t").rlike(looked)).isEmpty()
    assert seconds(texts, found(looked)) < 0.6 * seconds(texts, found(f"[^{T.STABLE}]"))


def test_unstable_is_what_stable_lacks(spark):
    points = [*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x2F800, 0x10FFFF]
    own = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    alone = own.where(F.col("c").rlike(f"[^{T.STABLE}]") != F.col("c").rlike(T.UNSTABLE))
    among = own.where(F.col("c").rlike(f"[^{T.STABLE}]") != F.concat(F.lit("가é a"), "c", F.lit("a가é")).rlike(T.UNSTABLE))
    assert alone.isEmpty() and among.isEmpty()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_texts_takes_its_rule_once_and_makes_no_string_of_a_letter(spark):
    pages = spark.createDataFrame([(1, 1, "가" * 400 + " x", "a"), (1, 2, "short", "b"), (1, 3, "", "c"), (1, 4, "  last\r\none ", "d"), (2, 1, None, "e")], "doc_id long, page int, text string, image string")
    for least, expected in ((0, "가" * 400 + " x\n\nocr b\n\nlast\none"), (6, "가" * 400 + " x\n\nlast\none")):
        own = C.page_texts(pages, lambda i: F.concat(F.lit("ocr "), i), "ver1", least=least)
        assert plan(own).count(T.UNSTABLE) == 1 and "regexp_extract_all" not in plan(own)
        assert {r["doc_id"]: r["text"] for r in own.collect()} == {1: expected} | ({2: "ocr e"} if least == 0 else {})


def test_v2_abstract_splits_once_and_makes_no_string_of_a_letter(spark, texts):
    own = plan(texts.select(T.v2_abstract("t").alias("t")))
    assert own.count("split(") == 1 and own.count(T.UNSTABLE) == 1 and "regexp_extract_all" not in own
    odd = spark.createDataFrame([("요약: One. 2, 3! \n\n a b\tGPU? five5s.\r\nEnds here",), ("1 2. 3",), ("ab. a_b-c. GAN",)], "t string")
    assert [r[0] for r in odd.select(T.v2_abstract("t")).collect()] == ["a b GPU? five5s. Ends here", "1 2. 3", "a_b-c. GAN"]
    assert [r[0] for r in odd.select(T.content_score("t")).collect()] == [23, 0, 10]


def test_v2_claims_cuts_a_line_once(spark, texts):
    own = plan(texts.select(T.v2_claims("t").alias("t")))
    assert own.count("split(") == 2 and "regexp_extract_all" not in own
    odd = spark.createDataFrame([("청구항 1. 상기 long enough; no; a GPU\n\n청구항 2 삭제 제 3 항: 청구항 1에 있어서, x y",)], "t string")
    assert [r[0] for r in odd.select(T.v2_claims("t")).collect()] == ["long enough; a GPU\nx y"]


def test_v1_claims_looks_only_where_a_rule_has_something_to_change(spark, texts):
    own = plan(texts.select(T.v1_claims("t").alias("t")))
    assert "(?=(?:^|" not in own and own.lower().count("contains(") > 20
    odd = spark.createDataFrame([("청구항 1. a  b ;c\u3000d\n \n청구항 2 삭제\n제 3 항. 제1항에 있어서, e 것을 특징으로 하는 1)x ② y",), ("\n청구항 7: z",)], "t string")
    assert [r[0] for r in odd.select(T.v1_claims("t")).collect()] == ["a b; c d\ne; 1) x 2 y", "z"]


def test_embedding_text_passes_over_patterns_that_it_does_not_hold(spark, texts):
    own = plan(texts.select(T.clean_for_embedding("t").alias("t")))
    assert own.lower().count("contains(") == len(T.COMMON_PATTERNS)
    odd = spark.createDataFrame([("본  발명 제 1 항 İst Ｋa 도 2 장치 회로 가 [0001] a-bc 대 표\n도 x",)], "t string")
    assert [r[0] for r in odd.select(T.clean_for_embedding("t")).collect()] == ["st ka 회로 bc"]


def test_phrases_are_sought_among_their_own_characters():
    """A look at a Latin text takes well less than folding it and sending all of it through the automaton."""
    own, text = Phrases(T.phrases_of("abstract", "conservative")), "본발명은 " + "Ein Wort über Geräte, und 12 more words here.\n" * 40_000 + "를\u3000제공한다"

    def best(f) -> float:
        def once() -> float:
            at = time.perf_counter()
            f()
            return time.perf_counter() - at

        return min(once() for _ in range(3))

    assert best(lambda: own.held(text)) < 0.6 * best(lambda: list(own.machine.iter(_blanks.sub("", text).casefold())))
    assert own.remove(text) == "  " + "Ein Wort über Geräte, und 12 more words here.\n" * 40_000 + " "
    assert Phrases(["Of The", "및"]).remove("x oF\ntHE 및 y") == "x     y"
