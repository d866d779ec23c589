import json

import pytest
from pyspark.sql import functions as F

from clausewright.operators import generation, prompts, providers
from helpers import chunk, results


def answer(spark, query="Is a garden shed exempt from planning?", chunks=None, provider=None, **over):
    df = results(spark, (query, [chunk()] if chunks is None else chunks, over))
    return generation.generate_answers(df, provider).withColumn("full", F.to_json("full_answer")).drop("full_answer").first()


TYPES = {
    "Is a garden shed exempt from planning?": "EXEMPTION",
    "Are SOLAR panels fine?": "EXEMPTION",
    "Do I need permission to extend my house?": "EXEMPTION",
    "the established rules": "EXEMPTION",
    "Is a conservatory allowed?": "ELIGIBILITY",
    "How do I appeal a planning decision?": "PROCESS",
    "How do I apply for planning permission?": "PROCESS",
    "What is a development plan?": "ELIGIBILITY",
}


def test_classifier(spark):
    df = spark.createDataFrame([(q,) for q in TYPES], "q string")
    assert {r.q: r.t for r in df.withColumn("t", generation.classify_query(F.col("q"))).collect()} == TYPES


def test_mock_exemption_golden(spark):
    r = answer(spark)
    assert r.query_type == "EXEMPTION" and round(r.confidence_score, 6) == 0.8  # 0.75, and 0.05 for both methods
    assert r.confidence == "high" and not r.is_blocked and r.block_reason == ""
    assert r.chunks_used == [1] and len(r.citations) == 1
    assert r.citations[0].source_title == "PDR 2001 Schedule 2" and r.citations[0].text_preview.endswith("exempt....")
    assert r.post_flags == []
    assert r.jurisdiction == "dublin_city" and r.llm_provider == "mock"


def test_blocked_before_generation(spark):
    r = answer(spark, chunks=[])
    assert r.is_blocked and r.query_type == "OTHER" and r.confidence == "blocked" and r.requires_escalation
    assert r.full == "{}" and r.citations == [] and r.block_reason != "" and r.answer_summary == r.user_warning
    assert r.jurisdiction == "national"


class Fixed:
    name = "fixed"

    def __init__(self, text):
        self.text = text

    def complete(self, system, prompt):
        return F.struct(F.lit(self.text).alias("text"), F.lit(None).cast("string").alias("error"))


def test_failing_provider_gives_an_error_row(spark):
    def make():
        def call(system, prompt):
            raise RuntimeError("no route")

        return call

    r = answer(spark, provider=providers.CallableProvider(make))
    assert r.is_blocked and r.confidence == "blocked" and r.confidence_score == 0.0
    assert json.loads(r.full) == {"error": "no route"} and r.block_reason == "LLM error: no route"
    assert not r.requires_escalation


def test_callable_provider_is_not_asked_about_blocked_rows(spark):
    provider = providers.CallableProvider(lambda: lambda system, prompt: json.dumps({"answer_summary": prompt[:7]}))
    df = results(spark, ("Is a shed exempt?", [chunk()], {}), ("Is a shed exempt?", [], {}))
    rows = generation.generate_answers(df, provider).drop("full_answer").orderBy("query_id").collect()
    assert rows[0].answer_summary == "CONTEXT" and rows[1].is_blocked
    assert rows[0].chunks_used == [] and rows[0].citations == []


PARSES = {
    '{"a": 1}': {"a": 1},
    ' \n{"a": 1}\n ': {"a": 1},
    'Here:\n```json\n{"a": 2}\n```': {"a": 2},
    '```\n{"a": 3}```': {"a": 3},
    'text {"a": {"b": 4}} text': {"a": {"b": 4}},
}


def parsed(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [json.loads(r[0]) for r in df.select(F.to_json(generation.parse_answer(F.col("t")))).collect()]


def test_parse_cascade(spark):
    assert parsed(spark, *PARSES) == list(PARSES.values())


def test_parse_fallback(spark):
    plain, empty, listed, null = parsed(spark, "this is not json at all", "", "[1, 2]", "null")
    assert plain["answer_summary"] == "this is not json at all"
    assert plain["confidence"] == "low" and plain["chunks_used"] == [1]
    assert set(plain) == {"answer_summary", "confidence", "chunks_used", "reasoning", "what_to_do_next"}
    assert empty["answer_summary"] == generation.FALLBACK_SUMMARY
    assert listed["answer_summary"] == "1, 2" and null["answer_summary"] == "null"
    (long,) = parsed(spark, "{" + "x" * 500)
    assert long["answer_summary"] == "x" * 299 and long["reasoning"][0]["point"] == "{" + "x" * 399


def test_odd_answers(spark):
    r = answer(spark, provider=Fixed('{"chunks_used": [0, 1, 1, 2, -1], "confidence": "certain"}'))
    assert r.answer_summary == generation.DEFAULT_SUMMARY and [c.chunk_num for c in r.citations] == [1, 1]
    assert r.confidence == "medium"
    assert answer(spark, provider=Fixed('{"chunks_used": "all"}')).chunks_used == []


@pytest.mark.parametrize(
    "pair,lowest",
    [(("high", "medium"), "medium"), (("high", "blocked"), "blocked"), (("medium", "medium"), "medium"), (("high", "low"), "low"), (("odd", "high"), "medium"), ((None, "high"), "medium")],
)
def test_lowest_confidence(spark, pair, lowest):
    df = spark.createDataFrame([pair], "a string, b string")
    assert df.select(generation.lowest_confidence(F.col("a"), F.col("b"))).first()[0] == lowest


def test_prompt_is_filled_once(spark):
    df = spark.createDataFrame([("EXEMPTION", "has {query} inside", "a {context} question", "kerry")], "t string, c string, q string, j string")
    text = df.select(prompts.build_prompt(*[F.col(c) for c in "tcqj"])).first()[0]
    assert "has {query} inside" in text and "a {context} question" in text and "COUNCIL: kerry" in text
    assert "is_exempt" in text and "permission_required" not in text
    assert "{{" in prompts.SYSTEM_PROMPT


def test_provider_names():
    assert providers.provider_by_name("whatever").name == "mock"
    assert providers.provider_by_name("ollama").name == "ollama"
    with pytest.raises(ValueError):
        providers.provider_by_name("anthropic")


def test_display(spark):
    shown = generation.display(generation.generate_answers(results(spark, ("Is a shed exempt?", [chunk()], {}))))
    assert shown.columns == [
        "query_id", "query", "query_type", "summary", "answer", "citations", "confidence", "warning", "disclaimer",
        "escalation", "is_blocked", "block_reason",
    ]


def test_ungrounded_answer_golden(spark):
    text = '{"answer_summary": "See Schedule 2 and Section 5; 40 sq m apply.", "confidence": "high", "chunks_used": [1]}'
    r = answer(spark, provider=Fixed(text))
    assert r.post_flags == ["UNGROUNDED_SECTION_REFERENCE", "UNGROUNDED_NUMERIC_THRESHOLD"] and r.confidence == "low"


def test_json_steps_reject_what_follows(spark):
    texts = ['{"a": 1} and {"b": 2}', '[1] {"confidence": "high"}', '{"confidence": "low"}] x', 'so: {"confidence": "high"} ok', "{}, 1", '```json\n{"confidence": "low"}\n``` {"a": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", generation.parse_answer(F.col("t")))
    got = df.select("i", generation.answer_field(F.col("p"), "confidence", "string").alias("c"), generation.answer_field(F.col("p"), "what_to_do_next", "string").alias("n"))
    rows = {r.i: (r.c, r.n is not None) for r in got.collect()}
    assert rows == {0: ("low", True), 1: ("high", False), 2: ("low", False), 3: ("high", False), 4: (None, False), 5: ("low", False)}
