from pyspark.sql import functions as F

from clausewright.operators import checking
from helpers import chunk, results


def report(spark, query="Do I need planning permission?", chunks=None, text=None, **over):
    df = results(spark, (query, [chunk()] if chunks is None else chunks, {"generated": text, **over}))
    return checking.check_answers(df, "generated").first().report


def codes(r):
    return [f.code for f in r.flags]


def test_empty_retrieval_blocks(spark):
    r = report(spark, "an appeal", [], "Class 99")
    assert r.is_blocked and r.confidence_score == 0.0 and codes(r) == ["NO_CHUNKS_RETRIEVED"]
    assert not r.requires_escalation and r.flags[0].severity == "block"
    assert r.user_warning == checking.WARNINGS["blocked"] and r.status == "BLOCKED"


def test_good_retrieval_passes(spark):
    r = report(spark, retrieval_quality=0.8)
    assert not r.is_blocked and codes(r) == [] and abs(r.confidence_score - 0.85) < 1e-9
    assert r.confidence_label == "high" and r.user_warning == checking.WARNINGS["default"]


def test_stale_chunk_blocks_but_later_checks_run(spark):
    r = report(spark, "enforcement notice", [chunk(is_stale=True), chunk(needs_reverification=True)])
    assert r.is_blocked and codes(r) == ["STALE_CHUNKS_IN_CONTEXT", "CHUNKS_NEED_REVERIFICATION", "ESCALATION_REQUIRED"]
    assert r.flags[0].detail == "1 stale chunks detected"


def test_escalation(spark):
    for query in ("How do I APPEAL?", "enforcement notice", "Apply for a Section 5 Declaration", "An Bord Pleanála"):
        r = report(spark, query)
        assert r.requires_escalation and r.user_warning == checking.WARNINGS["escalation"]
    first = report(spark, "compensation after an appeal")
    assert codes(first) == ["ESCALATION_REQUIRED"] and "'appeal'" in first.escalation_reason
    assert not report(spark, "a shed").requires_escalation


def test_low_quality_and_single_method(spark):
    r = report(spark, retrieval_quality=0.1, total_sparse_hits=0)
    assert codes(r) == ["LOW_RETRIEVAL_QUALITY", "SINGLE_METHOD_RETRIEVAL"]
    assert r.flags[0].detail == "Quality score: 0.10" and r.flags[1].detail == "Dense: 5 | Sparse: 0"
    assert r.confidence_score == 0.0 and r.confidence_label == "blocked" and not r.is_blocked
    assert r.user_warning == checking.WARNINGS["default"]


def test_reference_grounding(spark):
    r = report(spark, text="See Class 99 and class 99, schedule 2")
    assert r.ungrounded_claims == ["Class 99", "class 99", "schedule 2"]
    assert codes(r) == ["UNGROUNDED_SECTION_REFERENCE"]
    assert r.flags[0].detail == "Ungrounded: ['Class 99', 'class 99', 'schedule 2']"
    assert report(spark, text="Class 1 allows 40 square metres").flags == []
    inside = report(spark, chunks=[chunk(section_ref="Class 10")], text="Class 1")
    assert inside.ungrounded_claims == []


def test_numeric_grounding(spark):
    r = report(spark, chunks=[chunk(text="within 12 weeks")], text="2 weeks, 3 days and 60 sq m")
    assert r.ungrounded_claims == ["60 sq m", "3 days"]
    assert codes(r) == ["UNGROUNDED_NUMERIC_THRESHOLD"] * 2
    assert abs(r.confidence_score - (0.75 - 0.2 - 0.16 + 0.05)) < 1e-9


def test_text_is_optional(spark):
    for text in (None, ""):
        r = report(spark, text=text)
        assert r.flags == [] and r.grounded_entities == []
    assert "class 1" in report(spark, text="x").grounded_entities


def test_labels_at_the_thresholds(spark):
    df = spark.createDataFrame([(0.75,), (0.7499,), (0.5,), (0.4999,), (0.3,), (0.2999,)], "s double")
    got = [r[0] for r in df.select(checking.confidence_label(F.col("s"))).collect()]
    assert got == ["high", "medium", "medium", "low", "low", "blocked"]
