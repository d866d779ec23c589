import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.operators import embedding, fusion
from helpers import chunk, results

HIT = "query_id string, chunk_id string, rank int"


def hits(spark, *lists):
    return spark.createDataFrame([(f"q{i}", c, r) for i, l in enumerate(lists) for r, c in enumerate(l, 1)], HIT)


def fused(spark, dense, sparse):
    out = fusion.rrf_fuse(hits(spark, *dense), hits(spark, *sparse))
    return out.orderBy("query_id", "fused_rank").collect()


def test_golden_order(spark):
    rows = fused(spark, [["a", "b", "c"]], [["c", "d"]])
    assert [r.chunk_id for r in rows] == ["c", "a", "b", "d"]
    assert [round(r.rrf_score, 6) for r in rows] == [0.032266, 0.016393, 0.016129, 0.016129]
    assert [r.source for r in rows] == ["both", "dense", "dense", "sparse"]


def test_shared_id_and_low_scores(spark):
    (row,) = fused(spark, [["x"]], [["x"]])
    assert math.isclose(row.rrf_score, 2 / 61) and row.source == "both"
    rows = fused(spark, [[f"d{i}" for i in range(45)]], [["z"]])
    assert max(r.dense_rank or 0 for r in rows) == 40


def test_missing_ids_get_a_key(spark):
    rows = fused(spark, [[None, "a"]], [["a", None]])
    assert {r.chunk_id for r in rows} == {"dense_1", "a", "sparse_2"}


ids = st.lists(st.integers(0, 30).map(lambda i: f"c{i:02d}"), max_size=30, unique=True)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(ids, ids), min_size=1, max_size=12))
def test_random_lists(spark, pairs):
    got = {}
    for r in fused(spark, [d for d, _ in pairs], [s for _, s in pairs]):
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.rrf_score, 12)))
    for i, (dense, sparse) in enumerate(pairs):
        order = dense + [c for c in sparse if c not in dense]
        score = {c: sum(1 / (61 + l.index(c)) for l in (dense, sparse) if c in l) for c in order}
        want = sorted(order, key=lambda c: -score[c])
        assert got.get(f"q{i}", []) == [(c, round(score[c], 12)) for c in want]


def quality_of(spark, chunks, dense=5, sparse=5, reranked=True):
    df = results(spark, ("q", chunks, {"total_dense_hits": dense, "total_sparse_hits": sparse, "reranker_used": reranked}))
    return df.select(
        fusion.quality(F.col("chunks"), F.col("total_dense_hits"), F.col("total_sparse_hits"), F.col("reranker_used"))
    ).first()[0]


def test_quality(spark):
    assert round(quality_of(spark, [chunk(f"c{i}") for i in range(7)]), 6) == 0.892423
    assert quality_of(spark, []) == 0.0
    assert round(quality_of(spark, [chunk(source="dense", rerank_score=0.0)], sparse=0), 6) == round(0.2 + 0.1 / 7, 6)
    assert round(quality_of(spark, [chunk(source="sparse")], reranked=False), 6) == round(0.3 + 0.1 / 7, 6)
    assert quality_of(spark, [chunk(rerank_score=500.0) for _ in range(20)]) == 1.0


def cands(spark, rows):
    return spark.createDataFrame(
        [(q, "shed roof", c, text, place, k) for q, c, text, place, k in rows],
        "query_id string, query string, chunk_id string, text string, place int, top_k int",
    )


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "final_rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.rerank_score, r.reranked))
    return out


def test_rerank_orders_cuts_and_falls_back(spark):
    df = cands(spark, [("q1", "a", "wall", 1, 2), ("q1", "b", "shed roof", 2, 2), ("q1", "c", "shed", 3, 2), ("q2", "d", "shed roof", 1, 5)])
    got = ranked(fusion.rerank(df))
    assert got["q1"] == [("b", 5.0, True), ("c", 0.0, True)]
    assert got["q2"] == [("d", 0.0, False)]
    assert [c for c, _, _ in ranked(fusion.rerank(df, enabled=False))["q1"]] == ["a", "b"]
    without = ranked(fusion.rerank(df, embedding.model_scorer()))
    assert without["q1"] == [("a", 0.0, True), ("b", 0.0, True)]
    fake = embedding.model_scorer(lambda: lambda pairs: [len(t) for _, t in pairs])
    assert [c for c, _, _ in ranked(fusion.rerank(df, fake))["q1"]] == ["b", "a"]


def test_rerank_reads_only_the_start(spark):
    df = cands(spark, [("q1", "a", "x" * 512 + " shed roof", 1, 5), ("q1", "b", "roof", 2, 5)])
    assert [c for c, _, _ in ranked(fusion.rerank(df))["q1"]] == ["b", "a"]


def test_context_string(spark):
    df = results(spark, ("q", [chunk(), chunk("c2", "Other text", None, effective_date=None, jurisdiction=None, confidence=None)], {}), ("e", [], {}))
    first, empty = [r[0] for r in df.orderBy("query_id").select(fusion.context_string(F.col("chunks"))).collect()]
    assert first == (
        "[CHUNK 1]\nSource: PDR 2001 Schedule 2\nSection: Class 1\nJurisdiction: national\nEffective: 2001-10-01\n"
        "Confidence: high\n---\nClass 1 extension up to 40 square metres is exempt.\n"
        "\n\n[CHUNK 2]\nSource: PDR 2001 Schedule 2\nSection: N/A\nJurisdiction: national\nEffective: N/A\n"
        "Confidence: medium\n---\nOther text\n"
    )
    assert empty == "No relevant planning law chunks found."


def test_entity_set(spark):
    text = "Up to 40 Square Metres, 2.5 metres, 12 sq. m under S.I. No. 600 of 2001 but s.i. no. 7 of 1999"
    df = results(spark, ("q", [chunk("a", text, "Class 1 | S.I. No. 600 of 2001", jurisdiction="Kerry")], {}))
    assert set(df.select(fusion.entity_set(F.col("chunks"))).first()[0]) == {
        "class 1", "s.i. no. 600 of 2001", "kerry", "40 square metres", "2.5 metres", "12 sq. m",
    }


def test_accessors_and_top(spark):
    df = results(spark, ("q", [chunk(None, section_ref=None, source_title=None, jurisdiction=None, confidence=None, is_stale=None)], {}), ("e", [], {}))
    c = F.col("chunks")[0]
    names = ("chunk_id", "section_ref", "source_title", "jurisdiction", "confidence", "is_stale")
    row = df.where("size(chunks) > 0").select(*[fusion.accessor(c, n).alias(n) for n in names]).first()
    assert tuple(row) == ("", "", "", "national", "medium", False)
    tops = df.orderBy("query_id").select(fusion.top_chunk(F.col("chunks")).alias("t"), fusion.is_empty(F.col("chunks"))).collect()
    assert tops[0].t.source == "both" and tops[1].t is None and [r[1] for r in tops] == [False, True]


def test_explain(spark):
    rows = fusion.explain_result(results(spark, ("q", [chunk(), chunk("c2", section_ref="")], {}))).collect()
    assert [(r["rank"], r.rrf, r.rerank, r.section) for r in rows] == [(1, 0.02, "5.00", "Class 1"), (2, 0.02, "5.00", "—")]
    assert rows[0].preview == "Class 1 extension up to 40 square metres is e..."
