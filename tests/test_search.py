"""Keyword and vector search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import index, search
from clausewright.schema import NATIONAL

WORDS = "shed porch wall fence solar roof road site class permit zone plan".split()


def corpus(n=60):
    rng = np.random.default_rng(3)
    weights = np.array([12, 6, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1], dtype=float)
    texts = [" ".join(rng.choice(WORDS, size=rng.integers(1, 30), p=weights / weights.sum())) for _ in range(n)]
    texts[7] = texts[8] = texts[9]
    texts[11] = ""
    return [(f"c{i:03d}", t) for i, t in enumerate(texts)]


def tokens(text):
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text.lower())


def brute_idf(docs):
    df = Counter(t for _, text in docs for t in set(tokens(text)))
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    return {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}


def brute_bm25(docs, query):
    idf = brute_idf(docs)
    average = sum(len(tokens(t)) for _, t in docs) / len(docs)
    scores = {}
    for cid, text in docs:
        tf, dl = Counter(tokens(text)), len(tokens(text))
        scores[cid] = sum(
            idf.get(t, 0.0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / average)) for t in tokens(query)
        )
    return sorted(((c, round(s, 6)) for c, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))


QUERIES = [("q1", "solar roof roof class"), ("q2", "shed"), ("q3", "unknown words"), ("q4", "S.I. plan, zone shed porch")]


@pytest.fixture(scope="module")
def setup(spark):
    docs = corpus()
    chunks = spark.createDataFrame(docs, "chunk_id string, text string").withColumns(
        {
            "jurisdiction": F.when(F.substring("chunk_id", 4, 1) < "4", NATIONAL).otherwise("kerry"),
            "is_stale": F.lit(False),
        }
    )
    queries = spark.createDataFrame(QUERIES, "query_id string, query string").withColumn(
        "jurisdiction", F.lit(None).cast("string")
    )
    return docs, chunks, index.build_sparse_index(chunks), queries


def test_term_statistics(setup):
    docs, _, idx, _ = setup
    got = {r.term: r.idf for r in idx.term_stats.collect()}
    want = brute_idf(docs)
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], abs_tol=1e-9) for t in want)
    postings = {(r.term, r.chunk_id): r.tf for r in idx.postings.collect()}
    assert postings == {(t, c): n for c, text in docs for t, n in Counter(tokens(text)).items()}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


@pytest.mark.parametrize("salted", [False, True])
def test_bm25_matches_brute_force(setup, monkeypatch, salted):
    docs, chunks, idx, queries = setup
    if salted:
        monkeypatch.setattr(search, "BROADCAST_QUERY_TERMS", 0)
    got = by_query(search.sparse_search(idx, chunks, queries, n=100))
    assert got == {q: brute_bm25(docs, text) for q, text in QUERIES if brute_bm25(docs, text)}
    assert "q3" not in got


def test_filter_comes_after_the_cut(setup):
    docs, chunks, idx, queries = setup
    wanted = queries.withColumn("jurisdiction", F.lit("kerry"))
    flagged = chunks.withColumn("is_stale", F.col("chunk_id") == "c009")
    where = {r.chunk_id: r.jurisdiction for r in chunks.collect()}
    for n in (3, 10):
        got = by_query(search.sparse_search(idx, flagged.withColumn("jurisdiction", F.when(F.col("jurisdiction") == "kerry", "cavan").otherwise(F.col("jurisdiction"))), wanted, n=n))
        for q, text in QUERIES:
            top = brute_bm25(docs, text)[: 2 * n]
            assert got.get(q, []) == [(c, s) for c, s in top if where[c] == NATIONAL and c != "c009"][:n]


def vector_rows(spark, n=300):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, 8))
    v[10] = v[20] = v[30]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    places = ["national", "kerry", "cavan"]
    types = ["primary_act", "exemption_schedule"]
    rows = [(f"v{i:04d}", v[i].tolist(), places[i % 3], types[i % 2], i % 17 == 0) for i in range(n)]
    return rows, spark.createDataFrame(
        rows, "chunk_id string, embedding array<double>, jurisdiction string, document_type string, is_stale boolean"
    ).repartition(5)


@pytest.mark.parametrize("block", [64, 3])
def test_dense_matches_brute_force(spark, block):
    rows, vectors = vector_rows(spark)
    rng = np.random.default_rng(6)
    asks = [
        (f"q{i}", (rng.normal(size=8) * 3).tolist() if i else rows[10][1], [None, "kerry", "national"][i % 3], [None, "exemption_schedule"][i % 2])
        for i in range(9)
    ]
    queries = spark.createDataFrame(asks, "query_id string, embedding array<double>, jurisdiction string, doc_type string")
    got = by_query(search.dense_search(vectors, queries, n=12, block=block))
    for qid, e, place, kind in asks:
        e = np.array(e) / np.linalg.norm(e)
        want = [
            (c, round(float(np.dot(v, e)), 6))
            for c, v, j, t, stale in rows
            if not stale and (place is None or j in (place, "national")) and (kind is None or t == kind)
        ]
        want = sorted(want, key=lambda x: (-x[1], x[0]))[:12]
        assert [c for c, _ in got[qid]] == [c for c, _ in want]
        assert np.allclose([s for _, s in got[qid]], [s for _, s in want], atol=1.1e-6)


def test_vectors_of_another_width_are_not_compared(spark):
    kind = "chunk_id string, embedding array<double>, jurisdiction string, document_type string, is_stale boolean"
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0], "national", "t", False), ("b", None, "national", "t", False), ("c", [1.0, 0.0, 0.0], "national", "t", False)], kind
    )
    asks = [("q2", [2.0, 0.0], None, None), ("q3", [0.0, 0.0, 1.0], None, None), ("none", None, None, None), ("empty", [], None, None)]
    queries = spark.createDataFrame(asks, "query_id string, embedding array<double>, jurisdiction string, doc_type string")
    for block in (64, 1):
        assert by_query(search.dense_search(vectors, queries, block=block)) == {"q2": [("a", 1.0)], "q3": [("c", 0.0)]}


def test_keyword_scores_in_small_steps(setup, monkeypatch):
    docs, chunks, idx, queries = setup
    monkeypatch.setattr(search, "SCORE_CELLS", 7)
    got = by_query(search.sparse_search(idx, chunks, queries, n=2))
    assert got == {q: brute_bm25(docs, text)[:2] for q, text in QUERIES if brute_bm25(docs, text)}


def test_dense_without_queries(spark):
    _, vectors = vector_rows(spark, 40)
    none = spark.createDataFrame([], "query_id string, embedding array<double>, jurisdiction string, doc_type string")
    assert search.dense_search(vectors, none).count() == 0


def test_boost_is_appended_after_own_hits(spark):
    dense = spark.createDataFrame([("q1", "a", 0.9, 1), ("q1", "b", 0.8, 2), ("q2", "c", 0.7, 1)], "query_id string, chunk_id string, score double, rank int")
    boost = spark.createDataFrame([("b", 0.6, 1), ("x", 0.5, 2), ("y", 0.4, 3)], "chunk_id string, score double, rank int")
    asks = spark.createDataFrame([("q1", "A SHED extension"), ("q2", "roads"), ("q3", "my porch")], "query_id string, query string")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.boosted) for r in search.append_boost(dense, asks, boost).collect())
    assert got == [
        ("q1", 1, "a", False), ("q1", 2, "b", False), ("q1", 3, "x", True), ("q1", 4, "y", True),
        ("q2", 1, "c", False),
        ("q3", 1, "b", True), ("q3", 2, "x", True), ("q3", 3, "y", True),
    ]


@pytest.mark.parametrize("block", [64, 2])
def test_dense_limits_are_kept_exactly(spark, block):
    rows, vectors = vector_rows(spark, 120)
    asks = [(f"q{i}", rows[10 + i][1], None, None, fetch) for i, fetch in enumerate((1, 5, 30, 50, 500))]
    kind = "query_id string, embedding array<double>, jurisdiction string, doc_type string, fetch int"
    queries = spark.createDataFrame(asks, kind)
    whole = by_query(search.dense_search(vectors, queries.drop("fetch"), n=500, block=block))
    there = sum(not r[4] for r in rows)
    assert {q: len(v) for q, v in whole.items()} == {f"q{i}": there for i in range(5)}
    for n in (1, 5, 50):
        got = by_query(search.dense_search(vectors, queries.drop("fetch"), n=n, block=block))
        assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v[:n]] for q, v in whole.items()}
    got = by_query(search.dense_search(vectors, queries, n=3, block=block))
    assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in whole[q][: asks[i][4]]] for i, q in enumerate(sorted(whole))}
