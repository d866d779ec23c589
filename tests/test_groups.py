"""Grouped vectors and grouped term lists: the same hits as a scan of everything, from fewer groups."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clausewright.operators import impacts, index, search, vectors
from clausewright.operators.embedding import hashing_embedder
from clausewright.operators.sizing import materialise
from clausewright.plans import knowledge
from clausewright.plans.knowledge import KnowledgeBase
from helpers import records

ASKS = "query_id string, embedding array<double>, jurisdiction string, doc_type string, fetch int"


def clustered(rng, n, width=8, hubs=12):
    middle = np.random.default_rng(1).normal(size=(hubs, width))
    x = middle[rng.integers(0, hubs, n)] + 0.05 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_table(spark, x):
    n = len(x)
    frame = pd.DataFrame(
        {
            "chunk_id": [f"v{i:05d}" for i in range(n)],
            "embedding": list(x),
            "jurisdiction": [["national", "kerry", "cavan", None][i % 4] for i in range(n)],
            "document_type": [["primary_act", "abp_decision"][i % 2] for i in range(n)],
            "is_stale": [i % 13 == 0 for i in range(n)],
        }
    )
    return spark.createDataFrame(frame).repartition(4)


def counted(monkeypatch, module):
    """Counts the pairs of a query and a group that are scored."""
    sizes, score = [], module.score_pairs

    def spy(groups, pairs, *rest):
        sizes.append(pairs.selectExpr("sum(size(rows))").first()[0] if "rows" in pairs.columns else pairs.count())
        return score(groups, pairs, *rest)

    monkeypatch.setattr(module, "score_pairs", spy)
    return sizes


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def brute(x, asks, n):
    out = []
    for qid, vector, place, kind, fetch in asks:
        q = np.array(vector) / np.linalg.norm(vector)
        fits = [
            i for i in range(len(x))
            if i % 13 and (place is None or ["national", "kerry", "cavan", None][i % 4] in (place, "national"))
            and (kind is None or ["primary_act", "abp_decision"][i % 2] == kind)
        ]
        best = sorted((-round(float(x[i] @ q), 6), f"v{i:05d}") for i in fits)[:fetch]
        out += [(qid, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows,slices", [(64, 10_000), (64, 20)])
def test_groups_give_the_hits_of_a_scan_and_skip_groups(spark, monkeypatch, rows, slices):
    monkeypatch.setattr(vectors, "GROUP_ROWS", rows)
    rng = np.random.default_rng(2)
    x = clustered(rng, 1500)
    x[5] = x[77] = x[901]
    x[40] = 0
    asks = [(f"q{k}", v.tolist(), [None, "kerry", "national"][k % 3], [None, "abp_decision"][k % 2], 1 + k % 9) for k, v in enumerate(clustered(rng, 40))]
    asks.append(("all", x[5].tolist(), None, None, 5000))
    index_ = vectors.stored_groups(vector_table(spark, x))
    monkeypatch.setattr(vectors, "META_ROWS", slices)
    sizes = counted(monkeypatch, vectors)
    queries = spark.createDataFrame(asks[:-1], ASKS)
    got = as_rows(search.grouped_search(index_, queries))
    assert [g[:3] for g in got] == [w[:3] for w in brute(x, asks[:-1], 9)]
    n = index_.groups.count()
    if slices > n:
        assert n > 15 and sum(sizes) < n * 40 / 2
    whole = as_rows(search.grouped_search(index_, spark.createDataFrame(asks[-1:], ASKS)))
    assert [g[:3] for g in whole] == [w[:3] for w in brute(x, asks[-1:], 9)]


def test_many_queries_in_passes_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = clustered(rng, 2000, width=4)
    q = clustered(rng, 4_000, width=4)
    frame = pd.DataFrame({"query_id": [f"q{k}" for k in range(len(q))], "embedding": list(q)})
    none = F.lit(None).cast("string")
    queries = spark.createDataFrame(frame).withColumns({"jurisdiction": none, "doc_type": none})
    monkeypatch.setattr(vectors, "QUERY_BYTES", 60_000)
    got = search.dense_search(vector_table(spark, x), queries, n=3).toPandas().set_index(["query_id", "rank"]).score
    live = x[np.arange(len(x)) % 13 > 0]
    best = -np.sort(-np.round(q @ live.T, 6), axis=1)[:, :3]
    assert len(got) == 3 * len(q)
    for k in range(0, len(q), 97):
        assert np.allclose([got[f"q{k}", r] for r in (1, 2, 3)], best[k], atol=1.1e-6)


def test_widths_nulls_and_empty_tables(spark):
    kind = "chunk_id string, embedding array<double>, jurisdiction string, document_type string, is_stale boolean"
    rows = [("a", [1.0, 0.0], None, None, False), ("b", None, "national", "t", False), ("c", [1.0, 0.0, 0.0], "national", "t", False), ("d", [], "national", "t", False)]
    table = spark.createDataFrame(rows, kind)
    asks = spark.createDataFrame([("q2", [2.0, 0.0], None, None, 5), ("q3", [0.0, 0.0, 1.0], "kerry", "t", 5), ("none", None, None, None, 5), ("zero", [1.0, 0.0], None, None, 0)], ASKS)
    found = vectors.stored_groups(table)
    assert as_rows(search.grouped_search(found, asks)) == [("q2", 1, "a", 1.0), ("q3", 1, "c", 0.0)]
    assert search.grouped_search(found, asks.limit(0)).isEmpty()
    assert search.grouped_search(vectors.stored_groups(table.limit(0)), asks).isEmpty()


def texts(n):
    rng = np.random.default_rng(4)
    topics = [[f"t{t}w{k}" for k in range(30)] for t in range(15)]
    out = []
    for i in range(n):
        own = topics[(i // 40) % 15]
        out.append((f"c{i:05d}", " ".join([*rng.choice(own, 3 + (i // 40) % 15), *rng.choice(["the", "of"], 2)])))
    out[3], out[4] = ("c00003", out[5][1]), ("c00004", "")
    return out


def test_term_groups_give_the_hits_of_a_scan_and_skip_groups(spark, monkeypatch):
    docs = spark.createDataFrame(texts(1200), "chunk_id string, text string")
    built = index.build_sparse_index(docs, keep=True)
    asks = spark.createDataFrame(
        [(f"q{k}", f"t{k}w1 t{k}w2 t{k}w2 the t{(k * 7) % 15}w3") for k in range(15)] + [("common", "the of"), ("nothing", "zzz"), ("null", None)],
        "query_id string, query string",
    )
    scan = search.sparse_hits(built, asks, 10)
    order = (F.desc("score"), F.asc("chunk_id"))
    want = as_rows(search.ranked(scan, 10, *order))
    monkeypatch.setattr(impacts, "GROUP_ROWS", 16)
    groups = materialise(impacts.group_documents(built.documents))
    grouped = index.SparseIndex(built.documents, built.postings, built.term_stats, built.corpus, groups)
    sizes = counted(monkeypatch, impacts)
    assert as_rows(search.ranked(search.sparse_hits(grouped, asks, 10), 10, *order)) == want
    matching = groups.count() * 16
    assert sum(sizes) < matching / 2
    monkeypatch.setattr(impacts, "PASS_TERMS", 9)
    monkeypatch.setattr(impacts, "CELLS", 40)
    assert as_rows(search.ranked(search.sparse_hits(grouped, asks, 10), 10, *order)) == want
    assert search.sparse_hits(grouped, asks.limit(0), 10).isEmpty()


def test_groups_of_no_documents(spark):
    built = index.build_sparse_index(spark.createDataFrame([], "chunk_id string, text string"), keep=True)
    grouped = index.SparseIndex(built.documents, built.postings, built.term_stats, built.corpus, materialise(impacts.group_documents(built.documents)))
    asks = spark.createDataFrame([("q", "shed")], "query_id string, query string")
    assert search.sparse_hits(grouped, asks, 5).isEmpty()


def test_stored_groups_follow_the_batches(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), hashing_embedder(16))
    words = "shed porch wall fence solar roof road site".split()
    rows = [{"chunk_id": f"c{i}", "text": " ".join(words[(i + k * (i % 3 + 1)) % 8] for k in range(6)) + f" number{i % 5}", "expiry_date": dt.date(2024, 2, 1 + i % 3) if i % 4 == 0 else None} for i in range(40)]
    kb.add_chunks(records(spark, *rows[:25]), "2024-02-01")
    kb.add_chunks(records(spark, *rows[15:]), "2024-02-01")
    kb.add_chunks(records(spark, {"chunk_id": "c7", "text": "an amended text about a garage and a porch"}), "2024-02-01", overwrite=True)
    asks = spark.createDataFrame([("a", "shed porch"), ("b", "garage"), ("c", "number3 fence")], "query_id string, query string")
    asks = asks.withColumns({"jurisdiction": F.lit(None).cast("string"), "doc_type": F.lit(None).cast("string"), "embedding": kb.embed(F.col("query"))})
    for day in ("2024-02-01", "2024-02-02", "2024-02-04"):
        plain, grouped = search.vector_search(kb.vectors(day), asks, 8), search.vector_search(kb.vector_groups(day), asks, 8)
        assert as_rows(grouped) == as_rows(plain)
    chunks = kb.fresh_chunks("2024-02-01")
    assert as_rows(search.sparse_search(kb.sparse_index(grouped=True), chunks, asks)) == as_rows(search.sparse_search(kb.sparse_index(grouped=False), chunks, asks))
    assert not isinstance(kb.searchable(), vectors.VectorGroups) and kb.sparse_index().groups is None
    monkeypatch.setattr(knowledge, "GROUPED_FROM", 40)
    assert isinstance(kb.searchable(), vectors.VectorGroups) and kb.sparse_index().groups is not None
