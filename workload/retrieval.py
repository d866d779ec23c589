"""Keyword and vector search, fusion, reranking and the views of a result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausewright.operators import fusion, search
from clausewright.operators.impacts import group_documents
from clausewright.operators.sizing import materialise
from clausewright.operators.vectors import stored_groups
from clausewright.plans import retrieval as plan
from workload import data as d
from workload.records import INDEX_CTES, TOKENS_SQL, searched


def unfiltered(asks):
    return asks.withColumns({name: F.lit(None).cast("string") for name in ("jurisdiction", "doc_type")})


def hits(df, *extra):
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"), *extra)


def bm25_topk(spark, sf):
    index, chunks, _ = searched(spark, sf)
    return hits(search.sparse_search(index, chunks, unfiltered(d.asks(spark, sf))))


def sparse_filtered(spark, sf):
    index, chunks, _ = searched(spark, sf)
    return hits(search.sparse_search(index, chunks, d.asks(spark, sf)))


def dense_knn(spark, sf):
    return hits(search.dense_search(d.vectors(spark, sf), unfiltered(d.asks(spark, sf))))


def dense_filtered(spark, sf):
    return hits(search.dense_search(d.vectors(spark, sf), d.asks(spark, sf)))


def dense_tiled(spark, sf):
    """The same search with blocks so small that queries and vectors are tiled."""
    return hits(search.dense_search(d.vectors(spark, sf), d.asks(spark, sf), block=16))


def dense_pruned(spark, sf):
    """The same search over grouped vectors."""
    return hits(search.grouped_search(stored_groups(d.vectors(spark, sf)), d.asks(spark, sf)))


def dense_fetch(spark, sf):
    """The same search with a limit of its own for each query."""
    asks = d.asks(spark, sf).withColumn("fetch", F.col("top_k") * 7 - 6)
    return hits(search.grouped_search(stored_groups(d.vectors(spark, sf)), asks))


def sparse_pruned(spark, sf):
    """``sparse_filtered`` over groups of term lists."""
    index, chunks, _ = searched(spark, sf)
    grouped = replace(index, groups=materialise(group_documents(index.documents)))
    return hits(search.sparse_search(grouped, chunks, d.asks(spark, sf)))


def _lists(spark, sf):
    asks = materialise(plan.normalise_queries(d.asks(spark, sf)))
    return plan.hit_lists(*searched(spark, sf), asks, d.boost_vector(spark, sf))


def boost_append(spark, sf):
    asks = plan.normalise_queries(d.asks(spark, sf))
    _, boosted = plan.dense_lists(searched(spark, sf)[2], asks, d.boost_vector(spark, sf))
    return hits(boosted, "boosted")


def rrf_fusion(spark, sf):
    _, boosted, sparse = _lists(spark, sf)
    return fusion.rrf_fuse(boosted, sparse).select(
        "query_id",
        "chunk_id",
        F.round("rrf_score", 9).alias("rrf_score"),
        "dense_rank",
        "sparse_rank",
        "source",
        F.col("fused_rank").cast("int").alias("fused_rank"),
    )


def results(spark, sf):
    return plan.retrieve(*searched(spark, sf), d.asks(spark, sf), d.boost_vector(spark, sf))


def hybrid_topk(spark, sf):
    return (
        results(spark, sf)
        .select("query_id", F.posexplode("chunks").alias("pos", "c"))
        .select(
            "query_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("c.metadata.chunk_id").alias("chunk_id"),
            "c.source",
            F.round("c.rrf_score", 9).alias("rrf_score"),
            F.round("c.rerank_score", 6).alias("rerank_score"),
            "c.dense_rank",
            "c.sparse_rank",
        )
    )


def retrieval_quality(spark, sf):
    return results(spark, sf).select(
        "query_id",
        "jurisdiction_used",
        "total_dense_hits",
        "total_sparse_hits",
        "reranker_used",
        F.size("chunks").alias("n_chunks"),
        F.coalesce(fusion.top_chunk(F.col("chunks"))["metadata"]["chunk_id"], F.lit("")).alias("top_chunk_id"),
        F.round("retrieval_quality", 6).alias("retrieval_quality"),
    )


def context_string(spark, sf):
    return results(spark, sf).select("query_id", fusion.context_string(F.col("chunks")).alias("context"))


def entity_set(spark, sf):
    return results(spark, sf).select(
        "query_id", F.array_join(F.array_sort(fusion.entity_set(F.col("chunks"))), "; ").alias("entities")
    )


def explain_result(spark, sf):
    return fusion.explain_result(results(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk,
        sparse_filtered,
        dense_knn,
        dense_filtered,
        dense_tiled,
        dense_pruned,
        dense_fetch,
        sparse_pruned,
        boost_append,
        rrf_fusion,
        hybrid_topk,
        retrieval_quality,
        context_string,
        entity_set,
        explain_result,
    )
}


def sparse_ctes(filtered: bool = True) -> str:
    keep = "NOT f.is_stale" + (
        " AND (a.jurisdiction IS NULL OR f.jurisdiction IN (a.jurisdiction, 'national'))"
        if filtered
        else ""
    )
    return f"""
{INDEX_CTES},
fresh AS ({d.FRESH_SQL}),
asks AS ({d.ASKS_SQL}),
qterms AS (
  SELECT query_id, term, count(*)::DOUBLE AS qtf
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+(?:\\.[a-z0-9]+)*')) AS term FROM asks)
  GROUP BY query_id, term
),
scored AS (
  SELECT query_id, chunk_id, sum(qtf * idf * (tf::DOUBLE * 2.5::DOUBLE)
      / (tf::DOUBLE + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl::DOUBLE / (SELECT avgdl FROM totals)))) AS s
  FROM qterms JOIN term_stats USING (term) JOIN postings USING (term) GROUP BY query_id, chunk_id
),
best AS (
  SELECT query_id, chunk_id, round(s, 6) AS score FROM scored WHERE s > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, chunk_id) <= 60
),
sparse AS (
  SELECT b.query_id, b.chunk_id, b.score,
    CAST(row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.chunk_id) AS INTEGER) AS rank
  FROM best b JOIN fresh f USING (chunk_id) JOIN asks a ON a.query_id = b.query_id WHERE {keep}
  QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.chunk_id) <= 30
)"""


def dense_cte(filtered: bool = True, most: int = 30) -> str:
    keep = (
        "(a.jurisdiction IS NULL OR v.jurisdiction IN (a.jurisdiction, 'national'))"
        " AND (a.doc_type IS NULL OR v.document_type = a.doc_type)"
        if filtered
        else "true"
    )
    return f"""
vectors AS ({d.VECTORS_SQL}),
dense AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM (
    SELECT a.query_id, v.chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), v.embedding), 6) AS score
    FROM asks a, vectors v WHERE {keep}
  ) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {most}
)"""


BOOST_CTES = f"""
bv AS ({d.BOOST_VECTOR_SQL}),
boost AS (
  SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS boost_rank FROM (
    SELECT v.chunk_id, round(list_cosine_similarity(bv.embedding, v.embedding), 6) AS score
    FROM vectors v, bv WHERE v.document_type = 'exemption_schedule')
  QUALIFY row_number() OVER (ORDER BY score DESC, chunk_id) <= 10
),
extra AS (
  SELECT a.query_id, b.chunk_id, b.score, row_number() OVER (PARTITION BY a.query_id ORDER BY b.boost_rank) AS n
  FROM asks a, boost b
  WHERE regexp_matches(lower(a.query), 'extension|shed|solar|exempt|garage|porch|fence|attic|class 1|class 2|schedule 2|permission')
    AND NOT EXISTS (SELECT 1 FROM dense x WHERE x.query_id = a.query_id AND x.chunk_id = b.chunk_id)
),
boosted AS (
  SELECT query_id, chunk_id, score, rank, false AS boosted FROM dense
  UNION ALL
  SELECT e.query_id, e.chunk_id, e.score,
    CAST(e.n + (SELECT count(*) FROM dense x WHERE x.query_id = e.query_id) AS INTEGER) AS rank, true AS boosted FROM extra e
)"""
FUSED_CTES = """
merged AS (
  SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.chunk_id, s.chunk_id) AS chunk_id,
    b.rank AS dense_rank, s.rank AS sparse_rank,
    coalesce(1::DOUBLE / (60 + b.rank), 0) + coalesce(1::DOUBLE / (60 + s.rank), 0) AS rrf_score,
    CASE WHEN s.rank IS NULL THEN 'dense' WHEN b.rank IS NULL THEN 'sparse' ELSE 'both' END AS source
  FROM boosted b FULL OUTER JOIN sparse s ON b.query_id = s.query_id AND b.chunk_id = s.chunk_id
),
fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST) AS INTEGER) AS fused_rank
  FROM merged WHERE rrf_score >= 0.01
)"""
FINAL_CTES = f"""
cands AS (
  SELECT f.*, c.text, c.section_ref, c.source_title, c.jurisdiction, c.confidence, c.effective_date, c.needs_reverification,
    a.query, a.top_k, count(*) OVER (PARTITION BY f.query_id) AS n_candidates
  FROM (SELECT * FROM fused WHERE fused_rank <= 20) f JOIN fresh c USING (chunk_id) JOIN asks a ON a.query_id = f.query_id
),
tokened AS (
  SELECT *, list_distinct({TOKENS_SQL.replace('text', 'query')}) AS wanted, {TOKENS_SQL.replace('text', 'left(text, 512)')} AS have FROM cands
),
reranked AS (
  SELECT *, CASE WHEN n_candidates > 1 THEN 10::DOUBLE * len(list_filter(wanted, lambda w: list_contains(have, w))) / len(wanted) - 5
    ELSE 0::DOUBLE END AS rerank_score FROM tokened
),
final AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS rank
  FROM reranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) <= top_k
),
per_query AS (
  SELECT query_id, count(*) AS n, count(*) FILTER (WHERE source = 'both') AS n_both, bool_or(n_candidates > 1) AS reranked,
    min_by(rerank_score, rank) AS top_score, min_by(chunk_id, rank) AS top_chunk_id FROM final GROUP BY query_id
),
quality AS (
  SELECT a.query_id, a.query, coalesce(a.jurisdiction, 'all') AS jurisdiction_used,
    CAST(coalesce(nd, 0) AS INTEGER) AS total_dense_hits, CAST(coalesce(ns, 0) AS INTEGER) AS total_sparse_hits,
    coalesce(reranked, false) AS reranker_used, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks,
    coalesce(top_chunk_id, '') AS top_chunk_id,
    CASE WHEN n IS NULL THEN 0::DOUBLE ELSE least(1::DOUBLE,
      CASE WHEN coalesce(nd, 0) > 0 AND coalesce(ns, 0) > 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * n_both / n
      + CASE WHEN reranked THEN 0.4::DOUBLE / (1 + exp(-top_score / 5)) ELSE 0 END + 0.1::DOUBLE * n / 7) END AS retrieval_quality
  FROM asks a LEFT JOIN per_query p USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS nd FROM dense GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS ns FROM sparse GROUP BY query_id) USING (query_id)
)"""
HYBRID_CTES = ",".join((sparse_ctes(), dense_cte(), BOOST_CTES, FUSED_CTES, FINAL_CTES))
BLOCK_SQL = """
'[CHUNK ' || rank || ']' || chr(10) || 'Source: ' || source_title || chr(10) || 'Section: '
  || CASE WHEN coalesce(section_ref, '') = '' THEN 'N/A' ELSE section_ref END || chr(10) || 'Jurisdiction: ' || jurisdiction || chr(10)
  || 'Effective: ' || coalesce(strftime(effective_date, '%Y-%m-%d'), 'N/A') || chr(10) || 'Confidence: ' || confidence || chr(10)
  || '---' || chr(10) || text || chr(10)"""
ENTITIES_SQL = f"""
list_concat(
  CASE WHEN coalesce(section_ref, '') <> '' THEN list_transform(string_split(section_ref, '|'), lambda r: lower(trim(r, {d.WS})))
    ELSE CAST([] AS VARCHAR[]) END,
  [lower(jurisdiction)],
  list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*(?:square metres?|metres?|sq\\.?\\s*m)', 0, 'i'), lambda m: lower(trim(m, {d.WS}))),
  list_transform(regexp_extract_all(text, 'S\\.I\\.\\s*No\\.\\s*\\d+\\s*of\\s*\\d{{4}}', 0), lambda m: lower(m)))"""

_HITS = "SELECT query_id, chunk_id, score, rank FROM"
_ASKS = f"asks AS ({d.ASKS_SQL})"
SQL = {
    "bm25_topk": f"WITH {sparse_ctes(False)} {_HITS} sparse",
    "sparse_filtered": f"WITH {sparse_ctes()} {_HITS} sparse",
    "dense_knn": f"WITH {_ASKS}, {dense_cte(False)} {_HITS} dense",
    "dense_filtered": f"WITH {_ASKS}, {dense_cte()} {_HITS} dense",
    "dense_tiled": f"WITH {_ASKS}, {dense_cte()} {_HITS} dense",
    "dense_pruned": f"WITH {_ASKS}, {dense_cte()} {_HITS} dense",
    "dense_fetch": f"WITH {_ASKS}, {dense_cte(most=64)} SELECT query_id, chunk_id, score, rank FROM dense JOIN asks USING (query_id) WHERE rank <= top_k * 7 - 6",
    "sparse_pruned": f"WITH {sparse_ctes()} {_HITS} sparse",
    "boost_append": f"WITH {_ASKS}, {dense_cte()}, {BOOST_CTES} SELECT query_id, chunk_id, score, rank, boosted FROM boosted",
    "rrf_fusion": f"""
WITH {HYBRID_CTES} SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, dense_rank, sparse_rank, source, fused_rank FROM fused""",
    "hybrid_topk": f"""
WITH {HYBRID_CTES} SELECT query_id, rank, chunk_id, source, round(rrf_score, 9) AS rrf_score,
  round(rerank_score, 6) AS rerank_score, dense_rank, sparse_rank FROM final""",
    "retrieval_quality": f"""
WITH {HYBRID_CTES} SELECT query_id, jurisdiction_used, total_dense_hits, total_sparse_hits, reranker_used, n_chunks,
  top_chunk_id, round(retrieval_quality, 6) AS retrieval_quality FROM quality""",
    "context_string": f"""
WITH {HYBRID_CTES} SELECT query_id, coalesce(string_agg({BLOCK_SQL}, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank IS NOT NULL),
  'No relevant planning law chunks found.') AS context
FROM asks a LEFT JOIN (SELECT * EXCLUDE (query, top_k) FROM final) USING (query_id) GROUP BY query_id""".replace(
        "jurisdiction ||", "final_jurisdiction ||"
    ).replace("SELECT * EXCLUDE (query, top_k) FROM final", "SELECT * EXCLUDE (query, top_k) RENAME (jurisdiction AS final_jurisdiction) FROM final"),
    "entity_set": f"""
WITH {HYBRID_CTES}, e AS (SELECT query_id, unnest({ENTITIES_SQL}) AS entity FROM final)
SELECT a.query_id, coalesce(string_agg(DISTINCT entity, '; ' ORDER BY entity), '') AS entities
FROM asks a LEFT JOIN e USING (query_id) GROUP BY a.query_id""",
    "explain_result": f"""
WITH {HYBRID_CTES} SELECT query_id, rank, source, round(rrf_score, 4) AS rrf,
  CAST(round(CAST(CAST(rerank_score AS VARCHAR) AS DECIMAL(30, 18)), 2) AS VARCHAR) AS rerank,
  CASE WHEN coalesce(section_ref, '') = '' THEN '—' ELSE left(section_ref, 25) END AS section, jurisdiction,
  replace(left(text, 45), chr(10), ' ') || '...' AS preview FROM final""",
}
