"""Searches of a stored knowledge base that was filled in two batches and then partly overwritten."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausewright.operators import search
from clausewright.operators.embedding import hashing_embedder
from clausewright.operators.sizing import shared_folder
from clausewright.plans.knowledge import KnowledgeBase
from clausewright.schema import CHUNK_SCHEMA
from workload import data as d
from workload.retrieval import sparse_ctes

DIMENSIONS = 64
AMENDED = "doc_id % 10 = 3"
AMENDMENT = " An amended shed and garage."


def stored(spark, sf) -> KnowledgeBase:
    """Even documents, then odd ones, then the amended ones in place of those stored before."""
    docs = d.table(spark, sf, "documents")
    kb = KnowledgeBase(spark, f"{shared_folder(spark)}/clausewright-{uuid.uuid4().hex}", hashing_embedder(DIMENSIONS))

    def add(rows, **how):
        chunks = rows.selectExpr(*[f"{e} AS {n}" for n, e in d.CORPUS.items()], "'1.0' AS version")
        chunks = chunks.withColumn("ingested_at", F.timestamp_seconds("ingested_second"))
        kb.add_chunks(chunks.select(*CHUNK_SCHEMA.fieldNames()), d.AS_OF, **how)

    add(docs.where("doc_id % 2 = 0"))
    add(docs.where("doc_id % 2 = 1"))
    add(docs.where(AMENDED).withColumn("text", F.concat("text", F.lit(AMENDMENT))), overwrite=True)
    return kb


def _asks(spark, sf, kb):
    items = d.table(spark, sf, "benchmark").selectExpr(*[f"{e} AS {n}" for n, e in d.ASKS.items()])
    return items.withColumn("embedding", kb.embed(F.col("query")))


def stored_search(spark, sf):
    """Keyword and vector hits from the stored tables, through groups."""
    kb = stored(spark, sf)
    asks = _asks(spark, sf, kb)
    dense = search.vector_search(kb.vector_groups(d.AS_OF), asks)
    sparse = search.sparse_search(kb.sparse_index(asks, grouped=True), kb.fresh_chunks(d.AS_OF), asks)
    columns = ["query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank")]
    return dense.select(F.lit("dense").alias("list"), *columns).unionByName(sparse.select(F.lit("sparse").alias("list"), *columns))


def stored_manifest(spark, sf):
    """The sources of the stored knowledge base, with how much of them is stored."""
    rows = stored(spark, sf).list_sources()
    return rows.select("doc_id", "title", "type", "jurisdiction", "chunk_count", F.unix_timestamp("last_updated").alias("last_updated_s"))


QUERIES = {f.__name__: f for f in (stored_search, stored_manifest)}

DOCS_CTE = f"""
docs AS (SELECT * REPLACE (CASE WHEN {AMENDED} THEN text || '{AMENDMENT}' ELSE text END AS text) FROM documents)"""
_UNIT = "list_transform({0}, lambda e: coalesce(e / nullif(sqrt(list_sum(list_transform({0}, lambda y: y * y))), 0), 0::DOUBLE))"
_FLAT = _UNIT.format("x")


def _stored_sql(text: str) -> str:
    return text.replace("FROM documents", "FROM docs")


SQL = {
    "stored_search": f"""
WITH {DOCS_CTE}, {_stored_sql(sparse_ctes().replace(d.ASKS_SQL, f"SELECT {d.select_sql(d.ASKS)} FROM benchmark"))},
terms AS (
  SELECT 'c' || chunk_id AS id, term, tf FROM postings
  UNION ALL SELECT 'q' || query_id, term, qtf FROM qterms), {d.hashed_ctes("terms", DIMENSIONS)},
flat AS (SELECT id, list(x::DOUBLE ORDER BY k) AS x FROM hashed GROUP BY id),
unit AS (SELECT id, list_transform({_FLAT}, lambda u: u::FLOAT::DOUBLE) AS x FROM flat),
pairs AS (
  SELECT a.query_id, f.chunk_id, round(list_inner_product({_UNIT.format("q.x")}, v.x), 6) AS score
  FROM asks a JOIN unit q ON q.id = 'q' || a.query_id, fresh f JOIN unit v ON v.id = 'c' || f.chunk_id
  WHERE (a.jurisdiction IS NULL OR f.jurisdiction IN (a.jurisdiction, 'national')) AND (a.doc_type IS NULL OR f.document_type = a.doc_type)),
dense AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30)
SELECT 'dense' AS list, query_id, chunk_id, score, rank FROM dense
UNION ALL SELECT 'sparse', query_id, chunk_id, score, rank FROM sparse""",
    "stored_manifest": f"""
SELECT source_doc_id AS doc_id, min_by(source_title, chunk_index) AS title, min_by(document_type, chunk_index) AS type,
  min_by(jurisdiction, chunk_index) AS jurisdiction, count(*) AS chunk_count, max(ingested_second) AS last_updated_s
FROM ({d.FRESH_SQL}) WHERE NOT is_stale GROUP BY source_doc_id""",
}
