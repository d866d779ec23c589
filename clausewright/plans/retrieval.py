"""Hybrid retrieval for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators import fusion, search
from clausewright.operators.index import SparseIndex
from clausewright.operators.sizing import broadcast_when, materialise
from clausewright.operators.vectors import VectorGroups

BOOST_QUERY = "__boost__"
SMALL_BATCH = 1_000


def normalise_queries(queries: DataFrame, top_k: int = fusion.FINAL_TOP_K) -> DataFrame:
    """Fills in the optional columns: jurisdiction, doc_type and top_k.

    A NULL jurisdiction searches everything; ``national`` searches national chunks only.
    """
    have = set(queries.columns)
    jurisdiction = F.col("jurisdiction") if "jurisdiction" in have else F.lit(None)
    return queries.withColumns(
        {
            "query_id": F.col("query_id").cast("string"),
            "jurisdiction": jurisdiction.cast("string"),
            "doc_type": (F.col("doc_type") if "doc_type" in have else F.lit(None)).cast("string"),
            "top_k": (F.coalesce("top_k", F.lit(top_k)) if "top_k" in have else F.lit(top_k)).cast("int"),
        }
    )


def dense_lists(
    vectors: DataFrame | VectorGroups, queries: DataFrame, boost_vector: list[float] | None, size: search.BatchSize | None = None
) -> tuple[DataFrame, DataFrame]:
    """Dense hits, and the same lists with the boost appended.

    The boost list is the same for every query, so it is one more row in the
    batch and costs no second scan of the vectors.
    """
    batch = queries.select(
        "query_id", "embedding", "jurisdiction", "doc_type", F.lit(search.DENSE_FETCH).alias("fetch")
    )
    if boost_vector is None:
        dense = materialise(search.vector_search(vectors, batch, rows_at_most=size and size.queries))
        return dense, dense.withColumn("boosted", F.lit(False))
    extra = queries.sparkSession.createDataFrame(
        [(BOOST_QUERY, [float(x) for x in boost_vector], None, search.BOOST_TYPE, search.BOOST_FETCH)],
        "query_id string, embedding array<double>, jurisdiction string, doc_type string, fetch int",
    )
    batch = batch.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(extra)
    found = materialise(search.vector_search(vectors, batch, rows_at_most=size and size.queries + 1))
    dense = found.where(F.col("query_id") != BOOST_QUERY)
    boost = found.where(F.col("query_id") == BOOST_QUERY).drop("query_id")
    return dense, search.append_boost(dense, queries, boost)


def hit_lists(
    index: SparseIndex,
    chunks: DataFrame,
    vectors: DataFrame | VectorGroups,
    queries: DataFrame,
    boost_vector: list[float] | None,
    size: search.BatchSize | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense hits, dense hits with the boost appended, and keyword hits.

    The hits are few and costly, and everything after them reads them more than
    once, so they are cut off from their lineage here.
    """
    size = size or search.measure(queries)
    dense, boosted = dense_lists(vectors, queries, boost_vector, size)
    return dense, boosted, materialise(search.sparse_search(index, chunks, queries, size=size))


def retrieve(
    index: SparseIndex,
    chunks: DataFrame,
    vectors: DataFrame | VectorGroups,
    queries: DataFrame,
    boost_vector: list[float] | None = None,
    scorer=fusion.lexical_score,
    use_reranker: bool = True,
) -> DataFrame:
    """One result row per query.

    ``queries(query_id, query, embedding, [jurisdiction], [doc_type], [top_k])``;
    ``chunks`` is the chunk table with its freshness columns; ``vectors`` the unit
    vectors with ``jurisdiction``, ``document_type`` and ``is_stale``, or groups of them. Hit counts
    are taken before the boost is appended. The batch is written out and measured once; all that
    chooses between a scan, a broadcast and a shuffle goes by these sizes.
    """
    asked = materialise(normalise_queries(queries))
    size = search.measure(asked)
    small = size.queries <= SMALL_BATCH
    dense, boosted, sparse = hit_lists(index, chunks, vectors, asked, boost_vector, size)
    fused = fusion.rrf_fuse(boosted, sparse)
    fetched = search.DENSE_FETCH + search.BOOST_FETCH + search.SPARSE_FETCH
    cands = fusion.candidates(fused, chunks, asked, small, fetched * size.queries)
    final = fusion.rerank(cands, scorer, use_reranker)
    dense_counts = dense.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_dense_hits"))
    sparse_counts = sparse.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_sparse_hits"))
    return fusion.assemble(
        asked.drop("embedding"), final, broadcast_when(small, dense_counts), broadcast_when(small, sparse_counts)
    )
