"""Rank fusion, reranking, the quality signal and the assembled retrieval result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import blank_to, find_all, left, rx, ws_trim
from clausewright.operators.sizing import broadcast_when, few_values, restrict
from clausewright.schema import NATIONAL

# Fusion constant and the sizes of each stage.
RRF_K = 60
RERANK_TOP_N = 20
FINAL_TOP_K = 7
MIN_SCORE = 0.01
RERANK_TEXT_CHARS = 512

# Fixed value: what an empty result looks like as a context.
EMPTY_CONTEXT = "No relevant planning law chunks found."

# Numbers with units and instrument numbers, as entities.
ENTITY_NUMBER = r"\d+(?:\.\d+)?\s*(?:square metres?|metres?|sq\.?\s*m)"
ENTITY_INSTRUMENT = r"S\.I\.\s*No\.\s*\d+\s*of\s*\d{4}"


def with_key(hits: DataFrame, method: str) -> DataFrame:
    """Hits without an id get one from their list and rank."""
    return hits.withColumn(
        "chunk_id", F.coalesce("chunk_id", F.concat(F.lit(f"{method}_"), F.col("rank").cast("string")))
    )


def rrf_fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, in one shuffle.

    Gives ``query_id, chunk_id, rrf_score, dense_rank, sparse_rank, source,
    fused_rank``. Equal scores keep dense order first, then sparse order.
    """
    rows = with_key(dense, "dense").select(
        "query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")
    ).unionByName(
        with_key(sparse, "sparse").select(
            "query_id", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank")
        )
    )

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(rank)), F.lit(0.0))

    merged = rows.groupBy("query_id", "chunk_id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    )
    source = (
        F.when(F.col("sparse_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "sparse").otherwise("both")
    )
    scored = merged.withColumn("rrf_score", share("dense_rank") + share("sparse_rank")).withColumn("source", source)
    window = Window.partitionBy("query_id").orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("chunk_id")
    )
    return scored.where(F.col("rrf_score") >= MIN_SCORE).withColumn("fused_rank", F.row_number().over(window))


def candidates(fused: DataFrame, chunks: DataFrame, queries: DataFrame, small: bool, hits_at_most: int | None = None) -> DataFrame:
    """The best fused, non-stale chunks of each query with their text and metadata.

    Places are given on narrow rows; texts are fetched for the best ids only: a small set of ids becomes a filter
    that reaches the files, a bounded set is broadcast to the chunks, and a large
    one is joined by shuffling. ``hits_at_most`` bounds the rows of ``fused``.
    """
    narrow = restrict(chunks, "chunk_id", few_values(fused, "chunk_id", rows_at_most=hits_at_most)).where("NOT is_stale").select("chunk_id")
    window = Window.partitionBy("query_id").orderBy("fused_rank")
    ranked = narrow.join(broadcast_when(small, fused), "chunk_id").withColumn("place", F.row_number().over(window))
    best = ranked.where(F.col("place") <= RERANK_TOP_N)
    wanted = restrict(chunks, "chunk_id", few_values(best, "chunk_id", rows_at_most=hits_at_most))
    details = wanted.select(
        "chunk_id",
        "text",
        F.struct(
            "chunk_id",
            "section_ref",
            "source_title",
            "jurisdiction",
            "document_type",
            "confidence",
            "is_stale",
            F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"),
            "needs_reverification",
        ).alias("metadata"),
    )
    top = details.join(broadcast_when(small, best), "chunk_id")
    return top.join(broadcast_when(small, queries.select("query_id", "query", "top_k")), "query_id")


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in reranker: share of the query's distinct tokens in the text, as a logit-like number."""
    from clausewright.functions.text import tokenise

    wanted = F.array_distinct(tokenise(query))
    shared = F.size(F.array_intersect(wanted, tokenise(text)))
    return F.when(F.size(wanted) > 0, F.lit(10.0) * shared / F.size(wanted) - F.lit(5.0)).otherwise(F.lit(0.0))


def rerank(cands: DataFrame, scorer=lexical_score, enabled: bool = True) -> DataFrame:
    """Adds ``rerank_score`` and ``final_rank`` and keeps each query's ``top_k``.

    ``scorer(query, text)`` gives a column, built in or a pandas UDF; it sees the
    start of the text only. Without a scorer the fused order stays. A query with
    a single candidate is not scored.
    """
    per_query = Window.partitionBy("query_id")
    counted = cands.withColumn("n_candidates", F.count(F.lit(1)).over(per_query))
    if enabled and scorer is not None:
        # A query of which any candidate has no score keeps its fused order as a whole.
        raw = scorer(F.col("query"), left(F.col("text"), RERANK_TEXT_CHARS)).cast("double")
        counted = counted.withColumn("raw_score", raw).withColumn("n_scored", F.count("raw_score").over(per_query))
        scored = (F.col("n_candidates") > 1) & (F.col("n_scored") == F.col("n_candidates"))
        score = F.when(scored, F.col("raw_score")).otherwise(F.lit(0.0))
    else:
        score = F.lit(0.0)
    ordered = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("place"))
    return (
        counted.withColumn("rerank_score", score)
        .drop("raw_score", "n_scored")
        .withColumn("final_rank", F.row_number().over(ordered))
        .where(F.col("final_rank") <= F.col("top_k"))
        .withColumn("reranked", F.lit(enabled) & (F.col("n_candidates") > 1))
    )


def quality(chunks: Column, dense_hits: Column, sparse_hits: Column, reranked: Column) -> Column:
    """0..1 signal from agreement of the two methods, top rerank score and coverage."""
    n = F.size(chunks).cast("double")
    both = F.size(F.filter(chunks, lambda c: c["source"] == "both")).cast("double")
    top = F.get(chunks, F.lit(0))["rerank_score"]
    score = F.when((dense_hits > 0) & (sparse_hits > 0), F.lit(0.3)).otherwise(F.lit(0.0))
    score = score + F.lit(0.2) * F.least(both / F.nullif(n, F.lit(0.0)), F.lit(1.0))
    score = score + F.when(reranked, F.lit(0.4) / (F.lit(1.0) + F.exp(-top / 5.0))).otherwise(F.lit(0.0))
    score = score + F.lit(0.1) * (n / float(FINAL_TOP_K))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


CHUNK_FIELDS = ("text", "metadata", "rrf_score", "rerank_score", "dense_rank", "sparse_rank", "source")


def assemble(queries: DataFrame, final: DataFrame, dense_counts: DataFrame, sparse_counts: DataFrame) -> DataFrame:
    """One result row per query; queries that found nothing keep their row."""
    per_query = final.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("final_rank", *CHUNK_FIELDS))).alias("ranked"),
        F.max("reranked").alias("reranked"),
    )
    empty = "array<struct<" + ",".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in final.select(*CHUNK_FIELDS).schema.fields
    ) + ">>"
    strip = F.transform("ranked", lambda c: F.struct(*[c[f].alias(f) for f in CHUNK_FIELDS]))
    joined = (
        queries.join(per_query, "query_id", "left")
        .join(dense_counts, "query_id", "left")
        .join(sparse_counts, "query_id", "left")
        .withColumn("chunks", F.coalesce(strip, F.array().cast(empty)))
        .withColumn("reranker_used", F.coalesce("reranked", F.lit(False)))
        .withColumn("total_dense_hits", F.coalesce("total_dense_hits", F.lit(0)).cast("int"))
        .withColumn("total_sparse_hits", F.coalesce("total_sparse_hits", F.lit(0)).cast("int"))
        .withColumn("jurisdiction_used", F.coalesce("jurisdiction", F.lit("all")))
    )
    return joined.withColumn(
        "retrieval_quality",
        quality(F.col("chunks"), F.col("total_dense_hits"), F.col("total_sparse_hits"), F.col("reranker_used")),
    ).drop("ranked", "reranked")


# -- views of a result -----------------------------------------------------------------

# What a missing metadata field reads as.
METADATA_DEFAULTS = {
    "chunk_id": "",
    "section_ref": "",
    "source_title": "",
    "jurisdiction": NATIONAL,
    "document_type": "",
    "confidence": "medium",
    "is_stale": False,
    "effective_date": "",
}


def accessor(chunk: Column, name: str) -> Column:
    return F.coalesce(chunk["metadata"][name], F.lit(METADATA_DEFAULTS[name]))


def context_string(chunks: Column) -> Column:
    """Numbered, labelled blocks for the prompt."""

    def block(chunk: Column, i: Column) -> Column:
        return F.concat(
            F.lit("[CHUNK "),
            (i + 1).cast("string"),
            F.lit("]\nSource: "),
            accessor(chunk, "source_title"),
            F.lit("\nSection: "),
            blank_to(chunk["metadata"]["section_ref"], "N/A"),
            F.lit("\nJurisdiction: "),
            accessor(chunk, "jurisdiction"),
            F.lit("\nEffective: "),
            blank_to(chunk["metadata"]["effective_date"], "N/A"),
            F.lit("\nConfidence: "),
            accessor(chunk, "confidence"),
            F.lit("\n---\n"),
            chunk["text"],
            F.lit("\n"),
        )

    return F.when(F.size(chunks) == 0, F.lit(EMPTY_CONTEXT)).otherwise(
        F.array_join(F.transform(chunks, block), "\n\n")
    )


def entity_set(chunks: Column) -> Column:
    """Distinct lower-cased references, jurisdictions, numbers with units and instrument numbers."""

    def entities(chunk: Column) -> Column:
        ref = accessor(chunk, "section_ref")
        refs = F.when(ref != "", F.transform(F.split(ref, r"\|"), lambda r: F.lower(ws_trim(r)))).otherwise(
            F.array().cast("array<string>")
        )
        numbers = F.transform(
            find_all(chunk["text"], rx(ENTITY_NUMBER, ignore_case=True)), lambda m: ws_trim(F.lower(m))
        )
        instruments = F.transform(find_all(chunk["text"], rx(ENTITY_INSTRUMENT)), lambda m: F.lower(m))
        return F.concat(refs, F.array(F.lower(accessor(chunk, "jurisdiction"))), numbers, instruments)

    return F.array_distinct(F.flatten(F.transform(chunks, entities)))


def top_chunk(chunks: Column) -> Column:
    return F.get(chunks, F.lit(0))


def is_empty(chunks: Column) -> Column:
    return F.size(chunks) == 0


def explain_result(results: DataFrame) -> DataFrame:
    """Diagnostic table: one row per query and rank."""
    return results.select(
        "query_id", "reranker_used", F.posexplode("chunks").alias("position", "chunk")
    ).select(
        "query_id",
        (F.col("position") + 1).alias("rank"),
        F.col("chunk.source").alias("source"),
        F.round("chunk.rrf_score", 4).alias("rrf"),
        F.when(F.col("reranker_used"), F.format_string("%.2f", F.col("chunk.rerank_score")))
        .otherwise(F.lit("—"))
        .alias("rerank"),
        blank_to(left(accessor(F.col("chunk"), "section_ref"), 25), "—").alias("section"),
        accessor(F.col("chunk"), "jurisdiction").alias("jurisdiction"),
        F.concat(F.regexp_replace(left(F.col("chunk.text"), 45), "\n", " "), F.lit("...")).alias("preview"),
    )
