"""Keyword index: postings, document frequencies and corpus totals.

Term frequencies are counted inside Arrow batches of chunks (number the distinct
tokens of a batch, then count pairs of a chunk and a number), so postings are
built without any shuffle. The only exchange is the one that counts chunks per
term, after map-side combining.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrays import list_slices
from clausewright.functions.text import tokenise
from clausewright.operators.sizing import at_most, materialise

# BM25 parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25

BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class SparseIndex:
    """``documents(chunk_id, dl, terms)``, the same as ``postings(term, chunk_id, tf, dl)``, ``term_stats(term, df, idf)``,
    one-row ``corpus(n_docs, avgdl)``. Searches read the documents, or, if there, ``groups`` of them (see ``impacts``);
    lookups of a term the postings."""

    documents: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    groups: DataFrame | None = None


def count_terms(tokens: pa.Array) -> pa.Array:
    """For each list its length ``dl`` and ``terms``, its distinct tokens in order as ``term, tf``; NULL for NULL."""
    length = pc.list_value_length(tokens)
    coded = tokens.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order) + 1, dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    row = np.repeat(np.arange(len(tokens)), length.fill_null(0).to_numpy())
    # one number for each pair of a row and a term, in the order of both
    pairs, tf = np.unique(row * max(1, len(order)) + rank[coded.indices.to_numpy()], return_counts=True)
    row, term = np.divmod(pairs, max(1, len(order)))
    starts = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)), pa.int32())
    words = coded.dictionary.take(order).take(pa.array(term))
    runs = pa.StructArray.from_arrays([words, pa.array(tf, pa.int32())], ["term", "tf"])
    mask = tokens.is_null() if tokens.null_count else None
    return pa.StructArray.from_arrays([length.cast(pa.int32()), pa.ListArray.from_arrays(starts, runs, mask=mask)], ["dl", "terms"])


def term_lists(df: DataFrame, tokens: Column, *keep: str, rows: bool = False) -> DataFrame:
    """For each row ``terms``, its distinct tokens as ``term, tf``, and the token count ``dl``; with ``rows`` a row for each term."""

    @F.arrow_udf("dl int, terms array<struct<term:string,tf:int>>")
    def counted(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
        none = pa.array([], pa.struct([("dl", pa.int32()), ("terms", kind)]))
        return pa.concat_arrays([none, *map(count_terms, list_slices(lists))])

    lists = df.select(*keep, counted(tokens).alias("_counted"))
    return lists.select(*keep, "_counted.dl", F.inline("_counted.terms") if rows else F.col("_counted.terms").alias("terms"))


def build_documents(chunks: DataFrame) -> DataFrame:
    return term_lists(chunks, tokenise(F.col("text")), "chunk_id")


def as_postings(documents: DataFrame) -> DataFrame:
    """Postings of stored term lists. Lists that are not stored would be made anew for every term: see ``build_postings``."""
    return documents.select("chunk_id", "dl", F.inline("terms")).select("term", "chunk_id", "tf", "dl")


def build_postings(chunks: DataFrame) -> DataFrame:
    return term_lists(chunks, tokenise(F.col("text")), "chunk_id", rows=True).select("term", "chunk_id", "tf", "dl")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``df`` chunks hold the term, ``cf`` times in all."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("long")).alias("cf")
    )


def corpus_totals(chunks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Additive totals of a set of chunks, so that batches can be summed. Reads no text."""
    tokens = frequencies.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("sum_dl")).scalar()
    return chunks.agg(F.count(F.lit(1)).alias("n_docs")).select("n_docs", tokens.alias("sum_dl"))


def summarise_corpus(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.sum("n_docs").alias("n_docs"),
        F.try_divide(F.sum("sum_dl").cast("double"), F.sum("n_docs").cast("double")).alias("avgdl"),
    )


def weigh_terms(frequencies: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``idf``; negative values are replaced by a fraction of the mean raw idf."""
    n = corpus.select(F.col("n_docs").cast("double")).scalar()
    df = F.col("df").cast("double")
    raw = frequencies.select("term", "df", (F.log(n - df + 0.5) - F.log(df + 0.5)).alias("raw_idf"))
    floor = raw.agg((F.lit(EPSILON) * F.avg("raw_idf")).alias("floor")).scalar()
    return raw.select("term", "df", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf"))


def build_sparse_index(chunks: DataFrame, keep: bool = False) -> SparseIndex:
    """Index of the given chunks (already freed of stale rows).

    With ``keep`` every part is written out once: the texts are tokenised and the
    frequencies counted only once, however many searches follow.
    """
    if not keep:
        frequencies = document_frequencies(build_postings(chunks))
        documents = build_documents(chunks)
        corpus = summarise_corpus(corpus_totals(documents, frequencies))
        return SparseIndex(documents, build_postings(chunks), weigh_terms(frequencies, corpus), corpus)
    documents = materialise(build_documents(chunks))
    postings = as_postings(documents)
    frequencies = materialise(document_frequencies(postings))
    corpus = materialise(summarise_corpus(corpus_totals(documents, frequencies)))
    return SparseIndex(documents, postings, materialise(weigh_terms(frequencies, corpus)), corpus)


def new_chunks(chunks: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Rows whose id is neither stored already nor repeated inside the batch.

    A small batch travels to the stored ids, so these are scanned but not
    shuffled; a large one is joined by shuffling both by id.
    """
    stored = stored_ids.select("chunk_id")
    ids = chunks.select("chunk_id")
    if at_most(ids, BROADCAST_IDS):
        stored = stored.join(F.broadcast(ids.distinct()), "chunk_id", "left_semi")
    return chunks.dropDuplicates(["chunk_id"]).join(stored, "chunk_id", "left_anti")


def manifest(chunks: DataFrame) -> DataFrame:
    """One row per source document: title, type, jurisdiction, chunk count and dates."""
    first = F.min_by(
        F.struct("source_title", "document_type", "jurisdiction"), F.struct("chunk_index", "chunk_id")
    )
    return (
        chunks.groupBy("source_doc_id")
        .agg(
            first.alias("first"),
            F.count(F.lit(1)).alias("chunk_count"),
            F.min("ingested_at").alias("first_seen"),
            F.max("ingested_at").alias("last_updated"),
        )
        .select(
            F.col("source_doc_id").alias("doc_id"),
            F.col("first.source_title").alias("title"),
            F.col("first.document_type").alias("type"),
            F.col("first.jurisdiction").alias("jurisdiction"),
            "chunk_count",
            "first_seen",
            "last_updated",
        )
    )


def corpus_stats(chunks: DataFrame, as_of=None) -> DataFrame:
    """Totals over the stored chunks, in one pass."""
    from clausewright.functions.freshness import is_stale, needs_reverification

    stale = is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of)
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(~stale).alias("indexed_chunks"),
        F.countDistinct("source_doc_id").alias("total_docs_ingested"),
        F.coalesce(F.max("ingested_at").cast("string"), F.lit("never")).alias("last_updated"),
        F.count_if(stale).alias("stale_chunks"),
        F.count_if(needs_reverification(F.col("last_verified"), as_of)).alias("chunks_needing_reverify"),
    )
