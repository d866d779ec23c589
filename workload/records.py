"""Freshness, validation, stored-chunk bookkeeping and the keyword index."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions.text import tokenise
from clausewright.operators import index, validation
from clausewright.operators.embedding import hashed_counts
from clausewright.operators.sizing import materialise, once
from workload import data as d


def staleness_gate(spark, sf):
    return validation.staleness_report(d.corpus(spark, sf), ["jurisdiction"], d.AS_OF)


def reverify_days(spark, sf):
    return d.fresh_corpus(spark, sf).select(
        "chunk_id", "superseded_by", "is_stale", "days_since_verified", "needs_reverification"
    )


def flat_metadata(spark, sf):
    return validation.flat_metadata(d.corpus(spark, sf), d.AS_OF)


# A third of the rows leaves one of the domains; blank superseding references become NULL.
BROKEN = {
    "text": "CASE WHEN chunk_index % 10 = 3 THEN split_part(text, ' ', 1) ELSE text END",
    "document_type": "CASE WHEN chunk_index % 13 = 0 THEN 'leaflet' ELSE document_type END",
    "jurisdiction": "CASE WHEN chunk_index % 16 = 1 THEN 'moon_base' WHEN chunk_index % 29 = 1 THEN NULL ELSE jurisdiction END",
    "confidence": "CASE WHEN chunk_index % 19 = 2 THEN 'certain' ELSE confidence END",
}


def validation_errors(spark, sf):
    rows = d.corpus(spark, sf).selectExpr("chunk_id", "superseded_by", *[f"{e} AS {n}" for n, e in BROKEN.items()])
    return validation.with_errors(rows).select(
        "chunk_id", "superseded_by", F.array_join("errors", "; ").alias("errors")
    )


def document_errors(spark, sf):
    """The same faults, listed once for each source."""
    rows = d.corpus(spark, sf).selectExpr("source_doc_id", "superseded_by", *[f"{e} AS {n}" for n, e in BROKEN.items()])
    raw = rows.selectExpr("struct(source_doc_id AS id, document_type, jurisdiction, confidence) AS metadata")
    found = validation.document_errors(raw, validation.with_errors(rows))
    return found.select("source_doc_id", F.array_join("errors", "; ").alias("errors"))


def tokenise_stats(spark, sf):
    tokens = tokenise(F.col("text"))
    return d.corpus(spark, sf).select(
        "chunk_id",
        F.size(tokens).alias("n_tokens"),
        F.size(F.array_distinct(tokens)).alias("n_distinct"),
        F.get(tokens, F.lit(0)).alias("first_token"),
    )


def embed_texts(spark, sf):
    """Signed hashed counts of each text's tokens, and the length of that vector."""
    counts = hashed_counts(F.col("text"), 64)
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = d.corpus(spark, sf).select("chunk_id", counts.alias("counts"))
    return rows.select("chunk_id", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"), F.round(norm, 6).alias("norm"))


def live_chunks(spark, sf):
    return validation.drop_stale(d.corpus(spark, sf), d.AS_OF).select("chunk_id", "text")


def searched(spark, sf):
    """Keyword index, chunks and vectors of a folder, stored by the first query of a session that searches them."""

    def store():
        chunks = materialise(d.fresh_corpus(spark, sf))
        live = chunks.where("NOT is_stale").select("chunk_id", "text")
        return index.build_sparse_index(live, keep=True), chunks, materialise(d.vectors(spark, sf))

    return once(spark, f"searched {sf}", store)


def bm25_postings(spark, sf):
    return index.build_postings(live_chunks(spark, sf))


def bm25_term_stats(spark, sf):
    return index.build_sparse_index(live_chunks(spark, sf)).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def dedupe_new_chunks(spark, sf):
    """Ids that the labels already know count as stored."""
    stored = d.table(spark, sf, "labels").selectExpr(f"{d.CHUNK_ID} AS chunk_id")
    return index.new_chunks(d.corpus(spark, sf), stored).select("chunk_id", "source_doc_id", "chunk_index")


def manifest(spark, sf):
    return index.manifest(d.corpus(spark, sf)).select(
        "doc_id",
        "title",
        "type",
        "jurisdiction",
        "chunk_count",
        F.unix_timestamp("first_seen").alias("first_seen_s"),
        F.unix_timestamp("last_updated").alias("last_updated_s"),
    )


def kb_stats(spark, sf):
    stats = index.corpus_stats(d.corpus(spark, sf), d.AS_OF)
    return stats.withColumn("last_updated", F.unix_timestamp(F.col("last_updated").cast("timestamp")))


def ingestion_stats(spark, sf):
    """Counts of one ingestion run over the statutes, with a per-document error column."""
    from clausewright.operators.chunking import chunk_texts
    from clausewright.plans.ingestion import run_totals

    raw = d.statutes(spark, sf).select("doc_id", "raw_text", F.expr(d.CORPUS["superseded_by"]).alias("superseded_by"))
    raw = raw.withColumn("expiry_date", F.lit(None).cast("date"))
    stored = d.table(spark, sf, "labels").select("doc_id")
    chunks = chunk_texts(raw.select("doc_id", "superseded_by", "expiry_date", "raw_text"))
    return run_totals(raw, chunks, stored, "doc_id", d.AS_OF)


QUERIES = {
    f.__name__: f
    for f in (
        staleness_gate,
        reverify_days,
        flat_metadata,
        validation_errors,
        document_errors,
        tokenise_stats,
        embed_texts,
        bm25_postings,
        bm25_term_stats,
        dedupe_new_chunks,
        manifest,
        kb_stats,
        ingestion_stats,
    )
}

TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)*')"
LIVE_SQL = f"SELECT chunk_id, text FROM ({d.FRESH_SQL}) WHERE NOT is_stale"
INDEX_CTES = f"""
live AS ({LIVE_SQL}),
words AS (SELECT chunk_id, {TOKENS_SQL} AS tokens FROM live),
totals AS (SELECT count(*) AS n_docs, sum(len(tokens))::DOUBLE / count(*)::DOUBLE AS avgdl FROM words),
postings AS (
  SELECT term, chunk_id, CAST(count(*) AS INTEGER) AS tf, any_value(dl) AS dl
  FROM (SELECT chunk_id, CAST(len(tokens) AS INTEGER) AS dl, unnest(tokens) AS term FROM words) GROUP BY term, chunk_id
),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw_idf AS (
  SELECT term, df, ln(n_docs::DOUBLE - df::DOUBLE + 0.5::DOUBLE) - ln(df::DOUBLE + 0.5::DOUBLE) AS raw_idf
  FROM freq, totals
),
term_stats AS (
  SELECT term, df,
    CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw_idf) ELSE raw_idf END AS idf
  FROM raw_idf
)"""


def _bad(name, values):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN coalesce({name} IN ({listed}), false) THEN NULL ELSE '{name}: not an allowed value' END"


from clausewright.schema import CONFIDENCES, DOCUMENT_TYPES, JURISDICTIONS  # noqa: E402

ERRORS_SQL = f"""
concat_ws('; ', CASE WHEN length(text) < 20 THEN 'text: shorter than 20 characters' END,
    {_bad('document_type', DOCUMENT_TYPES)}, {_bad('jurisdiction', JURISDICTIONS)}, {_bad('confidence', CONFIDENCES)}) AS errors"""

SQL = {
    "staleness_gate": f"""
SELECT jurisdiction, count(*) FILTER (WHERE NOT is_stale) AS chunks_valid,
  count(*) FILTER (WHERE is_stale) AS chunks_rejected_stale
FROM ({d.FRESH_SQL}) GROUP BY jurisdiction""",
    "reverify_days": f"""
SELECT chunk_id, superseded_by, is_stale, CAST(days_since_verified AS INTEGER) AS days_since_verified, needs_reverification
FROM ({d.FRESH_SQL})""",
    "flat_metadata": f"""
SELECT chunk_id, source_doc_id, chunk_index, coalesce(summary, '') AS summary, document_type, jurisdiction,
  source_title, source_url, coalesce(section_ref, '') AS section_ref, si_number, coalesce(act_year, 0) AS act_year,
  coalesce(strftime(effective_date, '%Y-%m-%d'), '') AS effective_date,
  coalesce(strftime(last_verified, '%Y-%m-%d'), '') AS last_verified,
  coalesce(nullif(trim(superseded_by, {d.WS}), ''), '') AS superseded_by,
  coalesce(strftime(expiry_date, '%Y-%m-%d'), '') AS expiry_date,
  confidence, is_verbatim, verified_url, is_stale, needs_reverification
FROM ({d.FRESH_SQL})""",
    "validation_errors": f"""
SELECT chunk_id, nullif(trim(superseded_by, {d.WS}), '') AS superseded_by, {ERRORS_SQL}
FROM (SELECT chunk_id, superseded_by, {d.select_sql(BROKEN)} FROM ({d.CORPUS_SQL}))""",
    "document_errors": f"""
SELECT source_doc_id, string_agg(DISTINCT error, '; ' ORDER BY error) AS errors FROM (
  SELECT source_doc_id, unnest(string_split(errors, '; ')) AS error FROM (
    SELECT source_doc_id, {ERRORS_SQL} FROM (SELECT source_doc_id, {d.select_sql(BROKEN)} FROM ({d.CORPUS_SQL}))))
WHERE error <> '' GROUP BY source_doc_id""",
    "tokenise_stats": f"""
SELECT chunk_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, t[1] AS first_token
FROM (SELECT chunk_id, {TOKENS_SQL} AS t FROM ({d.CORPUS_SQL}))""",
    "embed_texts": f"""
WITH words AS (SELECT chunk_id AS id, unnest({TOKENS_SQL}) AS term FROM ({d.CORPUS_SQL})),
terms AS (SELECT id, term, count(*) AS tf FROM words GROUP BY id, term), {d.hashed_ctes("terms", 64)}
SELECT id AS chunk_id, string_agg(x::VARCHAR, ' ' ORDER BY k) AS counts, round(sqrt(sum(x * x)), 6)::DOUBLE AS norm FROM hashed GROUP BY id""",
    "bm25_postings": f"WITH {INDEX_CTES} SELECT term, chunk_id, tf, dl FROM postings",
    "bm25_term_stats": f"WITH {INDEX_CTES} SELECT term, df, round(idf, 6) AS idf FROM term_stats",
    "dedupe_new_chunks": f"""
SELECT chunk_id, source_doc_id, chunk_index FROM ({d.CORPUS_SQL})
WHERE chunk_id NOT IN (SELECT {d.CHUNK_ID} FROM labels)""",
    "manifest": f"""
SELECT source_doc_id AS doc_id, min_by(source_title, chunk_index) AS title, min_by(document_type, chunk_index) AS type,
  min_by(jurisdiction, chunk_index) AS jurisdiction, count(*) AS chunk_count,
  min(ingested_second) AS first_seen_s, max(ingested_second) AS last_updated_s
FROM ({d.CORPUS_SQL}) GROUP BY source_doc_id""",
    "kb_stats": f"""
SELECT count(*) AS total_chunks, count(*) FILTER (WHERE NOT is_stale) AS indexed_chunks,
  count(DISTINCT source_doc_id) AS total_docs_ingested, max(ingested_second) AS last_updated,
  count(*) FILTER (WHERE is_stale) AS stale_chunks,
  count(*) FILTER (WHERE needs_reverification) AS chunks_needing_reverify
FROM ({d.FRESH_SQL})""",
}

from workload.splitting import INGESTION_SQL  # noqa: E402

SQL["ingestion_stats"] = INGESTION_SQL
