"""Boundary chunking of statutes made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import chunking
from workload import data as d


def chunk_boundaries(spark, sf):
    s = chunking.split_segments(d.statutes(spark, sf))
    return s.select("doc_id", "rule", F.size("segments").alias("n_segments"))


def chunk_segments(spark, sf):
    s = chunking.split_segments(d.statutes(spark, sf))
    return s.select("doc_id", F.posexplode("segments").alias("pos", "segment")).select(
        "doc_id", "pos", F.length("segment").alias("n_chars"), F.md5("segment").alias("segment_md5")
    )


def chunk_merge(spark, sf):
    s = chunking.split_segments(d.statutes(spark, sf))
    merged = s.select("doc_id", F.posexplode(chunking.merge_short(F.col("segments"))).alias("pos", "piece"))
    return merged.select("doc_id", "pos", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def chunk_texts(spark, sf):
    chunks = chunking.chunk_texts(d.statutes(spark, sf))
    return chunks.select("doc_id", "chunk_index", "text")


def chunk_records(spark, sf):
    """Stamped records: hashed id, reference label and summary of every chunk."""
    meta = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("Title of "), "source").alias("title"),
        F.lit("").alias("url"),
        F.lit("primary_act").alias("document_type"),
        F.lit("national").alias("jurisdiction"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN 'S.I. No. 600 of 2001' ELSE '' END").alias("si_number"),
        F.lit(2001).alias("act_year"),
        F.lit(None).cast("date").alias("effective_date"),
        F.lit("high").alias("confidence"),
        F.lit(True).alias("is_verbatim"),
    )
    raw = d.statutes(spark, sf).select(meta.alias("metadata"), "raw_text")
    return chunking.chunk_documents(raw, d.AS_OF).select(
        "chunk_id",
        "source_doc_id",
        "chunk_index",
        "summary",
        "section_ref",
        "source_title",
        "document_type",
        "last_verified",
        "confidence",
        "version",
    )


QUERIES = {f.__name__: f for f in (chunk_boundaries, chunk_segments, chunk_merge, chunk_texts, chunk_records)}

# The SQL marks headings with chr(1), since its pattern syntax has no look-ahead.
PATTERNS_SQL = (
    ("(?m)^(\\d+[A-Z]?\\.?—?\\s*\\(\\d+\\))", ""),
    ("(?im)^(CLASS\\s+\\d+[A-Z]?)", ""),
    ("(?im)^(Article\\s+\\d+[A-Z]?)", ""),
    ("(?m)^(\\d+\\.\\s+[A-Z][a-zA-Z\\s]+:?)$", ""),
)
_RULE = "CASE " + " ".join(
    f"WHEN len(regexp_extract_all(raw_text, '{p}')) >= 3 THEN {i}" for i, (p, _) in enumerate(PATTERNS_SQL, 1)
) + " ELSE 0 END"
_MARK = "CASE rule " + " ".join(
    f"WHEN {i} THEN regexp_replace(raw_text, '{p}', chr(1) || '\\1', 'g')" for i, (p, _) in enumerate(PATTERNS_SQL, 1)
) + " END"
SPLIT_CTES = f"""
statutes AS ({d.STATUTES_SQL}),
ruled AS (SELECT doc_id, source, raw_text, {_RULE} AS rule FROM statutes),
pieces AS (
  SELECT doc_id, source, rule, CASE WHEN rule > 0 THEN (string_split({_MARK}, chr(1)))[2:]
    ELSE list_filter(list_transform(string_split_regex(raw_text, '\\n\\n+'), lambda p: trim(p, {d.WS})), lambda p: p <> '') END AS p
  FROM ruled
),
segmented AS (
  SELECT doc_id, source, rule, CASE WHEN rule > 0
    THEN list_transform(p, lambda s, i: s || left(array_to_string(list_slice(p, i + 1, i + 100), ''), 100)) ELSE p END AS segments
  FROM pieces
)"""
# Folds over lists of segments; the state is the list of emitted texts and the buffer.
_STATE = "{'done': CAST([] AS VARCHAR[]), 'buf': ''}"
MERGE_SQL = """
list_filter(list_append(m.done, m.buf), lambda x: x <> '')"""
MERGED_CTE = """
folded AS (
  SELECT doc_id, source, list_reduce(list_transform(segments, lambda s: {'done': CAST([] AS VARCHAR[]), 'buf': s}),
    lambda acc, x: CASE WHEN length(acc.buf) + length(x.buf) < 150
      THEN {'done': acc.done, 'buf': acc.buf || chr(10) || chr(10) || x.buf}
      WHEN acc.buf <> '' THEN {'done': list_append(acc.done, acc.buf), 'buf': x.buf}
      ELSE {'done': acc.done, 'buf': x.buf} END,
    {'done': CAST([] AS VARCHAR[]), 'buf': ''}) AS m FROM segmented
),
merged AS (SELECT doc_id, source, list_filter(list_append(m.done, m.buf), lambda x: x <> '') AS pieces FROM folded)"""
PACKED_CTE = f"""
numbered AS (
  SELECT doc_id, source, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM merged
),
packed AS (
  SELECT doc_id, source, n, CASE WHEN length(piece) <= 2000 THEN [piece] ELSE (
    SELECT list_filter(list_append(m.done, m.buf), lambda x: x <> '') FROM (SELECT list_reduce(
      list_transform(string_split_regex(piece, '\\n\\n+'), lambda s: {{'done': CAST([] AS VARCHAR[]), 'buf': s}}),
      lambda acc, x: CASE WHEN length(acc.buf) + length(x.buf) <= 2000
        THEN {{'done': acc.done, 'buf': acc.buf || CASE WHEN acc.buf <> '' THEN chr(10) || chr(10) ELSE '' END || x.buf}}
        WHEN acc.buf <> '' THEN {{'done': list_append(acc.done, acc.buf), 'buf': x.buf}}
        ELSE {{'done': acc.done, 'buf': x.buf}} END,
      {{'done': CAST([] AS VARCHAR[]), 'buf': ''}}) AS m)) END AS parts FROM numbered
),
flat AS (SELECT doc_id, source, flatten(list(parts ORDER BY n)) AS parts FROM packed GROUP BY doc_id, source),
chunk_rows AS (
  SELECT doc_id, source, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS chunk_index, trim(unnest(parts), {d.WS}) AS text
  FROM flat
),
chunks AS (SELECT * FROM chunk_rows WHERE length(text) >= 150)"""
CHUNK_CTES = f"{SPLIT_CTES}, {MERGED_CTE}, {PACKED_CTE}"

REFS_SQL = "list_concat(" + ", ".join(
    f"list_slice(regexp_extract_all(text, '{p}', 1, 'i'), 1, 2)"
    for p in (
        "(Class\\s+\\d+[A-Z]?\\b)",
        "(section\\s+\\d+[A-Z]?\\s*\\(\\d+\\))",
        "(section\\s+\\d+[A-Z]?\\b)",
        "(article\\s+\\d+[A-Z]?\\b)",
        "(S\\.I\\.\\s+No\\.\\s+\\d+\\s+of\\s+\\d{4})",
    )
) + ")"

SQL = {
    "chunk_boundaries": f"""
WITH {SPLIT_CTES} SELECT doc_id, CAST(rule AS INTEGER) AS rule, CAST(len(segments) AS INTEGER) AS n_segments FROM segmented""",
    "chunk_segments": f"""
WITH {SPLIT_CTES}, rows_ AS (
  SELECT doc_id, CAST(generate_subscripts(segments, 1) - 1 AS INTEGER) AS pos, unnest(segments) AS s FROM segmented)
SELECT doc_id, pos, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS segment_md5 FROM rows_""",
    "chunk_merge": f"""
WITH {SPLIT_CTES}, {MERGED_CTE}, rows_ AS (
  SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS INTEGER) AS pos, unnest(pieces) AS s FROM merged)
SELECT doc_id, pos, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS piece_md5 FROM rows_""",
    "chunk_texts": f"WITH {CHUNK_CTES} SELECT doc_id, chunk_index, text FROM chunks",
    "chunk_records": f"""
WITH {CHUNK_CTES},
found AS (
  SELECT *, {REFS_SQL} AS refs, CASE WHEN doc_id % 4 = 0 THEN 'S.I. No. 600 of 2001' ELSE '' END AS si,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, {d.WS})), lambda l: length(l) > 20)[1] AS line
  FROM chunks
)
SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(chunk_index AS VARCHAR) || '|' || text) AS chunk_id,
  CAST(doc_id AS VARCHAR) AS source_doc_id, chunk_index,
  coalesce(left(line, 120) || CASE WHEN length(line) > 120 THEN '...' ELSE '' END, left(text, 120)) AS summary,
  array_to_string(list_slice(CASE WHEN si <> '' AND NOT contains(array_to_string(refs, ' '), si)
    THEN list_prepend(si, refs) ELSE refs END, 1, 4), ' | ') AS section_ref,
  'Title of ' || source AS source_title, 'primary_act' AS document_type, DATE '{d.AS_OF}' AS last_verified,
  'high' AS confidence, '1.0' AS version
FROM found""",
}

INGESTION_SQL = f"""
WITH {CHUNK_CTES},
docs AS (SELECT doc_id, {d.CORPUS['superseded_by']} AS superseded_by FROM documents),
gated AS (
  SELECT c.doc_id, nullif(trim(superseded_by, {d.WS}), '') IS NOT NULL AS is_stale
  FROM chunks c JOIN docs USING (doc_id)
)
SELECT (SELECT count(*) FROM statutes) AS sources_attempted,
  (SELECT count(*) FROM statutes WHERE raw_text <> '') AS sources_succeeded,
  (SELECT CAST(sum(length(raw_text)) AS BIGINT) FROM statutes) AS total_chars,
  (SELECT count(*) FROM gated) AS total_chunks,
  (SELECT count(*) FROM gated WHERE is_stale) AS chunks_rejected_stale,
  (SELECT count(*) FROM gated WHERE NOT is_stale AND doc_id NOT IN (SELECT doc_id FROM labels)) AS chunks_added"""
