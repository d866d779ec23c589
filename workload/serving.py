"""Page extraction, the fetch cache, requests, councils, feedback and whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import generation
from clausewright.plans import service
from clausewright.schema import COUNCILS, JURISDICTIONS
from clausewright.sources import extract, reading
from workload import data as d
from workload.answers import CHUNK_FIELDS_SQL, RESPONSE_SQL, joined, response_columns, response_ctes
from workload.records import searched
from workload.retrieval import HYBRID_CTES


def html_extract(spark, sf):
    pages = d.spread(d.table(spark, sf, "pages"), "page_id")
    return pages.select("page_id", extract.html_text(F.col("html")).alias("main_text"))


# The given pages with another kind of main container in place of their article; every fourth keeps it and has no html, head and body tags.
CONTAINER = {
    0: ("<main>", "</main>"),
    1: ('<div id="content">', "</div>"),
    2: ('<section class="page Main-text">', "</section>"),
}


def _container(which: int) -> str:
    return "CASE page_id % 4 " + " ".join(f"WHEN {k} THEN '{v[which]}'" for k, v in CONTAINER.items()) + " END"


WRAPPED = (
    "CASE WHEN page_id % 4 = 3 THEN regexp_replace(html, '(?i)</?(html|head|body)[^>]*>', '') "
    f"ELSE replace(replace(html, '<article>', {_container(0)}), '</article>', {_container(1)}) END"
)


def html_containers(spark, sf):
    pages = d.spread(d.table(spark, sf, "pages"), "page_id").selectExpr("page_id", f"{WRAPPED} AS html")
    return pages.select("page_id", extract.html_text(F.col("html")).alias("main_text"))


PAGE_SOURCE = f"CASE WHEN page_id % 7 = 0 THEN 'local://' || {d.text_of('page_id')} || '.txt' ELSE url END"


def cache_keys(spark, sf):
    """Pages as sources; the labelled ids count as fetched already."""
    sources = d.table(spark, sf, "pages").selectExpr(f"{d.text_of('page_id')} AS id", f"{PAGE_SOURCE} AS url")
    known = d.table(spark, sf, "labels").selectExpr(f"{d.text_of('doc_id')} AS id")
    cache = sources.join(known, "id", "left_semi").select(reading.cache_key(F.col("id"), F.col("url")).alias("cache_key"))
    return reading.cache_misses(sources, cache).select("id", "url", "cache_key")


REQUEST = {
    "request": f"{d.text_of('conv_id')} || '-' || {d.text_of('turn')}",
    "query": (
        "CASE conv_id % 6 WHEN 0 THEN 'hi' WHEN 1 THEN '      a      ' WHEN 2 THEN text || text || text ELSE text END"
    ),
    "council": (
        "CASE conv_id % 5 WHEN 0 THEN 'moon_base' WHEN 1 THEN NULL WHEN 2 THEN 'national' "
        f"ELSE {d.pick(JURISDICTIONS, 'conv_id % 32')} END"
    ),
    "top_k": "CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(turn * 3 AS INT) END",
}


def request_validation(spark, sf):
    requests = d.table(spark, sf, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in REQUEST.items()])
    return service.validate_requests(requests).select(
        "request", "council", "top_k", joined(F.col("errors")).alias("errors"), "status", "jurisdiction", "form_ok"
    )


def council_coverage(spark, sf):
    """Every council by name, with the chunks that its own rules contribute."""
    chunks = d.corpus(spark, sf).groupBy(F.col("jurisdiction").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    return (
        service.councils(spark)
        .join(chunks, "slug", "left")
        .select("slug", "name", F.coalesce("n", F.lit(0)).alias("n_chunks"))
    )


FEEDBACK = {
    "request_id": d.text_of("event_id"),
    "event_type": "event_type",
    "helpful": "value < 20",
    "comment": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE props END",
}


def feedback_summary(spark, sf):
    rows = d.table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in FEEDBACK.items()])
    return service.feedback_summary(rows, "event_type")


API = {
    "query_id": d.ASKS["query_id"],
    "query": d.ASKS["query"],
    "council": (
        f"CASE WHEN item_id % 11 = 0 THEN 'moon_base' WHEN item_id % 3 = 0 THEN 'national' ELSE {d.pick(JURISDICTIONS, 'item_id % 32')} END"
    ),
    "top_k": "CAST(1 + item_id % 12 AS INT)",
}


def api_requests(spark, sf):
    items = d.table(spark, sf, "benchmark").selectExpr("item_id", *[f"{e} AS {n}" for n, e in API.items()])
    vectors = d.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return items.join(vectors, items.item_id == vectors.vec_id).drop("item_id", "vec_id")


def _retrieved(spark, sf):
    from clausewright.plans.retrieval import retrieve

    checked = service.validate_requests(api_requests(spark, sf)).where(F.col("status") == 200)
    return retrieve(*searched(spark, sf), checked, d.boost_vector(spark, sf))


def answer_end_to_end(spark, sf):
    """Valid requests through retrieval, checking and the mock answer."""
    return response_columns(generation.generate_answers(_retrieved(spark, sf)))


def _answered(spark, sf, requests):
    rows = service.answer_requests(*searched(spark, sf), requests, d.boost_vector(spark, sf))
    return rows.select(
        "query_id",
        "council",
        "status",
        joined(F.col("errors")).alias("errors"),
        "query_type",
        F.col("answer.confidence").alias("confidence"),
        F.col("answer.badge").alias("badge"),
        F.col("answer.is_blocked").alias("is_blocked"),
        F.size("answer.citations").alias("n_citations"),
        F.col("meta.chunks_retrieved").alias("chunks_retrieved"),
        F.round("meta.retrieval_quality", 6).alias("retrieval_quality"),
    )


def answer_requests(spark, sf):
    """Nested responses for every request, invalid ones included."""
    return _answered(spark, sf, api_requests(spark, sf))


# Vectors as a faulty embedder would give them: none, too short, with a number missing.
DAMAGED = {
    0: "CAST(NULL AS array<float>)",
    1: "slice(embedding, 1, 3)",
    2: "transform(embedding, (x, i) -> CASE WHEN i = 5 THEN CAST(NULL AS float) ELSE x END)",
    3: "transform(embedding, (x, i) -> CASE WHEN i = 5 THEN CAST('NaN' AS float) ELSE x END)",
}


def request_failures(spark, sf):
    """Requests of which every second one has a vector that cannot be searched; the others are answered."""
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in DAMAGED.items())
    damaged = F.expr(f"CASE CAST(query_id AS long) % 8 {whens} ELSE embedding END")
    return _answered(spark, sf, api_requests(spark, sf).withColumn("embedding", damaged))


def response_log(spark, sf):
    return generation.response_log(generation.generate_answers(_retrieved(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        html_extract,
        html_containers,
        cache_keys,
        request_validation,
        council_coverage,
        feedback_summary,
        answer_end_to_end,
        answer_requests,
        request_failures,
        response_log,
    )
}

# -- SQL -------------------------------------------------------------------------------

_ERRORS = """concat_ws('; ', CASE WHEN length(coalesce(query, '')) < 10 THEN 'query: shorter than 10 characters' END,
  CASE WHEN length(query) > 500 THEN 'query: longer than 500 characters' END,
  CASE WHEN top_k < 1 OR top_k > 10 THEN 'top_k: not within 1 and 10' END,
  CASE WHEN council NOT IN ({domain}) THEN 'Unknown council: ''' || council || '''' END)""".format(
    domain=", ".join(f"'{j}'" for j in JURISDICTIONS)
)
_SLUGS = "[" + ", ".join(f"'{c}'" for c in COUNCILS) + "]"
_ARTICLE = "regexp_extract(html, '(?is)<article>(.*)</article>', 1)"
_PIECES = (
    f"list_filter(list_transform(string_split(regexp_replace({_ARTICLE}, '<[^>]*>', chr(1), 'g'), chr(1)), "
    f"lambda t: trim(replace(replace(replace(replace(t, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), {d.WS})), lambda t: t <> '')"
)
_CHECKED = f"""
requests AS (
  SELECT *, {_ERRORS} AS errors FROM (SELECT {d.select_sql(API)}, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)
)"""
_VALID = (
    "SELECT query_id, query, council, top_k, CASE WHEN council <> 'national' THEN council END AS jurisdiction, "
    "CAST(NULL AS VARCHAR) AS doc_type, embedding FROM requests WHERE errors = ''"
)
_API_CTES = f"""
{_CHECKED}, {HYBRID_CTES.replace(d.ASKS_SQL, _VALID)},
lists AS (SELECT query_id, list({CHUNK_FIELDS_SQL.replace("'is_stale': is_stale", "'is_stale': false")} ORDER BY rank) AS chunks FROM final GROUP BY query_id),
sample_ AS (SELECT chunks FROM lists LIMIT 1),
cases AS (
  SELECT q.query_id, q.query, '' AS generated, r.council, q.retrieval_quality, q.total_dense_hits, q.total_sparse_hits,
    coalesce(l.chunks, (SELECT list_filter(chunks, lambda c: false) FROM sample_)) AS chunks
  FROM quality q JOIN requests r USING (query_id) LEFT JOIN lists l USING (query_id)
),
{response_ctes('cases')},
responses AS ({RESPONSE_SQL} FROM post)"""

_MAIN_TEXT = f"""
SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string({_PIECES}, chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'),
  ' {{2,}}', ' ', 'g'), {d.WS}) AS main_text FROM pages"""


def _answers_sql(status: str, ctes: str) -> str:
    return f"""
WITH {ctes}
SELECT r.query_id, r.council, {status} AS status, r.errors, s.query_type, s.confidence,
  CASE WHEN s.confidence = 'blocked' AND NOT s.is_blocked THEN 'low' ELSE s.confidence END AS badge, s.is_blocked,
  CASE WHEN s.cited IS NULL THEN NULL WHEN s.cited = '' THEN 0 ELSE CAST(len(string_split(s.cited, '; ')) AS INTEGER) END AS n_citations,
  q.n_chunks AS chunks_retrieved, round(q.retrieval_quality, 6) AS retrieval_quality
FROM requests r LEFT JOIN responses s USING (query_id) LEFT JOIN quality q USING (query_id)"""


SQL = {
    "html_extract": _MAIN_TEXT,
    "html_containers": _MAIN_TEXT,
    "cache_keys": f"""
SELECT id, url, id || '_' || left(md5(url), 8) AS cache_key FROM (SELECT CAST(page_id AS VARCHAR) AS id, {PAGE_SOURCE} AS url FROM pages)
WHERE NOT starts_with(url, 'local://') AND id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "request_validation": f"""
SELECT request, council, top_k, errors, CASE WHEN errors = '' THEN 200 ELSE 422 END AS status,
  CASE WHEN council <> 'national' THEN council END AS jurisdiction, length(trim(query, {d.WS})) >= 10 AS form_ok
FROM (SELECT *, {_ERRORS} AS errors FROM (
  SELECT request, query, coalesce(council, 'national') AS council, coalesce(top_k, 5) AS top_k
  FROM (SELECT {d.select_sql(REQUEST)} FROM conversations)))""",
    "council_coverage": f"""
SELECT slug, array_to_string(list_transform(string_split(slug, '_'), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') AS name,
  coalesce(n, 0) AS n_chunks
FROM (SELECT unnest({_SLUGS}) AS slug) LEFT JOIN (SELECT jurisdiction AS slug, count(*) AS n FROM ({d.CORPUS_SQL}) GROUP BY 1) USING (slug)""",
    "feedback_summary": f"""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE helpful) AS n_helpful, count(*) FILTER (WHERE NOT helpful) AS n_unhelpful,
  count(*) FILTER (WHERE NOT helpful AND comment IS NOT NULL) AS n_unhelpful_with_comment
FROM (SELECT {d.select_sql(FEEDBACK)} FROM events) GROUP BY event_type""",
    "answer_end_to_end": f"WITH {_API_CTES} SELECT * FROM responses",
    "answer_requests": _answers_sql("CASE WHEN r.errors = '' THEN 200 ELSE 422 END", _API_CTES),
    "request_failures": _answers_sql(
        "CASE WHEN r.errors = '' THEN 200 WHEN r.errors = 'Retrieval failed' THEN 500 ELSE 422 END",
        _API_CTES.replace(
            f"SELECT *, {_ERRORS} AS errors",
            f"SELECT *, CASE WHEN {_ERRORS} = '' AND CAST(query_id AS BIGINT) % 8 < {len(DAMAGED)} THEN 'Retrieval failed' ELSE {_ERRORS} END AS errors",
        ),
    ),
    "response_log": f"""
WITH {_API_CTES} SELECT CASE WHEN is_blocked THEN 'BLOCKED' ELSE 'OK' END AS status, query_type, confidence, count(*) AS n
FROM responses GROUP BY 1, 2, 3""",
}
