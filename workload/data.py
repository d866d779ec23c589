"""Inputs of the queries, derived from whole tables, once for Spark and once as SQL.

The expressions are shared by both engines, so that a query and its SQL start
from the same rows and differ only in what is under test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.arrays import l2_normalise
from clausewright.operators.sizing import once, spread
from clausewright.schema import CONFIDENCES, DOCUMENT_TYPES, JURISDICTIONS

AS_OF = "2024-02-01"


def pick(values: tuple[str, ...], index: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST({index} AS INT) + 1)"


def text_of(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


CHUNK_ID = f"lpad({text_of('doc_id')}, 12, '0')"

# Wording that the raw documents lack: references, instruments and numbers with units.
LEGAL_TAIL = (
    f"text || ' Class ' || {text_of('doc_id % 12 + 1')} || ' applies under section ' || {text_of('doc_id % 9 + 1')}"
    f" || '(2) and S.I. No. ' || {text_of('doc_id % 50 + 600')} || ' of 2001, up to '"
    f" || {text_of('doc_id % 60 + 10')} || ' square metres within ' || {text_of('doc_id % 8 + 1')} || ' weeks.'"
)

CORPUS = {
    "chunk_id": CHUNK_ID,
    "source_doc_id": "source",
    "chunk_index": "CAST(doc_id AS INT)",
    "text": LEGAL_TAIL,
    "summary": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang || ' text' END",
    "document_type": pick(DOCUMENT_TYPES, "doc_id % 7"),
    "jurisdiction": pick(JURISDICTIONS, "doc_id % 32"),
    "source_title": "'Title of ' || source",
    "source_url": "'https://example.org/' || source",
    "section_ref": (
        f"CASE doc_id % 4 WHEN 0 THEN 'Class ' || {text_of('doc_id % 12 + 1')} || ' | S.I. No. ' || "
        f"{text_of('doc_id % 50 + 600')} || ' of 2001' WHEN 1 THEN 'section ' || {text_of('doc_id % 9 + 1')} "
        f"WHEN 2 THEN '' ELSE NULL END"
    ),
    "si_number": "CASE WHEN doc_id % 5 = 0 THEN 'S.I. No. 600 of 2001' ELSE '' END",
    "act_year": "CASE WHEN doc_id % 5 = 1 THEN NULL ELSE CAST(2000 + doc_id % 25 AS INT) END",
    "effective_date": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE DATE '2001-10-01' + CAST(doc_id % 5000 AS INT) END",
    "last_verified": "DATE '2024-01-31' - CAST(doc_id % 60 AS INT)",
    "superseded_by": (
        "CASE WHEN doc_id % 17 = 0 THEN '  S.I. No. 9 of 2023 ' WHEN doc_id % 17 = 1 THEN '   ' ELSE NULL END"
    ),
    "expiry_date": "CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-28' + CAST(doc_id % 30 AS INT) ELSE NULL END",
    "confidence": pick(CONFIDENCES, "doc_id % 3"),
    "is_verbatim": "doc_id % 2 = 0",
    "verified_url": "doc_id % 3 = 1",
    "ingested_second": "1705276800 + doc_id",
}

# Each line of a document becomes a paragraph, some of them under a heading.
HEADING = (
    "CASE WHEN ({i} + doc_id) % (1 + doc_id % 3) <> 0 THEN '' "
    "WHEN doc_id % 5 = 0 THEN CAST({i} + 1 AS STRING) || CASE WHEN {i} % 2 = 0 THEN 'A' ELSE '' END || '.—(' "
    "|| CAST({i} % 4 + 1 AS STRING) || ') ' "
    "WHEN doc_id % 5 = 1 THEN CASE WHEN {i} % 2 = 0 THEN 'CLASS ' ELSE 'Class ' END || CAST({i} + 1 AS STRING) || ' — ' "
    "WHEN doc_id % 5 = 2 THEN 'Article ' || CAST({i} + 1 AS STRING) || ' ' "
    "WHEN doc_id % 5 = 3 THEN CAST({i} + 1 AS STRING) || '. Design Standards:' || chr(10) "
    "ELSE '' END"
)
TRAILER = (
    "CASE WHEN {i} % 3 = 1 THEN ' See class ' || CAST({i} % 9 + 1 AS STRING) || ' and section ' "
    "|| CAST({i} % 5 + 1 AS STRING) || '(2); S.I. No. ' || CAST({i} % 7 + 600 AS STRING) || ' of 2001 allows ' "
    "|| CAST({i} + 10 AS STRING) || ' square metres.' "
    "WHEN {i} % 4 = 2 THEN ' Article ' || CAST({i} % 6 + 1 AS STRING) || ' applies.' ELSE '' END"
)
SEPARATOR = "CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END"

# Questions: the benchmark passages, some opened by a phrase that the rules react to.
ASKS = {
    "query_id": text_of("item_id"),
    "query": (
        "CASE item_id % 5 WHEN 0 THEN 'Is a garden shed exempt? ' || text WHEN 1 THEN 'How do I appeal? ' || text "
        "WHEN 2 THEN 'Can I add an extension under Class 1? ' || text ELSE text END"
    ),
    "jurisdiction": f"CASE WHEN item_id % 3 = 0 THEN NULL ELSE {pick(JURISDICTIONS, 'item_id % 32')} END",
    "doc_type": f"CASE WHEN item_id % 4 = 1 THEN {pick(DOCUMENT_TYPES, 'item_id % 7')} ELSE NULL END",
    "top_k": "CAST(1 + item_id % 10 AS INT)",
}

# A turn of a conversation as a question, with wording injected by its ids.
TURN_QUERY = (
    "CASE conv_id % 9 WHEN 0 THEN 'Is a shed exempt? ' WHEN 1 THEN 'An APPEAL against enforcement: ' "
    "WHEN 2 THEN 'Do I need permission for an extension? ' WHEN 3 THEN 'How long does it take? ' "
    "WHEN 4 THEN 'Section 5 Declaration and compensation. ' WHEN 5 THEN 'Which outbuilding rules? ' "
    "WHEN 6 THEN 'What documents do I submit? ' ELSE '' END || text"
)
TURN_ANSWER = (
    f"text || ' Class ' || {text_of('conv_id % 14 + 1')} || ', Section ' || {text_of('turn % 9 + 1')} || ' and Schedule 2: '"
    f" || {text_of('conv_id % 65 + 5')} || ' square metres, ' || {text_of('turn + 1')} || ' weeks, 12 sq m; S.I. No. '"
    f" || {text_of('conv_id % 60 + 600')} || ' of 2001'"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def select_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


# -- Spark -----------------------------------------------------------------------------


def corpus(spark: SparkSession, sf: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id", keep=keep)
    return docs.selectExpr(*[f"{e} AS {n}" for n, e in CORPUS.items()]).withColumn(
        "ingested_at", F.timestamp_seconds("ingested_second")
    )


def fresh_corpus(spark: SparkSession, sf: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    from clausewright.operators.validation import with_freshness

    return with_freshness(corpus(spark, sf, keep), AS_OF)


def statutes(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    body = f"{HEADING} || line || {TRAILER}".replace("{i}", "i")
    return docs.selectExpr(
        "doc_id",
        "source",
        f"array_join(transform(split(text, '\\n'), (line, i) -> {body}), {SEPARATOR}) AS raw_text",
    )


def asks(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").selectExpr("item_id", *[f"{e} AS {n}" for n, e in ASKS.items()])
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return items.join(vectors, items.item_id == vectors.vec_id).drop("item_id", "vec_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", *[f"{CORPUS[c]} AS {c}" for c in ("chunk_id", "jurisdiction", "document_type", "superseded_by", "expiry_date")]
    )
    from clausewright.functions.freshness import is_stale

    return (
        spread(table(spark, sf, "embeddings"), "vec_id")
        .join(docs, F.col("vec_id") == F.col("doc_id"))
        .select(
            "chunk_id",
            l2_normalise(F.col("embedding")).alias("embedding"),
            "jurisdiction",
            "document_type",
            is_stale(F.col("superseded_by"), F.col("expiry_date"), AS_OF).alias("is_stale"),
        )
    )


def boost_vector(spark: SparkSession, sf: str) -> list[float]:
    """Mean of all vectors, as the vector of the boost text: one number per dimension."""

    def mean():
        numbers = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
        means = numbers.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return [r.x for r in means.orderBy("pos").collect()]

    return once(spark, f"boost vector {sf}", mean)


# -- SQL -------------------------------------------------------------------------------

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
STALE_SQL = (
    f"(nullif(trim(superseded_by, {WS}), '') IS NOT NULL OR coalesce(DATE '{AS_OF}' > expiry_date, false))"
)
CORPUS_SQL = f"SELECT {select_sql(CORPUS)} FROM documents"
FRESH_SQL = (
    f"SELECT *, {STALE_SQL} AS is_stale, date_diff('day', last_verified, DATE '{AS_OF}') AS days_since_verified, "
    f"date_diff('day', last_verified, DATE '{AS_OF}') > 30 AS needs_reverification FROM ({CORPUS_SQL})"
)
STATUTES_SQL = (
    "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN array_to_string(lines, chr(10)) "
    "ELSE array_to_string(lines, chr(10) || chr(10)) END AS raw_text FROM ("
    "SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda line, pos: "
    + f"{HEADING} || line || {TRAILER}".replace("{i}", "(pos - 1)")
    + ") AS lines FROM documents)"
)
ASKS_SQL = (
    f"SELECT {select_sql(ASKS)}, embedding FROM benchmark JOIN embeddings ON vec_id = item_id"
)
VECTORS_SQL = (
    "SELECT f.chunk_id, CAST(e.embedding AS DOUBLE[]) AS embedding, f.jurisdiction, f.document_type "
    f"FROM embeddings e JOIN ({FRESH_SQL}) f ON f.chunk_index = e.vec_id WHERE NOT f.is_stale"
)
BOOST_VECTOR_SQL = (
    "SELECT list(x ORDER BY pos) AS embedding FROM (SELECT pos, avg(CAST(x AS DOUBLE)) AS x FROM "
    "(SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)"
)


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII string, which DuckDB lacks."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda v, i: xor(v >> 1, (v & 1) * 3988292384)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), {step}))"
    return f"xor({crc}, 4294967295)"


def hashed_ctes(terms: str, dimensions: int) -> str:
    """``hashed(id, k, x)``: signed token counts by dimension, of rows ``id, term, tf``."""
    return f"""
    codes AS (SELECT term, {crc32_sql("term")} AS crc FROM (SELECT DISTINCT term FROM {terms})),
    hashed AS (
      SELECT id, k, coalesce(x, 0)::BIGINT AS x FROM (SELECT DISTINCT id FROM {terms}) CROSS JOIN range({dimensions}) g(k) LEFT JOIN (
        SELECT id, crc % {dimensions} AS k, sum(CASE WHEN crc & 32768 <> 0 THEN tf ELSE -tf END) AS x
        FROM {terms} JOIN codes USING (term) GROUP BY ALL) USING (id, k))"""
