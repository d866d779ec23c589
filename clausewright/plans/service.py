"""The request surface: validation, answers, councils, statistics, health and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import __version__
from clausewright.functions.arrays import present
from clausewright.functions.text import ws_trim
from clausewright.operators import generation, search
from clausewright.operators.fusion import lexical_score
from clausewright.operators.sizing import materialise
from clausewright.plans.knowledge import KnowledgeBase
from clausewright.plans.retrieval import retrieve
from clausewright.schema import COUNCILS, JURISDICTIONS, NATIONAL

# Request limits and defaults.
MIN_QUERY_CHARS = 10
MAX_QUERY_CHARS = 500
MIN_TOP_K, MAX_TOP_K, DEFAULT_TOP_K = 1, 10, 5
FEEDBACK_STATUS = "received"
RETRIEVAL_FAILED = "Retrieval failed"


def council_name(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def councils(spark: SparkSession) -> DataFrame:
    """The 31 councils, ordered by name."""
    rows = spark.createDataFrame([(c,) for c in COUNCILS], "slug string")
    return rows.withColumn("name", council_name(F.col("slug"))).orderBy("name")


def request_id(prefix: str = "req_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fills defaults and adds ``errors``, ``status`` (200 or 422) and the ``jurisdiction`` to search.

    ``national`` means no filter. ``form_ok`` tells whether the question would
    pass the form's own check, which strips it first.
    """
    council = F.coalesce("council", F.lit(NATIONAL))
    top_k = F.coalesce("top_k", F.lit(DEFAULT_TOP_K))
    size = F.coalesce(F.length("query"), F.lit(0))
    errors = present(
        F.when(size < MIN_QUERY_CHARS, f"query: shorter than {MIN_QUERY_CHARS} characters"),
        F.when(size > MAX_QUERY_CHARS, f"query: longer than {MAX_QUERY_CHARS} characters"),
        F.when((top_k < MIN_TOP_K) | (top_k > MAX_TOP_K), f"top_k: not within {MIN_TOP_K} and {MAX_TOP_K}"),
        F.when(~council.isin(*JURISDICTIONS), F.concat(F.lit("Unknown council: '"), council, F.lit("'"))),
    )
    return (
        requests.withColumns({"council": council, "top_k": top_k})
        .withColumn("errors", errors)
        .withColumn("status", F.when(F.size("errors") == 0, 200).otherwise(422))
        .withColumn("jurisdiction", F.when(F.col("council") != NATIONAL, F.col("council")))
        .withColumn("form_ok", F.coalesce(F.length(ws_trim(F.col("query"))), F.lit(0)) >= MIN_QUERY_CHARS)
    )


def nest_response(responses: DataFrame) -> DataFrame:
    """Answer and meta structs, as a client receives them."""
    answer = F.struct(
        F.col("answer_summary").alias("summary"),
        F.to_json("full_answer").alias("full"),
        "citations",
        "confidence",
        F.col("user_warning").alias("warning"),
        "disclaimer",
        F.col("requires_escalation").alias("escalation"),
        "is_blocked",
        "block_reason",
        generation.badge(F.col("confidence"), F.col("full_answer")).alias("badge"),
        generation.useful_answer(F.col("full_answer")).alias("useful"),
    )
    meta = F.struct("chunks_retrieved", "retrieval_quality", "llm_provider")
    return responses.select("query_id", "query_type", answer.alias("answer"), meta.alias("meta"))


def unusable_vector(embedding: Column, width: int | None = None) -> Column:
    """True for a vector that cannot be searched: NULL, empty, of another width than the store's, or with a number missing."""
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    odd = F.size(embedding) != width if width else F.size(embedding) == 0
    return F.coalesce(odd | broken, F.lit(True))


def mark_failures(checked: DataFrame, width: int | None = None) -> DataFrame:
    """Valid requests whose retrieval must fail get status 500 and one error; the others stay as they are."""
    failing = (F.col("status") == 200) & unusable_vector(F.col("embedding"), width)
    return checked.withColumns(
        {
            "errors": F.when(failing, F.array(F.lit(RETRIEVAL_FAILED))).otherwise(F.col("errors")),
            "status": F.when(failing, 500).otherwise(F.col("status")),
        }
    )


def answer_requests(
    index, chunks: DataFrame, vectors: DataFrame, requests: DataFrame, boost_vector=None, provider=None, scorer=lexical_score
) -> DataFrame:
    """One response per request ``(query_id, query, council, top_k, embedding)``, invalid ones included.

    ``status`` is 200, 422 for a request that breaks the limits, or 500 for one whose vector cannot be searched; only
    requests of status 200 are searched and have an answer, so a broken one does not stop its batch. The width that
    vectors must have is that of ``boost_vector``, where there is one.
    """
    checked = mark_failures(validate_requests(requests), len(boost_vector) if boost_vector is not None else None)
    valid = checked.where(F.col("status") == 200)
    results = retrieve(index, chunks, vectors, valid, boost_vector, scorer)
    nested = nest_response(generation.generate_answers(results, provider))
    return (
        checked.drop("embedding", "jurisdiction", "form_ok")
        .join(nested, "query_id", "left")
        .withColumn("request_id", request_id())
    )


class Service:
    """Answers batches of requests from a stored knowledge base."""

    def __init__(self, kb: KnowledgeBase, provider=None, scorer=lexical_score, as_of=None):
        self.kb, self.provider, self.scorer, self.as_of = kb, provider, scorer, as_of
        probe = kb.spark.createDataFrame([(search.BOOST_TEXT,)], "text string")
        self.boost_vector = probe.select(kb.embed(F.col("text")).alias("v")).first().v

    def answer(self, requests: DataFrame) -> DataFrame:
        if "query_id" not in requests.columns:
            requests = materialise(requests.withColumn("query_id", F.uuid()))
        asked = requests.withColumn("embedding", self.kb.embed(F.col("query")))
        return answer_requests(
            self.kb.sparse_index(requests),
            self.kb.fresh_chunks(self.as_of),
            self.kb.searchable(self.as_of),
            asked,
            self.boost_vector,
            self.provider,
            self.scorer,
        )

    def stats(self) -> DataFrame:
        return self.kb.stats(self.as_of)

    def sources(self) -> DataFrame:
        return self.kb.list_sources()

    def health(self) -> DataFrame:
        chunks = F.col("total_chunks")
        return self.kb.chunk_total().select(
            F.when(chunks > 0, "healthy").otherwise("not loaded").alias("status"),
            F.when(chunks > 0, 200).otherwise(503).alias("status_code"),
            F.lit(__version__).alias("version"),
            chunks.alias("kb_chunks"),
            F.current_timestamp().alias("timestamp"),
        )

    def submit_feedback(self, feedback: DataFrame) -> dict:
        self.kb.add_feedback(feedback)
        return {"status": FEEDBACK_STATUS, "message": "Thank you, your feedback was stored."}


def feedback_summary(feedback: DataFrame, *by: str) -> DataFrame:
    """Helpful and unhelpful counts; unhelpful answers with a comment are counted apart."""
    return feedback.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("helpful").alias("n_helpful"),
        F.count_if(~F.col("helpful")).alias("n_unhelpful"),
        F.count_if(~F.col("helpful") & F.col("comment").isNotNull()).alias("n_unhelpful_with_comment"),
    )
