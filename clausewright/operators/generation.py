"""Query classification, answer parsing, citations and the assembled response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrays import let
from clausewright.functions.text import contains_any, left, rx, ws_trim
from clausewright.operators.checking import check_answers
from clausewright.operators.fusion import accessor, context_string
from clausewright.operators.prompts import RESPONSE_DISCLAIMER, SYSTEM_PROMPT, build_prompt
from clausewright.operators.providers import MockProvider
from clausewright.schema import NATIONAL

# Keywords of the three query types, tried in this order.
EXEMPTION_KEYWORDS = (
    "exempt",
    "exempted",
    "exemption",
    "permission needed",
    "do i need",
    "require permission",
    "need planning",
    "without permission",
    "shed",
    "solar",
    "fence",
    "gate",
    "attic",
    "garage conversion",
    "porch",
)
ELIGIBILITY_KEYWORDS = (
    "need planning",
    "require planning",
    "planning permission for",
    "do i need permission",
    "is permission required",
    "extension",
    "conservatory",
    "outbuilding",
)
PROCESS_KEYWORDS = (
    "how do i apply",
    "how to apply",
    "application process",
    "how long does",
    "appeal",
    "timeline",
    "what documents",
    "how much does",
    "planning fee",
    "submit",
    "observation",
)

# Confidence labels from lowest to highest.
LABEL_ORDER = ("blocked", "low", "medium", "high")

SENTINEL = "end of the answer \u241e"

# How an answer may be wrapped.
FENCED = r"```(?:json)?\s*([\s\S]*?)```"
BRACED = r"\{[\s\S]*\}"

# Texts that stand in results where an answer lacks them.
DEFAULT_SUMMARY = "No summary available."
FALLBACK_SUMMARY = "Please try rephrasing your question."

# Texts of this engine.
FALLBACK_NEXT_STEP = "Take the question to the authority that decides such cases."
FALLBACK_CITATION = "Unparsed reply"
ERROR_SUMMARY = "This question could not be processed."
ERROR_WARNING = "The answer provider did not reply."

DISPLAY_KEYS = {
    "query": "query",
    "query_type": "query_type",
    "summary": "answer_summary",
    "answer": "full_answer",
    "citations": "citations",
    "confidence": "confidence",
    "warning": "user_warning",
    "disclaimer": "disclaimer",
    "escalation": "requires_escalation",
    "is_blocked": "is_blocked",
    "block_reason": "block_reason",
}


def classify_query(query: Column) -> Column:
    q = F.lower(query)
    return (
        F.when(contains_any(q, EXEMPTION_KEYWORDS), "EXEMPTION")
        .when(contains_any(q, ELIGIBILITY_KEYWORDS), "ELIGIBILITY")
        .when(contains_any(q, PROCESS_KEYWORDS), "PROCESS")
        .otherwise("ELIGIBILITY")
    )


def fallback_answer(raw: Column) -> Column:
    summary = ws_trim(F.regexp_replace(left(raw, 300), r"[{}\[\]]", ""))
    body = F.struct(
        F.when(summary == "", FALLBACK_SUMMARY).otherwise(summary).alias("answer_summary"),
        F.lit("low").alias("confidence"),
        F.array(F.lit(1)).alias("chunks_used"),
        F.array(F.struct(left(raw, 400).alias("point"), F.lit(FALLBACK_CITATION).alias("citation"))).alias("reasoning"),
        F.lit(FALLBACK_NEXT_STEP).alias("what_to_do_next"),
    )
    return F.parse_json(F.to_json(body))


def whole_json(text: Column) -> Column:
    """The JSON value that a text consists of; NULL if more follows it.

    The parser stops after the first value, so the text is put before a sentinel in a list: the sentinel comes second
    only if one value and nothing else stands before it.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{SENTINEL}"]')))

    def first(both: Column) -> Column:
        single = F.try_variant_get(both, "$[1]", "string") == SENTINEL
        closed = F.try_variant_get(both, "$[2]", "variant").isNull()
        return F.when(single & closed, F.try_variant_get(both, "$[0]", "variant"))

    return let(pair, first)


def parse_answer(raw: Column) -> Column:
    """VARIANT object from an answer text: whole, fenced, braced, else the fallback.

    JSON that is not an object takes the fallback too.
    """

    def tried(clean: Column) -> Column:
        fenced = ws_trim(F.regexp_extract(clean, rx(FENCED), 1))
        return F.coalesce(whole_json(clean), whole_json(fenced), whole_json(F.regexp_extract(clean, BRACED, 0)))

    def chosen(value: Column) -> Column:
        is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
        return F.when(is_object, value).otherwise(fallback_answer(raw))

    return let(let(ws_trim(raw), tried), chosen)


def answer_field(parsed: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", kind)


def cite(chunks_used: Column, chunks: Column) -> Column:
    """Citations of the used chunks; numbers count from 1, unknown ones are dropped, repeats stay."""
    known = F.filter(chunks_used, lambda i: (i >= 1) & (i <= F.size(chunks)))

    def one(i: Column) -> Column:
        chunk = F.get(chunks, i - 1)
        return F.struct(
            i.alias("chunk_num"),
            accessor(chunk, "source_title").alias("source_title"),
            accessor(chunk, "section_ref").alias("section_ref"),
            accessor(chunk, "jurisdiction").alias("jurisdiction"),
            accessor(chunk, "effective_date").alias("effective_date"),
            F.concat(left(chunk["text"], 120), F.lit("...")).alias("text_preview"),
        )

    return F.transform(known, one)


def lowest_confidence(answer: Column, detector: Column) -> Column:
    """The lower of two labels; an unknown label counts as medium."""

    def level(label: Column) -> Column:
        found = F.array_position(F.array(*[F.lit(l) for l in LABEL_ORDER]), label)
        return F.when(F.coalesce(found, F.lit(0)) == 0, F.lit(LABEL_ORDER.index("medium") + 1)).otherwise(found)

    lower = F.least(level(answer), level(detector)).cast("int")
    return F.element_at(F.array(*[F.lit(l) for l in LABEL_ORDER]), lower)


def useful_answer(full_answer: Column) -> Column:
    """True when the answer holds more than one key."""
    return F.coalesce(F.size(F.json_object_keys(F.to_json(full_answer))), F.lit(0)) > 1


def badge(confidence: Column, full_answer: Column) -> Column:
    """Label shown to the reader: a blocked one becomes low when there is an answer."""
    has_answer = F.coalesce(F.size(F.json_object_keys(F.to_json(full_answer))), F.lit(0)) > 0
    return F.when((confidence == "blocked") & has_answer, "low").otherwise(confidence)


def generate_answers(results: DataFrame, provider=None) -> DataFrame:
    """One response row per retrieval result row.

    ``results`` also carries ``council`` when the asker named one. A result
    blocked before generation never reaches the provider.
    """
    provider = provider or MockProvider()
    if "council" not in results.columns:
        results = results.withColumn("council", F.lit(NATIONAL))
    staged = check_answers(results, report="pre").withColumn("class", classify_query(F.col("query")))
    prompt = build_prompt(F.col("class"), context_string(F.col("chunks")), F.col("query"), F.col("council"))
    answered = staged.withColumn("prompt", F.when(~F.col("pre.is_blocked"), prompt)).withColumn(
        "reply", provider.complete(SYSTEM_PROMPT, F.col("prompt"))
    )
    parsed = answered.withColumn("parsed", F.when(F.col("reply.text").isNotNull(), parse_answer(F.col("reply.text"))))
    parsed = parsed.withColumn("generated", F.col("reply.text"))
    return assemble_responses(check_answers(parsed, "generated", "post"), provider.name)


def assemble_responses(df: DataFrame, provider_name: str) -> DataFrame:
    """Final columns from ``pre`` and ``post`` reports and the parsed answer."""
    blocked = F.col("pre.is_blocked")
    failed = F.col("reply.error").isNotNull()
    parsed, post = F.col("parsed"), F.col("post")
    used = F.coalesce(answer_field(parsed, "chunks_used", "array<int>"), F.array().cast("array<int>"))
    citations = cite(used, F.col("chunks"))
    first_block = F.get(F.filter(F.col("pre.flags"), lambda f: f["severity"] == "block"), F.lit(0))["message"]
    none = F.parse_json(F.lit("{}"))
    error = F.parse_json(F.to_json(F.struct(F.col("reply.error").alias("error"))))

    def pick(when_blocked: Column, when_failed: Column, otherwise: Column) -> Column:
        return F.when(blocked, when_blocked).when(failed, when_failed).otherwise(otherwise)

    empty_citations = F.slice(citations, 1, 0)
    columns = {
        "query_id": F.col("query_id"),
        "query": F.col("query"),
        "query_type": pick(F.lit("OTHER"), F.lit("OTHER"), F.col("class")),
        "answer_summary": pick(
            F.col("pre.user_warning"),
            F.lit(ERROR_SUMMARY),
            F.coalesce(answer_field(parsed, "answer_summary", "string"), F.lit(DEFAULT_SUMMARY)),
        ),
        "full_answer": pick(none, error, parsed),
        "citations": pick(empty_citations, empty_citations, citations),
        "chunks_used": pick(F.array().cast("array<int>"), F.array().cast("array<int>"), used),
        "jurisdiction": pick(F.lit(NATIONAL), F.lit(NATIONAL), F.col("council")),
        "confidence": pick(
            F.lit("blocked"),
            F.lit("blocked"),
            lowest_confidence(
                F.coalesce(answer_field(parsed, "confidence", "string"), F.lit("medium")), post["confidence_label"]
            ),
        ),
        "confidence_score": pick(F.col("pre.confidence_score"), F.lit(0.0), post["confidence_score"]),
        "disclaimer": F.lit(RESPONSE_DISCLAIMER),
        "user_warning": pick(F.col("pre.user_warning"), F.lit(ERROR_WARNING), post["user_warning"]),
        "requires_escalation": pick(F.lit(True), F.lit(False), post["requires_escalation"]),
        "llm_provider": F.lit(provider_name),
        "is_blocked": pick(F.lit(True), F.lit(True), post["is_blocked"]),
        "block_reason": pick(
            F.coalesce(first_block, F.lit("Low confidence")),
            F.concat(F.lit("LLM error: "), F.col("reply.error")),
            F.lit(""),
        ),
        "chunks_retrieved": F.size("chunks"),
        "retrieval_quality": F.col("retrieval_quality"),
        "post_flags": F.transform(post["flags"], lambda f: f["code"]),
    }
    return df.select(*[c.alias(name) for name, c in columns.items()])


def display(responses: DataFrame) -> DataFrame:
    """The eleven keys a reader sees."""
    return responses.select("query_id", *[F.col(src).alias(key) for key, src in DISPLAY_KEYS.items()])


def response_log(responses: DataFrame) -> DataFrame:
    """Counts by status, type and confidence, for monitoring."""
    status = F.when(F.col("is_blocked"), "BLOCKED").otherwise("OK")
    return responses.groupBy(status.alias("status"), "query_type", "confidence").agg(F.count(F.lit(1)).alias("n"))
