"""Answer checking: ordered flags, grounding of references and numbers, confidence.

All checks are expressions over one result row (``query``, ``chunks``,
``total_dense_hits``, ``total_sparse_hits``, ``retrieval_quality``), so a batch of
answers is checked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrays import let, present
from clausewright.functions.text import find_all, left, rx, ws_trim
from clausewright.operators.fusion import accessor, entity_set

# Thresholds, penalties and bonuses of the confidence score.
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.50
CONFIDENCE_LOW = 0.30
LOW_QUALITY = 0.3
PENALTY = {"warning": 0.10, "escalate": 0.15, "block": 0.50}
OTHER_PENALTY = 0.10
CLAIM_PENALTY = 0.08
QUALITY_BONUS = 0.05
BONUS_ABOVE = 0.6

# Topics that always need a person.
ESCALATION_PATTERNS = (
    r"appeal",
    r"an bord plean",
    r"an coimisi",
    r"enforcement",
    r"unauthorised development",
    r"section 5 declaration",
    r"judicial review",
    r"compensation",
    r"injunction",
)

# Numbers that must be found word for word in the retrieved text.
NUMERIC_PATTERNS = (
    r"\d+\s*square\s*metres?",
    r"\d+\s*sq\.?\s*m",
    r"\d+\s*metres?\s*high",
    r"\d+\s*metres?\s*from",
    r"\d+\s*weeks?",
    r"\d+\s*days?",
)

# Fixed value: references that must be covered by an entity of the retrieved text.
REFERENCE_PATTERN = r"(?:class|section|article|schedule)\s+\d+[A-Z]?|S\.I\.\s*No\.\s*\d+\s*of\s*\d{4}"

FLAG = "struct<code:string,severity:string,message:string,detail:string>"
STRINGS = "array<string>"

# The keys, and which one applies. The wording is this engine's own.
WARNINGS = {
    "blocked": "The passages found do not carry an answer. Nothing below should be relied on.",
    "escalation": "The question touches proceedings with legal effect. Have a professional look at it.",
    "low": "Little in the passages supports this answer. Verify every statement.",
    "medium": "The answer follows the passages found; whether they fit the case at hand was not examined.",
    "default": "Produced automatically from indexed passages.",
}
REPORT_DISCLAIMER = "Produced automatically from indexed passages; the decision lies with the body in charge."


def flag(code: str, severity: str, message: str | Column, detail: str | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        as_col(message).alias("message"),
        as_col(detail).alias("detail"),
    )


def escalation_pattern(query: Column) -> Column:
    """The first matching escalation pattern, or NULL."""
    lowered = F.lower(query)
    return F.coalesce(*[F.when(lowered.rlike(rx(p, ignore_case=True)), F.lit(p)) for p in ESCALATION_PATTERNS])


def ungrounded_references(generated: Column, entities: Column) -> Column:
    """References of the text, repeats included, that are part of no entity."""
    refs = find_all(generated, rx(REFERENCE_PATTERN, ignore_case=True))

    def covered(ref: Column, known: Column) -> Column:
        return F.exists(known, lambda e: F.contains(e, ref))

    return let(
        entities, lambda known: F.filter(refs, lambda r: ~let(F.lower(ws_trim(r)), lambda ref: covered(ref, known)))
    )


def all_chunk_text(chunks: Column) -> Column:
    return F.lower(F.array_join(F.transform(chunks, lambda c: c["text"]), " "))


def ungrounded_numbers(generated: Column, context: Column) -> Column:
    """Numbers of the text, by pattern and repeats included, that the retrieved text lacks."""
    found = F.flatten(F.array(*[find_all(generated, rx(p, ignore_case=True)) for p in NUMERIC_PATTERNS]))
    return let(context, lambda text: F.filter(found, lambda n: ~F.contains(text, F.lower(n))))


def confidence_score(quality: Column, flags: Column, claims: Column) -> Column:
    def charge(score: Column, f: Column) -> Column:
        severity = f["severity"]
        cost = None
        for name, value in PENALTY.items():
            cost = F.when(severity == name, value) if cost is None else cost.when(severity == name, value)
        return score - cost.otherwise(OTHER_PENALTY)

    score = F.aggregate(flags, quality.cast("double"), charge)
    score = score - F.lit(CLAIM_PENALTY) * F.size(claims)
    score = score + F.when(quality > BONUS_ABOVE, F.lit(QUALITY_BONUS)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def confidence_label(score: Column) -> Column:
    return (
        F.when(score >= CONFIDENCE_HIGH, "high")
        .when(score >= CONFIDENCE_MEDIUM, "medium")
        .when(score >= CONFIDENCE_LOW, "low")
        .otherwise("blocked")
    )


def user_warning(is_blocked: Column, escalates: Column, label: Column) -> Column:
    """A blocked label without a block gets the mildest text, as does a high one."""
    return (
        F.when(is_blocked, WARNINGS["blocked"])
        .when(escalates, WARNINGS["escalation"])
        .when(label == "low", WARNINGS["low"])
        .when(label == "medium", WARNINGS["medium"])
        .otherwise(WARNINGS["default"])
    )


def _two_digits(value: Column) -> Column:
    return F.format_string("%.2f", value)


def check_answers(results: DataFrame, generated: str | None = None, report: str = "report") -> DataFrame:
    """Adds the report struct to each result row.

    With ``generated``, the name of a text column, grounding of references and
    numbers is checked as well; a NULL or empty text skips it.
    """
    text = F.coalesce(F.col(generated), F.lit("")) if generated else F.lit("")
    chunks = F.col("chunks")
    staged = results.withColumns(
        {
            "_empty": F.size(chunks) == 0,
            "_stale": F.size(F.filter(chunks, lambda c: accessor(c, "is_stale"))),
            "_old": F.size(
                F.filter(chunks, lambda c: F.coalesce(c["metadata"]["needs_reverification"], F.lit(False)))
            ),
            "_pattern": escalation_pattern(F.col("query")),
            "_entities": F.when(text != "", entity_set(chunks)).otherwise(F.array().cast(STRINGS)),
            "_context": F.when(text != "", all_chunk_text(chunks)).otherwise(F.lit("")),
        }
    ).withColumns(
        {
            "_refs": ungrounded_references(text, F.col("_entities")),
            "_numbers": ungrounded_numbers(text, F.col("_context")),
        }
    )
    quality, dense, sparse = (F.col(c) for c in ("retrieval_quality", "total_dense_hits", "total_sparse_hits"))
    refs, numbers, pattern = F.col("_refs"), F.col("_numbers"), F.col("_pattern")
    first_refs = F.concat(F.lit("['"), F.array_join(F.slice(refs, 1, 5), "', '"), F.lit("']"))
    ordered = present(
        F.when(
            quality < LOW_QUALITY,
            flag(
                "LOW_RETRIEVAL_QUALITY",
                "warning",
                "The retrieved text may not cover this question fully",
                F.concat(F.lit("Quality score: "), _two_digits(quality)),
            ),
        ),
        F.when(
            (dense == 0) | (sparse == 0),
            flag(
                "SINGLE_METHOD_RETRIEVAL",
                "warning",
                "Only one search method found something",
                F.concat(F.lit("Dense: "), dense.cast("string"), F.lit(" | Sparse: "), sparse.cast("string")),
            ),
        ),
        F.when(
            F.col("_stale") > 0,
            flag(
                "STALE_CHUNKS_IN_CONTEXT",
                "block",
                "The retrieved text contains superseded rules",
                F.concat(F.col("_stale").cast("string"), F.lit(" stale chunks detected")),
            ),
        ),
        F.when(
            F.col("_old") > 0,
            flag(
                "CHUNKS_NEED_REVERIFICATION",
                "warning",
                "Some sources were not verified recently",
                F.concat(F.col("_old").cast("string"), F.lit(" chunks not verified in 30+ days")),
            ),
        ),
        F.when(
            pattern.isNotNull(),
            flag(
                "ESCALATION_REQUIRED",
                "escalate",
                "This topic needs professional planning advice",
                F.concat(F.lit("Pattern matched: "), pattern),
            ),
        ),
        F.when(
            F.size(refs) > 0,
            flag(
                "UNGROUNDED_SECTION_REFERENCE",
                "warning",
                F.concat(F.size(refs).cast("string"), F.lit(" reference(s) not found in the source documents")),
                F.concat(F.lit("Ungrounded: "), first_refs),
            ),
        ),
    )
    numeric = F.transform(
        numbers,
        lambda n: flag(
            "UNGROUNDED_NUMERIC_THRESHOLD",
            "warning",
            F.concat(F.lit("Number '"), n, F.lit("' not found in the source documents")),
            F.concat(F.lit("The answer contains '"), n, F.lit("', the retrieved chunks do not")),
        ),
    )
    nothing = F.array(
        flag(
            "NO_CHUNKS_RETRIEVED",
            "block",
            "No relevant planning law was found for this question",
            F.concat(F.lit("Query: "), left(F.col("query"), 80)),
        )
    )
    empty = F.col("_empty")
    staged = staged.withColumns(
        {
            "_flags": F.when(empty, nothing).otherwise(F.concat(ordered, numeric)),
            "_claims": F.when(empty, F.array().cast(STRINGS)).otherwise(F.concat(refs, numbers)),
            "_escalates": ~empty & pattern.isNotNull(),
        }
    ).withColumn(
        "_score",
        F.when(empty, F.lit(0.0)).otherwise(confidence_score(quality, F.col("_flags"), F.col("_claims"))),
    )
    # With chunks present the score alone never blocks, and without chunks the first check already has.
    blocked = empty | (F.col("_stale") > 0)
    label = confidence_label(F.col("_score"))
    body = F.struct(
        F.col("_score").alias("confidence_score"),
        label.alias("confidence_label"),
        F.col("_flags").alias("flags"),
        F.when(empty, F.array().cast(STRINGS)).otherwise(F.col("_entities")).alias("grounded_entities"),
        F.col("_claims").alias("ungrounded_claims"),
        F.col("_escalates").alias("requires_escalation"),
        F.when(
            F.col("_escalates"), F.concat(F.lit("Query involves '"), pattern, F.lit("' — formal legal process"))
        )
        .otherwise(F.lit(""))
        .alias("escalation_reason"),
        quality.alias("retrieval_quality"),
        F.size(chunks).alias("chunks_used"),
        blocked.alias("is_blocked"),
        user_warning(blocked, F.col("_escalates"), label).alias("user_warning"),
        F.lit(REPORT_DISCLAIMER).alias("disclaimer"),
        F.when(blocked, "BLOCKED").when(F.col("_escalates"), "ESCALATE").otherwise("OK").alias("status"),
    )
    hidden = [c for c in staged.columns if c.startswith("_") and c not in results.columns]
    return staged.withColumn(report, body).drop(*hidden)
