"""Chunk validation, derived columns, the staleness gate and the flat projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrays import present
from clausewright.functions.freshness import clean_superseded, days_since_verified, is_stale, needs_reverification
from clausewright.schema import CONFIDENCES, DOCUMENT_TYPES, JURISDICTIONS, MIN_TEXT_CHARS


def _outside(name: str, domain: tuple[str, ...]) -> Column:
    bad = ~F.coalesce(F.col(name).isin(*domain), F.lit(False))
    return F.when(bad, F.lit(f"{name}: not an allowed value"))


def validation_errors() -> Column:
    short = F.coalesce(F.length("text"), F.lit(0)) < MIN_TEXT_CHARS
    return present(
        F.when(short, F.lit(f"text: shorter than {MIN_TEXT_CHARS} characters")),
        _outside("document_type", DOCUMENT_TYPES),
        _outside("jurisdiction", JURISDICTIONS),
        _outside("confidence", CONFIDENCES),
    )


def source_errors() -> Column:
    """What of a document's own metadata leaves the allowed domains."""
    return present(
        _outside("document_type", DOCUMENT_TYPES), _outside("jurisdiction", JURISDICTIONS), _outside("confidence", CONFIDENCES)
    )


def document_errors(raw: DataFrame, checked: DataFrame) -> DataFrame:
    """One row ``source_doc_id, errors`` for each document with an error, in its metadata or in one of its chunks.

    ``raw`` has the ``metadata`` of all documents, also of those that gave no chunk; ``checked`` has ``source_doc_id`` and
    ``errors`` for each chunk. A message is listed once, so a document's list is as short as the list of rules.
    """
    own = raw.select("metadata.*").select(F.col("id").alias("source_doc_id"), source_errors().alias("errors"))
    each = own.unionByName(checked.select("source_doc_id", "errors")).select("source_doc_id", F.explode("errors").alias("error"))
    return each.groupBy("source_doc_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def with_errors(chunks: DataFrame) -> DataFrame:
    """Adds ``errors``, empty for a valid row, and cleans ``superseded_by``."""
    return chunks.withColumn("errors", validation_errors()).withColumn(
        "superseded_by", clean_superseded(F.col("superseded_by"))
    )


@dataclass(frozen=True)
class Validated:
    valid: DataFrame
    rejects: DataFrame


def validate(chunks: DataFrame) -> Validated:
    checked = with_errors(chunks)
    clean = F.size("errors") == 0
    return Validated(checked.where(clean).drop("errors"), checked.where(~clean))


def with_freshness(chunks: DataFrame, as_of=None) -> DataFrame:
    """Adds ``is_stale``, ``days_since_verified`` and ``needs_reverification``."""
    return chunks.withColumns(
        {
            "is_stale": is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of),
            "days_since_verified": days_since_verified(F.col("last_verified"), as_of),
            "needs_reverification": needs_reverification(F.col("last_verified"), as_of),
        }
    )


def drop_stale(chunks: DataFrame, as_of=None) -> DataFrame:
    return chunks.where(~is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of))


def staleness_report(chunks: DataFrame, by: list[str], as_of=None) -> DataFrame:
    """Kept and rejected counts of the staleness gate."""
    stale = is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of)
    return chunks.groupBy(*by).agg(
        F.count_if(~stale).alias("chunks_valid"),
        F.count_if(stale).alias("chunks_rejected_stale"),
    )


def flat_metadata(chunks: DataFrame, as_of=None) -> DataFrame:
    """Scalar-only projection: NULLs become ``""`` or 0 and dates ISO strings."""

    def text_or_blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    def iso(name: str) -> Column:
        return F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit("")).alias(name)

    stale = is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of)
    return chunks.select(
        "chunk_id",
        "source_doc_id",
        "chunk_index",
        text_or_blank("summary"),
        "document_type",
        "jurisdiction",
        text_or_blank("source_title"),
        text_or_blank("source_url"),
        text_or_blank("section_ref"),
        text_or_blank("si_number"),
        F.coalesce("act_year", F.lit(0)).alias("act_year"),
        iso("effective_date"),
        iso("last_verified"),
        F.coalesce(clean_superseded(F.col("superseded_by")), F.lit("")).alias("superseded_by"),
        iso("expiry_date"),
        "confidence",
        "is_verbatim",
        "verified_url",
        stale.alias("is_stale"),
        needs_reverification(F.col("last_verified"), as_of).alias("needs_reverification"),
    )
