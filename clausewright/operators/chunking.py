"""Boundary chunking: split, merge, pack and label, one document row at a time.

The whole operator is a projection plus one ``posexplode``. It never shuffles,
and the only memory it needs is one document and its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrays import fold_pack, let
from clausewright.functions.text import find_all, left, rx, ws_trim
from clausewright.schema import CHUNK_SCHEMA, SCHEMA_VERSION

MIN_CHUNK_CHARS = 150
MAX_CHUNK_CHARS = 2000
OVERLAP_CHARS = 100
MIN_BOUNDARIES = 3
# A segment after the first holds at least one heading of four or more characters,
# so this many following segments always cover the overlap.
OVERLAP_SEGMENTS = 25

# Heading patterns in priority order, with their case rule.
BOUNDARY_PATTERNS = (
    (r"^\d+[A-Z]?\.?—?\s*\(\d+\)", False),
    (r"^(?:CLASS\s+\d+[A-Z]?|Class\s+\d+[A-Z]?)", True),
    (r"^Article\s+\d+[A-Z]?", True),
    (r"^\d+\.\s+[A-Z][a-zA-Z\s]+:?$", False),
)
PARAGRAPH_BREAK = r"\n\n+"

# Reference patterns in order of appearance in the label.
REFERENCE_PATTERNS = (
    r"(Class\s+\d+[A-Z]?\b)",
    r"(section\s+\d+[A-Z]?\s*\(\d+\))",
    r"(section\s+\d+[A-Z]?\b)",
    r"(article\s+\d+[A-Z]?\b)",
    r"(S\.I\.\s+No\.\s+\d+\s+of\s+\d{4})",
)
REFS_PER_PATTERN = 2
REFS_PER_CHUNK = 4

SUMMARY_MIN_LINE = 20
SUMMARY_CHARS = 120


def boundary_rule(text: Column) -> Column:
    """1..4 for the first pattern with enough headings, 0 for paragraph splitting."""
    rule = None
    for number, (pattern, ignore_case) in enumerate(BOUNDARY_PATTERNS, 1):
        enough = F.regexp_count(text, F.lit(rx(pattern, ignore_case, True))) >= MIN_BOUNDARIES
        rule = F.when(enough, F.lit(number)) if rule is None else rule.when(enough, F.lit(number))
    return rule.otherwise(F.lit(0))


def paragraphs(text: Column) -> Column:
    stripped = F.transform(F.split(text, PARAGRAPH_BREAK), ws_trim)
    return F.filter(stripped, lambda p: p != "")


def headed_pieces(text: Column, pattern: str, ignore_case: bool) -> Column:
    """Text cut before every heading, without what precedes the first one."""
    pieces = F.split(text, rx(f"(?={pattern})", ignore_case, True))
    starts_headed = text.rlike(rx(rf"\A(?:{pattern})", ignore_case, True))
    return F.when(starts_headed, pieces).otherwise(F.slice(pieces, F.lit(2), F.size(pieces)))


def raw_pieces(text: Column, rule: Column) -> Column:
    pieces = None
    for number, (pattern, ignore_case) in enumerate(BOUNDARY_PATTERNS, 1):
        cut = headed_pieces(text, pattern, ignore_case)
        pieces = F.when(rule == number, cut) if pieces is None else pieces.when(rule == number, cut)
    return pieces.otherwise(paragraphs(text))


def with_overlap(pieces: Column) -> Column:
    """Every piece runs on into the first characters of what follows it."""

    def extend(heads: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            following = F.array_join(F.slice(heads, i + 2, F.lit(OVERLAP_SEGMENTS)), "")
            return F.concat(piece, left(following, OVERLAP_CHARS))

        return F.transform(pieces, one)

    return let(F.transform(pieces, lambda p: left(p, OVERLAP_CHARS)), extend)


def merge_short(segments: Column) -> Column:
    return fold_pack(
        segments,
        joins=lambda buf, seg: F.length(buf) + F.length(seg) < MIN_CHUNK_CHARS,
        glue=lambda buf, seg: F.concat(buf, F.lit("\n\n"), seg),
    )


def pack_long(segment: Column) -> Column:
    """Pieces of one oversized segment; the separator does not count towards the size."""
    return fold_pack(
        F.split(segment, PARAGRAPH_BREAK),
        joins=lambda buf, part: F.length(buf) + F.length(part) <= MAX_CHUNK_CHARS,
        glue=lambda buf, part: F.concat(buf, F.when(buf != "", F.lit("\n\n")).otherwise(F.lit("")), part),
    )


def normalise_sizes(segments: Column) -> Column:
    return F.flatten(
        F.transform(
            merge_short(segments),
            lambda seg: F.when(F.length(seg) <= MAX_CHUNK_CHARS, F.array(seg)).otherwise(pack_long(seg)),
        )
    )


def section_reference(text: Column, si_number: Column) -> Column:
    found = F.concat(
        *[F.slice(find_all(text, rx(p, ignore_case=True), 1), 1, REFS_PER_PATTERN) for p in REFERENCE_PATTERNS]
    )
    absent = (F.coalesce(si_number, F.lit("")) != "") & ~F.contains(F.array_join(found, " "), si_number)
    refs = F.when(absent, F.concat(F.array(si_number), found)).otherwise(found)
    return F.array_join(F.slice(refs, 1, REFS_PER_CHUNK), " | ")


def summary_line(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), ws_trim)
    line = F.get(F.filter(lines, lambda l: F.length(l) > SUMMARY_MIN_LINE), F.lit(0))
    cut = F.concat(left(line, SUMMARY_CHARS), F.when(F.length(line) > SUMMARY_CHARS, "...").otherwise(""))
    return F.coalesce(cut, left(text, SUMMARY_CHARS))


def split_segments(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``rule`` and ``segments``: boundary slices with overlap, or paragraphs."""
    raw = F.col(text)
    return (
        docs.withColumn("rule", boundary_rule(raw))
        .withColumn("pieces", raw_pieces(raw, F.col("rule")))
        .withColumn(
            "segments",
            F.when(F.col("rule") > 0, with_overlap(F.col("pieces"))).otherwise(F.col("pieces")),
        )
        .drop("pieces")
    )


def chunk_texts(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per kept chunk: the document's columns plus ``chunk_index`` and ``text``.

    The index is the position before short chunks are dropped, so gaps may occur.
    """
    kept = [c for c in docs.columns if c != text]
    return (
        split_segments(docs, text)
        .select(*kept, F.posexplode(normalise_sizes(F.col("segments"))).alias("chunk_index", "piece"))
        .withColumn("text", ws_trim(F.col("piece")))
        .drop("piece")
        .where(F.length("text") >= MIN_CHUNK_CHARS)
    )


def chunk_documents(raw_docs: DataFrame, as_of=None) -> DataFrame:
    """Full chunk records from ``raw_docs(metadata STRUCT, raw_text)``.

    Chunk ids hash the source, the position and the text, so chunking the same
    document again gives the same ids.
    """
    from clausewright.functions.freshness import as_date

    meta = F.col("metadata")
    texts = chunk_texts(raw_docs.select("metadata", "raw_text"))
    columns = {
        "chunk_id": F.sha2(F.concat_ws("|", meta["id"], F.col("chunk_index").cast("string"), F.col("text")), 256),
        "source_doc_id": meta["id"],
        "chunk_index": F.col("chunk_index"),
        "text": F.col("text"),
        "summary": summary_line(F.col("text")),
        "document_type": meta["document_type"],
        "jurisdiction": meta["jurisdiction"],
        "source_title": meta["title"],
        "source_url": F.coalesce(meta["url"], F.lit("")),
        "section_ref": section_reference(F.col("text"), meta["si_number"]),
        "si_number": F.coalesce(meta["si_number"], F.lit("")),
        "act_year": meta["act_year"],
        "effective_date": meta["effective_date"],
        "last_verified": as_date(as_of),
        "superseded_by": F.lit(None).cast("string"),
        "expiry_date": F.lit(None).cast("date"),
        "confidence": F.coalesce(meta["confidence"], F.lit("medium")),
        "is_verbatim": F.coalesce(meta["is_verbatim"], F.lit(False)),
        "verified_url": F.lit(False),
        "ingested_at": F.current_timestamp(),
        "version": F.lit(SCHEMA_VERSION),
    }
    return texts.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields])
