"""Record layouts and the closed value domains of the chunk table."""

from __future__ import annotations

from pyspark.sql import types as T

# Document types, jurisdictions and confidence labels.
DOCUMENT_TYPES = (
    "primary_act",
    "secondary_si",
    "ministerial_guide",
    "national_policy",
    "council_devplan",
    "abp_decision",
    "exemption_schedule",
)
NATIONAL = "national"
COUNCILS = (
    "carlow",
    "cavan",
    "clare",
    "cork_city",
    "cork_county",
    "donegal",
    "dublin_city",
    "dun_laoghaire_rathdown",
    "fingal",
    "galway_city",
    "galway_county",
    "kerry",
    "kildare",
    "kilkenny",
    "laois",
    "leitrim",
    "limerick",
    "longford",
    "louth",
    "mayo",
    "meath",
    "monaghan",
    "offaly",
    "roscommon",
    "sligo",
    "south_dublin",
    "tipperary",
    "waterford",
    "westmeath",
    "wexford",
    "wicklow",
)
JURISDICTIONS = (NATIONAL, *COUNCILS)
CONFIDENCES = ("high", "medium", "low")

MIN_TEXT_CHARS = 20
REVERIFY_AFTER_DAYS = 30
SCHEMA_VERSION = "1.0"

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("jurisdiction", T.StringType()),
        T.StructField("si_number", T.StringType()),
        T.StructField("act_year", T.IntegerType()),
        T.StructField("effective_date", T.DateType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("is_verbatim", T.BooleanType()),
    ]
)

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_doc_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("jurisdiction", T.StringType()),
        T.StructField("source_title", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("section_ref", T.StringType()),
        T.StructField("si_number", T.StringType()),
        T.StructField("act_year", T.IntegerType()),
        T.StructField("effective_date", T.DateType()),
        T.StructField("last_verified", T.DateType()),
        T.StructField("superseded_by", T.StringType()),
        T.StructField("expiry_date", T.DateType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("is_verbatim", T.BooleanType()),
        T.StructField("verified_url", T.BooleanType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("version", T.StringType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("council", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
    ]
)

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("helpful", T.BooleanType()),
        T.StructField("comment", T.StringType()),
    ]
)
