"""A corpus pipeline: language ID, near-dedup, benchmark decontamination, secret scans, mixing to target weights.

Each stage takes the session, the documents that its predecessor kept, and the folder of the given tables. All but the
last return the columns of ``documents``. A stage's result is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import decontaminate, langid, mixing, neardup, secret_scan
from clausewright.operators.sizing import at_most, materialise

EXPLAINED = 0.5  # share of a document's letters that must be in scripts of known languages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in known languages, mixed ones too.

    Texts without letters go, and texts with less than half of their letters in scripts that a known language uses.
    """
    judged = langid.identify(docs, langid.fit(docs))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("explained") >= EXPLAINED)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    A row is known by its id and a digest of its text, so rows that share an id are judged by their own texts. Of rows
    with one id and one text, one stays. Documents with a NULL id belong to no group and all stay.
    """
    digest = "digest"
    while digest in docs.columns:
        digest = f"_{digest}"
    row = ["doc_id", digest]
    named = docs.withColumn(digest, F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    judged = materialise(neardup.near_duplicates(named.select("text", *row), keep=(digest,)).where("doc_id IS NOT NULL"))
    gone = materialise(judged.where("NOT kept").select(row).distinct())
    again = materialise(judged.where("kept").groupBy(row).count().where("count > 1").select(row))
    gone, again = (F.broadcast(t) if at_most(t, neardup.BROADCAST_IDS) else t for t in (gone, again))
    left = named.join(gone, row, "left_anti")
    once = left.join(again, row, "left_semi").dropDuplicates(row)
    return left.join(again, row, "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a test item."""
    judged = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("NOT contaminated").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    clean = secret_scan.scan(docs).withColumn("text", F.col("redacted"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the weights of the sources ask for."""
    return mixing.emitted(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
