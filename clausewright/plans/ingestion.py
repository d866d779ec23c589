"""Ingestion: read, chunk, validate, gate, store and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clausewright.functions.freshness import is_stale


def run_totals(raw: DataFrame, chunks: DataFrame, stored: DataFrame, key: str, as_of=None) -> DataFrame:
    """One row of ingestion counts.

    ``raw`` has ``raw_text`` per attempted source (empty or NULL when fetching
    failed); ``chunks`` has the freshness inputs and ``key``; ``stored`` holds the
    keys that need not be added again.
    """
    fetched = raw.agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if(F.coalesce("raw_text", F.lit("")) != "").alias("sources_succeeded"),
        F.coalesce(F.sum(F.length("raw_text")), F.lit(0)).cast("long").alias("total_chars"),
    ).withColumn("one", F.lit(1))
    known = stored.select(key).distinct().withColumn("known", F.lit(True))
    stale = is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of)
    cut = (
        chunks.select(key, stale.alias("stale"))
        .join(known, key, "left")
        .agg(
            F.count(F.lit(1)).alias("total_chunks"),
            F.count_if("stale").alias("chunks_rejected_stale"),
            F.count_if(~F.col("stale") & F.col("known").isNull()).alias("chunks_added"),
        )
        .withColumn("one", F.lit(1))
    )
    return fetched.join(cut, "one").drop("one")


def run_ingestion(
    kb,
    sources: DataFrame,
    raw_folder: str,
    cache_path: str,
    rebuild: bool = False,
    source_ids: list[str] | None = None,
    get=None,
    as_of=None,
    batch_id: str | None = None,
) -> dict:
    """Fetches, chunks, validates and stores the sources; gives the counts of the run.

    A source that cannot be read is left out and the others go on. Documents with
    an error are counted in ``errors`` and listed by the ``error_rows`` frame, one
    row each; their faulty chunks are not stored. Texts are read and chunked once.
    """
    from clausewright.operators import chunking, validation
    from clausewright.operators.sizing import materialise
    from clausewright.sources import reading

    chosen = sources.where(F.col("id").isin(*source_ids)) if source_ids else sources
    attempted = len(source_ids) if source_ids else chosen.count()
    texts = reading.local_texts(chosen, raw_folder)
    remote = chosen.where(~reading.is_local(F.col("url")))
    texts = texts.unionByName(
        reading.fetch_missing(remote, cache_path, get) if get else reading.fetch_missing(remote, cache_path)
    )
    read, tested, faulty = Observation(), Observation(), Observation()
    rows = F.count(F.lit(1)).alias("n")
    chars = F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars")
    raw = materialise(reading.raw_documents(chosen, texts).observe(read, rows, chars))
    clean = F.size("errors") == 0
    stale = is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of)
    checked = validation.with_errors(chunking.chunk_documents(raw, as_of)).observe(
        tested, F.count_if(clean).alias("n"), F.count_if(clean & stale).alias("stale")
    )
    checked = materialise(checked)
    errors = materialise(validation.document_errors(raw, checked).observe(faulty, rows))
    added = kb.add_chunks(checked.where(clean).drop("errors"), as_of, rebuild=rebuild, batch_id=batch_id)
    return {
        "sources_attempted": attempted,
        "sources_succeeded": read.get["n"],
        "total_chars": read.get["chars"],
        "total_chunks": tested.get["n"],
        "chunks_added": added,
        "chunks_rejected_stale": tested.get["stale"],
        "errors": faulty.get["n"],
        "error_rows": errors,
    }
