"""Continuous ingestion: new raw documents are chunked and added batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clausewright.operators import chunking
from clausewright.plans.knowledge import KnowledgeBase
from clausewright.schema import SOURCE_SCHEMA

RAW_SCHEMA = T.StructType([T.StructField("metadata", SOURCE_SCHEMA), T.StructField("raw_text", T.StringType())])


def stream_documents(spark, folder: str) -> DataFrame:
    """Stream of parquet files with ``metadata`` and ``raw_text``."""
    return spark.readStream.schema(RAW_SCHEMA).parquet(folder)


def ingest_stream(kb: KnowledgeBase, raw_docs: DataFrame, checkpoint: str, as_of=None, name: str = "ingest") -> StreamingQuery:
    """Adds each micro-batch as one committed batch; a replayed micro-batch changes nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        kb.add_chunks(chunking.chunk_documents(batch, as_of), as_of, batch_id=f"{name}-{epoch}")

    return (
        raw_docs.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
