"""The stored knowledge base: chunk, vector and keyword tables in a shared folder.

Every add writes one batch to each table and then one commit row; readers see
committed batches only, so a job that dies half way leaves nothing behind and can
simply run again under the same batch id. A commit of kind ``base`` replaces all
batches before it: that is how a rebuild and an overwrite work.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.freshness import clean_superseded, is_stale
from clausewright.functions.text import tokenise
from clausewright.operators import impacts, index, validation, vectors
from clausewright.operators.sizing import at_most, few_values, materialise, restrict
from clausewright.schema import CHUNK_SCHEMA, FEEDBACK_SCHEMA

TERM_BUCKETS = 64
PRUNE_QUERIES = 10_000
GROUPED_FROM = 100_000  # chunks from which searches go through groups; fewer are scanned in less time

_COMMIT = "batch_id string, seq long, kind string"
_VECTOR = (
    "chunk_id string, embedding array<float>, document_type string, superseded_by string, expiry_date date, "
    "jurisdiction string"
)
_TABLES = {
    "chunks": CHUNK_SCHEMA,
    "vectors": _VECTOR,
    "documents": "chunk_id string, dl int, terms array<struct<term:string,tf:int>>",
    "postings": "term string, chunk_id string, tf int, dl int, term_bucket int",
    "frequencies": "term string, df long, cf long",
    "totals": "n_docs long, sum_dl long",
    "term_stats": "term string, df long, idf double",
    "vector_centres": vectors.PLACES,
    "vector_groups": f"{vectors.GROUPS}, group_id string",
    "term_groups": f"{impacts.GROUPS}, group_id string",
}


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


@dataclass
class KnowledgeBase:
    spark: SparkSession
    path: str
    embed: Callable[[Column], Column]

    # -- tables ------------------------------------------------------------------------

    def _commits(self) -> list:
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":  # nothing has been stored yet
                return []
            raise
        return sorted(rows, key=lambda r: r.seq)

    def batches(self) -> list[str]:
        """Ids of the live batches: the last base and what was committed after it."""
        commits = self._commits()
        bases = [i for i, row in enumerate(commits) if row.kind == "base"]
        return [row.batch_id for row in commits[bases[-1] if bases else 0 :]]

    def _table(self, name: str, batches: list[str]) -> DataFrame:
        schema = _TABLES[name]
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if not batches:
            return self.spark.createDataFrame([], schema)
        with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())])
        stored = self.spark.read.schema(with_batch).parquet(f"{self.path}/{name}")
        return stored.where(F.col("batch_id").isin(*batches)).select(*[f.name for f in schema.fields])

    def chunks(self) -> DataFrame:
        return self._table("chunks", self.batches())

    def fresh_chunks(self, as_of=None) -> DataFrame:
        return validation.with_freshness(self.chunks(), as_of)

    def vectors(self, as_of=None) -> DataFrame:
        rows = self._table("vectors", self.batches())
        return rows.withColumn("is_stale", is_stale(F.col("superseded_by"), F.col("expiry_date"), as_of))

    def vector_groups(self, as_of: str | dt.date | None = None) -> vectors.VectorGroups:
        """The vectors in groups, for searches that skip groups."""
        live = self.batches()
        date = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of or dt.date.today()
        return vectors.VectorGroups(self._table("vector_groups", live), self._table("vector_centres", live), (date - dt.date(1970, 1, 1)).days)

    def searchable(self, as_of=None) -> DataFrame | vectors.VectorGroups:
        """What a vector search should read: groups, unless the store is small. The hits are the same."""
        named = as_of is None or isinstance(as_of, (str, dt.date))
        return self.vector_groups(as_of) if named and self._is_large() else self.vectors(as_of)

    def _is_large(self) -> bool:
        return self.chunk_total().first().total_chunks >= GROUPED_FROM

    def sparse_index(self, queries: DataFrame | None = None, grouped: bool | None = None) -> index.SparseIndex:
        """The keyword index. With a small batch of queries, only the terms they need are read.

        ``grouped`` says whether searches go through groups of term lists; left out, they do unless the store is small.
        """
        live = self.batches()
        grouped = self._is_large() if grouped is None else grouped
        postings, stats = self._table("postings", live), self._table("term_stats", live[-1:])
        if queries is not None and live and at_most(queries, PRUNE_QUERIES):
            terms = queries.select(F.explode(tokenise(F.col("query"))).alias("term"))
            buckets = few_values(terms.select(term_bucket(F.col("term")).alias("b")), "b", TERM_BUCKETS)
            words = few_values(terms, "term")
            postings = restrict(restrict(postings, "term_bucket", buckets), "term", words)
            stats = restrict(stats, "term", words)
        corpus = index.summarise_corpus(self._table("totals", live))
        groups = self._table("term_groups", live) if grouped else None
        return index.SparseIndex(self._table("documents", live), postings.drop("term_bucket"), stats, corpus, groups)

    # -- writing -----------------------------------------------------------------------

    def _write(self, df: DataFrame, name: str, batch: str, by: str | None = None, key: str | None = None) -> None:
        """Writes one batch of a table, in folders by ``by`` and with files sorted by ``key``.

        Rebalancing splits large folders over many tasks. Sorted files and a bloom
        filter let a lookup by key skip nearly all row groups.
        """
        shaped = df.hint("rebalance", by) if by else df
        writer = (shaped.sortWithinPartitions(*[c for c in (by, key) if c]) if key else shaped).write.mode("overwrite")
        if key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}/batch_id={batch}")

    def add_chunks(
        self, chunks: DataFrame, as_of=None, overwrite: bool = False, rebuild: bool = False, batch_id: str | None = None
    ) -> int:
        """Stores valid, non-stale chunks and indexes them; gives the number added.

        Chunks that are stored already, or repeated in the batch, are skipped.
        With ``overwrite`` they replace the stored ones; with ``rebuild`` they
        replace everything. Only new texts are embedded and tokenised: vectors
        and term lists of chunks that stay are taken over as they are.
        """
        commits = self._commits()
        batch = batch_id or uuid.uuid4().hex
        if any(row.batch_id == batch for row in commits):
            return 0
        live = [] if rebuild else self.batches()
        stored = self._table("chunks", live)
        incoming = validation.drop_stale(validation.validate(chunks).valid, as_of).select(*CHUNK_SCHEMA.fieldNames())
        if overwrite or rebuild:
            fresh, before = materialise(incoming.dropDuplicates(["chunk_id"])), live
            kept = stored.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
            self._write(fresh.unionByName(kept).repartition("chunk_id"), "chunks", batch, key="chunk_id")
            live, kind = [], "base"
        else:
            self._write(index.new_chunks(incoming, stored), "chunks", batch, key="chunk_id")
            fresh, before, kind = None, [], "append"
        written = self._table("chunks", [batch])
        count = written.count()
        if count == 0 and kind == "append":
            return 0
        self._index(written, batch, [*live, batch], written if fresh is None else fresh, before)
        seq = commits[-1].seq + 1 if commits else 0
        self.spark.createDataFrame([(batch, seq, kind)], _COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits"
        )
        return count

    def _index(self, written: DataFrame, batch: str, live: list[str], fresh: DataFrame, before: list[str]) -> None:
        """Indexes a batch of written chunks: the fresh ones, and the others from the batches ``before``."""

        def with_kept(df: DataFrame, name: str) -> DataFrame:
            kept = self._table(name, before).join(fresh.select("chunk_id"), "chunk_id", "left_anti")
            return df.unionByName(kept) if before else df

        embedded = fresh.select(
            "chunk_id",
            self.embed(F.col("text")).alias("embedding"),
            "document_type",
            "superseded_by",
            "expiry_date",
            "jurisdiction",
        )
        self._write(with_kept(embedded, "vectors"), "vectors", batch, "jurisdiction")
        self._write_vector_groups(batch, live)
        self._write(with_kept(index.build_documents(fresh), "documents"), "documents", batch)
        self._write(impacts.group_documents(self._table("documents", [batch]), f"{batch}:"), "term_groups", batch)
        postings = index.as_postings(self._table("documents", [batch])).withColumn("term_bucket", term_bucket(F.col("term")))
        self._write(postings, "postings", batch, "term_bucket", "term")
        self._write(index.document_frequencies(self._table("postings", [batch])), "frequencies", batch)
        self._write(index.corpus_totals(written, self._table("frequencies", [batch])), "totals", batch)
        summed = self._table("frequencies", live).groupBy("term").agg(F.sum("df").alias("df"))
        corpus = index.summarise_corpus(self._table("totals", live))
        self._write(index.weigh_terms(summed, corpus), "term_stats", batch, key="term")

    def _write_vector_groups(self, batch: str, live: list[str]) -> None:
        """Groups a batch of vectors around the centres of the batches before it, or around new ones.

        Superseded vectors are stale at any date and are left out; expiring ones carry their day.
        """
        rows = self._table("vectors", [batch]).where(clean_superseded(F.col("superseded_by")).isNull())
        centres = materialise(self._table("vector_centres", [b for b in live if b != batch]))
        known = not centres.isEmpty()
        made = vectors.group_vectors(rows, centres if known else None, f"{batch}:")
        self._write(made.centres.limit(0) if known else made.centres, "vector_centres", batch)
        self._write(made.groups, "vector_groups", batch, "centre")

    # -- reports -----------------------------------------------------------------------

    def stats(self, as_of=None) -> DataFrame:
        return index.corpus_stats(self.chunks(), as_of)

    def chunk_total(self) -> DataFrame:
        """One row ``total_chunks``, summed from the totals of the batches."""
        return self._table("totals", self.batches()).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_chunks"))

    def list_sources(self) -> DataFrame:
        return index.manifest(self.chunks())

    def save_manifest(self, path: str) -> None:
        self.list_sources().withColumn("schema_version", F.lit("1.0")).write.mode("overwrite").json(path)

    def add_feedback(self, feedback: DataFrame) -> None:
        rows = feedback.select(*FEEDBACK_SCHEMA.fieldNames()).withColumn("received_at", F.current_timestamp())
        rows.write.mode("append").parquet(f"{self.path}/feedback")

    def feedback(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/feedback")
