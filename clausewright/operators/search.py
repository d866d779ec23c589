"""Keyword and vector search over batches of queries.

Scores are rounded before ranking: the order in which a shuffle adds up doubles
must not decide between copies of one text, also not when a task is rerun.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.arrays import l2_normalise
from clausewright.functions.text import contains_any, tokenise
from clausewright.operators.impacts import group_documents, grouped_hits
from clausewright.operators.index import B, K1, SparseIndex
from clausewright.operators.sizing import at_most, broadcast_when, few_values, materialise, restrict
from clausewright.operators.vectors import VectorGroups, search_groups, stored_groups
from clausewright.schema import NATIONAL

# How many hits each search fetches.
DENSE_FETCH = 30
SPARSE_FETCH = 30
OVERFETCH = 2
BOOST_FETCH = 10

# Words that trigger the schedule boost, its text and its document type.
BOOST_KEYWORDS = (
    "extension",
    "shed",
    "solar",
    "exempt",
    "garage",
    "porch",
    "fence",
    "attic",
    "class 1",
    "class 2",
    "schedule 2",
    "permission",
)
BOOST_TEXT = "exempted development class schedule dwellinghouse extension floor area"
BOOST_TYPE = "exemption_schedule"

SCORE_DIGITS = 6
SCORE_CELLS = 1 << 18  # keyword scores that a task adds up at a time
SCORE_PAIRS = 1 << 20  # pairs of a query and a chunk's term that a task adds up at a time
BROADCAST_QUERY_TERMS = 200_000
BROADCAST_HITS = 100_000
QUERY_BLOCK = 2_048

HITS = "query_id string, chunk_id string, score double"
HITS_ARROW = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class BatchSize:
    """The number of queries of a batch and of the terms in them, repeats included."""

    queries: int
    terms: int


def measure(queries: DataFrame) -> BatchSize:
    """Both sizes of a batch in one pass, for everything that has to choose by them."""
    terms = F.coalesce(F.sum(F.array_size(tokenise(F.col("query"))).cast("long")), F.lit(0))
    return BatchSize(*queries.agg(F.count(F.lit(1)), terms).first())


# -- keyword search --------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``; a repeated query term counts once per repeat."""
    return (
        queries.select("query_id", F.explode(tokenise(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


class _Best:
    """The best rows that a task has seen for each query of a block."""

    def __init__(self, ids, limits):
        self.ids = list(ids)
        self.limits = np.asarray(limits, dtype=np.int64)
        self.best = [(np.empty(0), np.empty(0, dtype=object)) for _ in self.ids]

    def keep(self, row: int, scores, ids) -> None:
        limit = int(self.limits[row])
        if len(self.best[row][0]) == limit:
            near = scores >= self.best[row][0][-1]
            scores, ids = scores[near], ids[near]
        if len(scores) > limit:
            # Everything that ties with the last place stays until ids decide.
            cut = np.partition(scores, len(scores) - limit)[len(scores) - limit]
            near = scores >= cut
            scores, ids = scores[near], ids[near]
        old_scores, old_ids = self.best[row]
        scores, ids = np.concatenate([old_scores, scores]), np.concatenate([old_ids, ids])
        order = np.lexsort((ids.astype(str), -scores))[:limit]
        self.best[row] = (scores[order], ids[order])

    def rows(self, schema: pa.Schema) -> pa.Table:
        counts = [len(ids) for _, ids in self.best]
        columns = [
            [q for q, n in zip(self.ids, counts) for _ in range(n)],
            [c for _, ids in self.best for c in ids],
            [float(s) for scores, _ in self.best for s in scores],
        ]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


class _Terms(_Best):
    """A block of queries as weighted terms, with the best chunks of each."""

    def __init__(self, query_ids, terms, weights, limit: int, avgdl: float):
        names, query = np.unique(np.array(query_ids, dtype=object), return_inverse=True)
        super().__init__(names, [limit] * len(names))
        words, term = np.unique(np.array(terms, dtype=object), return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], np.asarray(weights, dtype=np.float64)[order]
        self.begin = np.searchsorted(term[order], np.arange(len(words) + 1))
        self.words, self.avgdl = pa.array(words, pa.string()), avgdl
        self.floor = np.full(len(names), -np.inf)

    def offer(self, batch: pa.RecordBatch) -> None:
        step = max(1, SCORE_CELLS // len(self.ids))
        for at in range(0, batch.num_rows, step):
            self._score(batch.slice(at, step))

    def _score(self, part: pa.RecordBatch) -> None:
        """Adds up the scores of all queries for some chunks and offers those that may still enter a list."""
        lists = part.column("terms")
        flat = lists.flatten()
        found = pc.index_in(flat.field("term"), value_set=self.words)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[there]
        tf = flat.field("tf").to_numpy(zero_copy_only=False)[there].astype(np.float64)
        dl = part.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)[chunk]
        impact = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / self.avgdl))
        ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
        asked = self.begin[term + 1] - self.begin[term]  # queries that have the term
        ends = np.searchsorted(chunk, np.arange(part.num_rows + 1))
        for a, b in chunk_ranges(np.append(0, np.cumsum(asked))[ends]):
            own = slice(ends[a], ends[b])
            self._add_up(ids[a:b], chunk[own] - a, term[own], asked[own], impact[own])

    def _add_up(self, ids, chunk, term, asked, impact) -> None:
        pair = np.repeat(np.arange(len(term)), asked)
        place = np.arange(len(pair)) + (self.begin[term] - np.cumsum(asked) + asked)[pair]
        cell = chunk[pair] * len(self.ids) + self.query[place]
        sums = np.bincount(cell, self.weight[place] * impact[pair], len(ids) * len(self.ids))
        sums = sums.reshape(len(ids), len(self.ids)).T
        scores = np.round(sums, SCORE_DIGITS)
        query, chunk = np.nonzero((sums > 0) & (scores >= self.floor[:, None]))
        rows, first = np.unique(query, return_index=True)
        for row, own in zip(rows, np.split(chunk, first[1:])):
            self.keep(row, scores[row, own], ids[own])
            if len(self.best[row][0]) == self.limits[row]:
                self.floor[row] = self.best[row][0][-1]


def chunk_ranges(before: np.ndarray) -> list[tuple[int, int]]:
    """Cuts chunks into ranges of ``SCORE_PAIRS`` pairs of a query and a term at most, or of one chunk; ``before``: the pairs before each chunk and after the last."""
    ranges, a = [], 0
    while a < len(before) - 1:
        b = max(a + 1, int(np.searchsorted(before, before[a] + SCORE_PAIRS, "right")) - 1)
        ranges.append((a, b))
        a = b
    return ranges


def sparse_hits(index: SparseIndex, queries: DataFrame, limit: int, size: BatchSize | None = None) -> DataFrame:
    """Candidates for the ``limit`` best BM25 scores of each query: ``query_id, chunk_id, score``.

    The weighted terms of the queries travel to the term lists of the chunks. A chunk's score is added up inside its
    row and each task returns only its own best rows, so what is shuffled afterwards does not grow with the number of
    chunks. More than ``BROADCAST_QUERY_TERMS`` terms are taken in blocks of queries, for which the lists are put into
    groups first. An index with groups is searched through these: see ``impacts``.
    """
    terms = query_terms(queries)
    few = (size or measure(queries)).terms <= BROADCAST_QUERY_TERMS
    weights = index.term_stats.join(broadcast_when(few, terms), "term").select(
        F.col("query_id").cast("string"), "term", (F.col("qtf").cast("double") * F.col("idf")).alias("weight")
    )
    avgdl = index.corpus.first().avgdl
    if few and index.groups is None:
        return _scan_terms(index.documents, weights.collect(), limit, avgdl)
    groups = materialise(group_documents(index.documents)) if index.groups is None else index.groups
    return grouped_hits(groups, weights, limit, avgdl)


def _scan_terms(documents: DataFrame, rows: list, limit: int, avgdl: float | None) -> DataFrame:
    fields = ("query_id", "term", "weight")
    shared = documents.sparkSession.sparkContext.broadcast([[r[f] for r in rows] for f in fields])

    def scan(batches):
        if shared.value[0]:
            best = _Terms(*shared.value, limit, avgdl)
            for batch in batches:
                best.offer(batch)
            yield from best.rows(HITS_ARROW).to_batches()

    return documents.select("chunk_id", "dl", "terms").mapInArrow(scan, HITS)


def ranked(df: DataFrame, limit: int | Column, *order: Column) -> DataFrame:
    """Adds ``rank`` within each query and keeps the first ``limit``."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def allowed_jurisdiction(row: Column, wanted: Column) -> Column:
    """No wanted jurisdiction means no filter; otherwise the council's rows and the national ones."""
    return wanted.isNull() | (row == wanted) | (row == NATIONAL)


def sparse_search(
    index: SparseIndex, chunks: DataFrame, queries: DataFrame, n: int = SPARSE_FETCH, size: BatchSize | None = None
) -> DataFrame:
    """Top ``n`` keyword hits per query.

    The best ``2n`` are taken first and only then freed of stale and foreign
    chunks, so fewer than ``n`` may remain. ``chunks`` needs ``chunk_id``,
    ``jurisdiction`` and ``is_stale``; ``queries`` needs ``jurisdiction``.
    """
    size = size or measure(queries)
    scored = sparse_hits(index, queries, OVERFETCH * n, size)
    best = materialise(ranked(scored, OVERFETCH * n, F.desc("score"), F.asc("chunk_id")).drop("rank"))
    most = OVERFETCH * n * size.queries
    few = most <= BROADCAST_HITS
    wanted = queries.select("query_id", F.col("jurisdiction").alias("wanted"))
    meta = restrict(chunks.select("chunk_id", "jurisdiction", "is_stale"), "chunk_id", few_values(best, "chunk_id", rows_at_most=most))
    kept = (
        meta.join(broadcast_when(few, best), "chunk_id")
        .join(broadcast_when(few, wanted), "query_id")
        .where(~F.col("is_stale") & allowed_jurisdiction(F.col("jurisdiction"), F.col("wanted")))
        .select("query_id", "chunk_id", "score")
    )
    return ranked(kept, n, F.desc("score"), F.asc("chunk_id"))


# -- vector search ---------------------------------------------------------------------


class _Block(_Best):
    """A block of query vectors with their filters, small enough for one task."""

    def __init__(self, ids, vectors, jurisdictions, doc_types, limits):
        super().__init__(ids, limits)
        self.matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(jurisdictions, doc_types)):
            groups.setdefault(key, []).append(i)
        self.groups = [(j, t, np.array(rows)) for (j, t), rows in groups.items()]

    def offer(self, chunk_ids, vectors, jurisdictions, doc_types) -> None:
        for wanted, doc_type, rows in self.groups:
            mask = np.ones(len(chunk_ids), dtype=bool)
            if wanted is not None:
                mask &= (jurisdictions == wanted) | (jurisdictions == NATIONAL)
            if doc_type is not None:
                mask &= doc_types == doc_type
            if not mask.any():
                continue
            ids = chunk_ids[mask]
            scores = np.round(vectors[mask] @ self.matrix[rows].T, SCORE_DIGITS)
            for column, row in enumerate(rows):
                self.keep(row, scores[:, column], ids)


def _offer_arrow(block: _Block, batch: pa.RecordBatch) -> None:
    if not batch.num_rows:
        return
    vectors = batch.column("embedding").flatten()
    block.offer(
        batch.column("chunk_id").to_numpy(zero_copy_only=False),
        vectors.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1),
        batch.column("jurisdiction").to_numpy(zero_copy_only=False),
        batch.column("document_type").to_numpy(zero_copy_only=False),
    )


def query_frame(queries: DataFrame, n: int) -> DataFrame:
    limit = F.col("fetch") if "fetch" in queries.columns else F.lit(n)
    return queries.where(F.size("embedding") > 0).select(
        F.col("query_id").cast("string").alias("query_id"),
        l2_normalise(F.col("embedding")).alias("embedding"),
        F.col("jurisdiction").alias("wanted"),
        F.col("doc_type").alias("wanted_type"),
        limit.cast("int").alias("fetch"),
    )


def grouped_search(index: VectorGroups, queries: DataFrame, n: int = DENSE_FETCH) -> DataFrame:
    """``dense_search`` over grouped vectors: the same hits, from the groups that may hold them only."""
    prepared = materialise(query_frame(queries, n))
    found = search_groups(index, prepared, SCORE_DIGITS).join(prepared.select("query_id", "fetch"), "query_id")
    return ranked(found, F.col("fetch"), F.desc("score"), F.asc("chunk_id")).drop("fetch")


def vector_search(
    vectors: DataFrame | VectorGroups, queries: DataFrame, n: int = DENSE_FETCH, rows_at_most: int | None = None
) -> DataFrame:
    """Exact cosine top ``n`` per query, over plain or grouped vectors."""
    if isinstance(vectors, VectorGroups):
        return grouped_search(vectors, queries, n)
    return dense_search(vectors, queries, n, rows_at_most=rows_at_most)


def dense_search(
    vectors: DataFrame, queries: DataFrame, n: int = DENSE_FETCH, block: int = QUERY_BLOCK, rows_at_most: int | None = None
) -> DataFrame:
    """Exact cosine top ``n`` per query: ``query_id, chunk_id, score, rank``.

    ``vectors`` holds unit vectors: ``chunk_id, embedding, jurisdiction,
    document_type, is_stale``. ``queries`` holds ``query_id, embedding,
    jurisdiction, doc_type`` and optionally ``fetch``. Up to one block of queries
    travels to the vectors, which then are scanned once without a shuffle; each
    task returns only its own best rows. For more queries the vectors are put into
    groups first, and each query meets only those groups that may hold one of its
    hits. A query without a vector finds nothing; a NULL vector, or one of another
    width than the query's, is not compared with it. A caller that has counted the
    queries gives their number as ``rows_at_most``.
    """
    prepared = query_frame(queries, n)
    if not (at_most(prepared.select("query_id"), block) if rows_at_most is None else rows_at_most <= block):
        return grouped_search(stored_groups(vectors), queries, n)
    pool = vectors.where(~F.col("is_stale")).select("chunk_id", "embedding", "jurisdiction", "document_type")
    rows = prepared.collect()
    best = ranked(_scan_widths(pool, rows), max((r.fetch for r in rows), default=n) or 0, F.desc("score"), F.asc("chunk_id"))
    limits = F.broadcast(prepared.select("query_id", "fetch"))
    return best.join(limits, "query_id").where("rank <= fetch").drop("fetch")


def _needed(pool: DataFrame, rows: list) -> DataFrame:
    """Leaves out jurisdictions and document types that no query of the block can match."""
    places = {r.wanted for r in rows}
    types = {r.wanted_type for r in rows}
    if rows and None not in places:
        pool = pool.where(F.col("jurisdiction").isin(*places, NATIONAL))
    if rows and None not in types:
        pool = pool.where(F.col("document_type").isin(*types))
    return pool


def _scan_widths(pool: DataFrame, rows: list) -> DataFrame:
    """One scan for each width of the block's queries, which is one as a rule."""
    widths = sorted({len(r.embedding) for r in rows}) or [0]
    scans = []
    for width in widths:
        own = [r for r in rows if len(r.embedding) == width]
        scans.append(_scan_with_block(_needed(pool, own).where(F.size("embedding") == width), own))
    return reduce(DataFrame.unionByName, scans)


def _scan_with_block(pool: DataFrame, rows: list) -> DataFrame:
    fields = ("query_id", "embedding", "wanted", "wanted_type", "fetch")
    shared = pool.sparkSession.sparkContext.broadcast([[r[f] for r in rows] for f in fields])

    def scan(batches):
        if shared.value[0]:
            best = _Block(*shared.value)
            for batch in batches:
                _offer_arrow(best, batch)
            yield from best.rows(HITS_ARROW).to_batches()

    return pool.mapInArrow(scan, HITS)


# -- schedule boost --------------------------------------------------------------------


def wants_boost(query: Column) -> Column:
    return contains_any(F.lower(query), BOOST_KEYWORDS)


def append_boost(dense: DataFrame, queries: DataFrame, boost: DataFrame) -> DataFrame:
    """Adds the boost hits after each triggering query's own list.

    ``boost`` is one ranked list of at most ten hits, ``chunk_id, score, rank``.
    Ranks continue after the query's last dense hit, skipping ids it already has.
    """
    triggered = queries.where(wants_boost(F.col("query"))).select("query_id", F.lit(BOOST_TYPE).alias("list"))
    offered = triggered.join(
        F.broadcast(
            boost.where(F.col("rank") <= BOOST_FETCH).select(
                F.lit(BOOST_TYPE).alias("list"), "chunk_id", "score", F.col("rank").alias("boost_rank")
            )
        ),
        "list",
    )
    both = dense.select(
        "query_id", "chunk_id", "score", "rank", F.lit(None).cast("int").alias("boost_rank")
    ).unionByName(offered.select("query_id", "chunk_id", "score", F.lit(None).cast("int").alias("rank"), "boost_rank"))
    single = both.groupBy("query_id", "chunk_id").agg(
        F.coalesce(F.max(F.when(F.col("rank").isNotNull(), F.col("score"))), F.max("score")).alias("score"),
        F.max("rank").alias("own_rank"),
        F.max("boost_rank").alias("boost_rank"),
    )
    window = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("own_rank"), F.asc("boost_rank"))
    return single.select(
        "query_id",
        "chunk_id",
        "score",
        F.row_number().over(window).alias("rank"),
        F.col("own_rank").isNull().alias("boosted"),
    )
