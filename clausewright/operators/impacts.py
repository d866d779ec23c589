"""Keyword search over groups of term lists that leaves out groups which cannot enter a query's list.

Chunks are sorted by length and cut into groups. A group is one row: its ids and
lengths, its terms, and for each term the chunks that have it. In columns of
their own stand, for each term, the highest frequency in a chunk and the least
length of a chunk that has it, which together bound what the term adds to a
score in this group, whatever the mean length of the collection is. A search
reads these columns, scores the groups that promise most for each query, and
then those of the others whose bound reaches the score of the query's last hit.

A task holds whole rows, several at a time and in more than one copy. A group
therefore has a bounded number of terms, and its longest lists, which have a number
for each term of each chunk, are kept as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.index import B, K1
from clausewright.operators.sizing import at_most, broadcast_when, few_values, materialise, restrict

GROUP_ROWS = 256  # chunks of a group, at most
GROUP_TERMS = 1 << 16  # terms of its chunks in all, at most, unless one chunk has more
LENGTH_CLASSES = 16  # classes of chunks whose length at most doubles
PASS_TERMS = 200_000  # weighted query terms that are sent to all tasks at a time
PROBE = 4  # times a query's limit: chunks of the groups that are scored first
PAIR_ROWS = 100_000  # groups with lists of queries that are sent to all tasks
CELLS = 1 << 18
SCORE_PAIRS = 1 << 19  # pairs of a query's term and a chunk that are added up at a time
DIGITS = 6
SLACK = 2e-6  # more than rounding can move a score or a bound

BOUNDS = "n int, words array<string>, most array<int>, least array<int>"
GROUPS = f"{BOUNDS}, ids array<string>, lengths array<int>, begins binary, places binary, counts binary"
AS_BYTES = ("begins", "places", "counts")
HITS = "query_id string, chunk_id string, score double"


def group_documents(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Groups of term lists, to be written before they are searched. ``documents``: ``chunk_id, dl, terms``.

    Chunks of about one length are dealt to tasks by their size in bytes, as equally many long chunks would be far
    more than short ones. ``group_id`` begins with ``prefix``.
    """
    length_class = F.floor(F.log2(F.col("dl") + 1) * LENGTH_CLASSES)
    dealt = documents.select("chunk_id", "dl", "terms", length_class.alias("_class")).hint("rebalance", "_class")
    packed = dealt.drop("_class").sortWithinPartitions("dl", "chunk_id").mapInArrow(pack, GROUPS)
    return packed.withColumn("group_id", F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))


def ranges(sizes: np.ndarray, most: int, rows: int | None = None) -> list[tuple[int, int]]:
    """Cuts items into runs of ``rows`` items and of sizes that add up to ``most`` at most, or of one item."""
    before, out, a = np.append(0, np.cumsum(sizes, dtype=np.int64)), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(before, before[a] + most, "right")) - 1)
        out.append((a, b if rows is None else min(b, a + rows)))
        a = out[-1][1]
    return out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        sizes = pc.list_value_length(table.column("terms")).fill_null(0).to_numpy()
        groups = ranges(sizes, GROUP_TERMS, GROUP_ROWS)
        for a, b in groups[:-1]:
            yield with_bytes(packed_group(table.slice(a, b - a).combine_chunks()))
        # a copy of the chunks that are left, as a slice would keep the whole batch
        rest = table.take(pa.array(range(*groups[-1]), pa.int64())) if groups else None
    if rest is not None:
        yield with_bytes(packed_group(rest.combine_chunks()))


def with_bytes(group: pa.RecordBatch) -> pa.RecordBatch:
    """The same with its longest lists as bytes, as few for each number as the largest one needs.

    What is kept is each number's difference from the one before, modulo the width, which the files compress better.
    """

    def packed(numbers: np.ndarray) -> bytes:
        own = numbers.astype(np.min_scalar_type(numbers.max(initial=0)).newbyteorder("<"))
        return np.diff(own, prepend=own.dtype.type(0)).astype(own.dtype).tobytes()

    columns = [pa.array([packed(c.values.to_numpy())], pa.binary()) if n in AS_BYTES else c for n, c in zip(group.schema.names, group.columns)]
    return pa.RecordBatch.from_arrays(columns, group.schema.names)


def numbers_of(column: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers of a list that is kept as bytes."""
    raw = column.as_buffer()
    steps = np.frombuffer(raw, f"<u{raw.size // n}") if n else np.empty(0, np.uint8)
    return np.cumsum(steps, dtype=steps.dtype)


def packed_group(table: pa.Table) -> pa.RecordBatch:
    lists = table.column("terms").combine_chunks()
    flat = lists.flatten()
    place = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    length = table.column("dl").to_numpy().astype(np.int64)
    coded = flat.field("term").dictionary_encode()
    sorting = pc.array_sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(sorting), np.empty(len(sorting), dtype=np.int64)
    rank[sorting.to_numpy()] = np.arange(len(sorting))
    term = rank[coded.indices.to_numpy()]
    order = np.argsort(term, kind="stable")  # places rise already
    count = flat.field("tf").to_numpy(zero_copy_only=False)[order]
    place, begins = place[order], np.searchsorted(term[order], np.arange(len(words) + 1))
    some = begins[:-1]
    most = np.maximum.reduceat(count, some) if len(words) else count
    least = np.minimum.reduceat(length[place], some) if len(words) else count
    numbers = [pa.array(x, pa.int32()) for x in (most, least, length, begins, place, count)]
    lists = [words, *numbers[:2], table.column("chunk_id").combine_chunks(), *numbers[2:]]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *columns], [f.split()[0] for f in GROUPS.split(", ")])


class Asked:
    """Weighted terms of some queries."""

    def __init__(self, weights: pa.Table, avgdl: float):
        self.ids, query = np.unique(np.array(weights.column("query_id").to_pylist(), object), return_inverse=True)
        words, term = np.unique(np.array(weights.column("term").to_pylist(), object), return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], weights.column("weight").to_numpy()[order]
        self.begins = np.searchsorted(term[order], np.arange(len(words) + 1))
        self.words, self.avgdl = pa.array(words.tolist(), pa.string()), avgdl

    def impact(self, tf, dl):
        return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / self.avgdl))

    def met(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a group's words those that queries ask for, once for each: place among the words, query, weight."""
        found = pc.index_in(words, value_set=self.words)
        where = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term = found.drop_null().to_numpy(zero_copy_only=False)
        n = self.begins[term + 1] - self.begins[term]
        pair = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(pair)) + (self.begins[term] - np.cumsum(n) + n)[pair]
        return where[pair], self.query[at], self.weight[at]

    def bounds(self, row: dict) -> np.ndarray:
        """The most that any chunk of a group can score, for each query."""
        where, query, weight = self.met(row["words"].values)
        top = self.impact(*(row[c].values.to_numpy()[where].astype(np.float64) for c in ("most", "least")))
        return np.bincount(query, np.maximum(weight, 0) * top, len(self.ids))

    def scores(self, row: dict, wanted: np.ndarray) -> np.ndarray:
        """The scores of a group's chunks for some queries, a row for each."""
        where, query, weight = self.met(row["words"].values)
        compact = np.full(len(self.ids), -1)
        compact[wanted] = np.arange(len(wanted))
        own = compact[query] >= 0
        where, query, weight = where[own], compact[query[own]], weight[own]
        begins = numbers_of(row["begins"], len(row["words"].values) + 1).astype(np.int64)
        place, count = (numbers_of(row[c], begins[-1]) for c in ("places", "counts"))
        length, size = row["lengths"].values.to_numpy().astype(np.float64), len(row["ids"].values)
        n = begins[where + 1] - begins[where]
        sums = np.zeros(len(wanted) * size)
        for a, b in ranges(n, SCORE_PAIRS):
            own = n[a:b]
            pair = np.repeat(np.arange(a, b), own)
            at = np.arange(len(pair)) + np.repeat(begins[where[a:b]] - np.cumsum(own) + own, own)
            add = weight[pair] * self.impact(count[at].astype(np.float64), length[place[at]])
            np.add.at(sums, query[pair] * size + place[at], add)
        return sums.reshape(-1, size)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k] for name in batch.schema.names}


def first_pairs(groups: DataFrame, asked, limit: int) -> DataFrame:
    """``query, group_id``: the groups that promise most for each query, with ``PROBE`` times ``limit`` chunks at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        bound, ids, sizes = [], [], []

        def fewest() -> np.ndarray:
            """Marks, for each query, the most promising groups so far that hold enough chunks."""
            matrix, n = np.array(bound), np.array(sizes)
            order = np.argsort(-matrix, axis=0, kind="stable")
            before = np.cumsum(n[order], axis=0) - n[order]
            marks = np.zeros(matrix.shape, bool)
            np.put_along_axis(marks, order, before < PROBE * limit, axis=0)
            return marks & (matrix > 0)

        for batch in batches:
            for row in rows_of(batch):
                bound.append(own.bounds(row))
                ids.append(row["group_id"].as_py())
                sizes.append(row["n"].as_py())
                if len(bound) * len(own.ids) > 4 * CELLS and len(bound) > 64:
                    keep = np.flatnonzero(fewest().any(axis=1))
                    if len(keep) < len(bound) // 2:
                        bound, ids, sizes = ([x[k] for k in keep] for x in (bound, ids, sizes))
        if bound:
            group, query = np.nonzero(fewest())
            most = np.array(bound)[group, query]
            columns = [pa.array(query.astype(np.int32)), pa.array([ids[k] for k in group], pa.string()), pa.array(np.array(sizes, np.int32)[group]), pa.array(most)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "group_id", "n", "most"])

    best = groups.select("group_id", *(f.split()[0] for f in BOUNDS.split(", "))).mapInArrow(run, "query int, group_id string, n int, most double")
    before = Window.partitionBy("query").orderBy(F.desc("most"), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("n").over(before), F.lit(0))
    return best.withColumn("held", held).where(F.col("held") < PROBE * limit).select("query", "group_id")


def further_pairs(groups: DataFrame, asked, floors) -> DataFrame:
    """``query, group_id``: groups whose bound reaches the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        for batch in batches:
            for row in rows_of(batch):
                bound = own.bounds(row)
                query = np.flatnonzero((bound > 0) & (bound * (1 + 1e-12) >= floors.value - SLACK)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array([row["group_id"].as_py()] * len(query), pa.string())], ["query", "group_id"])

    return groups.select("group_id", "words", "most", "least").mapInArrow(run, "query int, group_id string")


def score_pairs(groups: DataFrame, pairs: DataFrame, asked, limit: int) -> DataFrame:
    """The best hits of the queries among the chunks of the groups that they are paired with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        for batch in batches:
            for row in rows_of(batch):
                wanted, ids = np.sort(row["queries"].values.to_numpy()), row["ids"].values.to_numpy(zero_copy_only=False)
                step = max(1, CELLS // len(ids))
                out: list[list] = [[], [], []]
                for at in range(0, len(wanted), step):
                    sums = own.scores(row, wanted[at : at + step])
                    for query, score in zip(wanted[at : at + step], sums):
                        near = np.flatnonzero(score > 0)
                        score = np.round(score, DIGITS)
                        if len(near) > limit:
                            near = near[score[near] >= np.partition(score[near], len(near) - limit)[len(near) - limit]]
                        near = near[np.lexsort((ids[near].astype(str), -score[near]))][:limit]
                        for column, values in zip(out, ([own.ids[query]] * len(near), ids[near], score[near].tolist())):
                            column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.float64()))], ["query_id", "chunk_id", "score"])

    lists = materialise(pairs.groupBy("group_id").agg(F.collect_list("query").alias("queries")))
    some = restrict(groups, "group_id", few_values(lists, "group_id"))
    few = at_most(lists, PAIR_ROWS)
    return some.drop("n", "most", "least").join(broadcast_when(few, lists), "group_id").mapInArrow(run, HITS)


def grouped_hits(groups: DataFrame, weights: DataFrame, limit: int, avgdl: float | None) -> DataFrame:
    """Candidates for the ``limit`` best scores of each query: ``query_id, chunk_id, score``.

    ``weights``: ``query_id, term, weight``. Queries are taken in passes of about ``PASS_TERMS`` terms, whose weights
    are the only thing that is sent to all tasks; the driver holds one pass at a time.
    """
    spark = groups.sparkSession
    weights = materialise(weights.select(F.col("query_id").cast("string").alias("query_id"), "term", "weight"))
    passes = weights.count() // PASS_TERMS + 1
    hits = [spark.createDataFrame([], HITS)]
    for k in range(passes):
        table = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow()
        if not table.num_rows or avgdl is None:
            continue
        own = Asked(table, avgdl)
        asked = spark.sparkContext.broadcast(own)
        first = materialise(first_pairs(groups, asked, limit))
        found = materialise(score_pairs(groups, first, asked, limit))
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        held = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") == limit).select("query_id", "score").toArrow()
        floor = np.zeros(len(own.ids))
        floor[np.searchsorted(own.ids, np.array(held.column("query_id").to_pylist(), object))] = held.column("score").to_numpy()
        further = further_pairs(groups, asked, spark.sparkContext.broadcast(floor)).join(broadcast_when(at_most(first, PAIR_ROWS), first), ["query", "group_id"], "left_anti")
        hits += [found, materialise(score_pairs(groups, materialise(further), asked, limit))]
    return reduce(DataFrame.unionByName, hits)
