"""Exact nearest-vector search that leaves out vectors which cannot be among a query's best.

Vectors are stored in groups. A group holds vectors of one width that share their
nearest centre and lie between ``lo`` and ``hi`` away from it, sorted by
jurisdiction, document type and distance; it knows how many it has of each
jurisdiction and type. By the triangle inequality none of them is nearer to a
query at distance d from the centre than ``max(0, d - hi, lo - d)``. A search
first scans the groups that promise most, which gives each
query a score that its last hit has at least, and then those of the other groups
that may reach it. Groups are described by a few numbers each; vectors of a group
are read and compared only if a query needs them.

Queries are a table too: they are packed into blocks of near queries, the pairs of
a block and a group that it needs are a table, and the hits of all pairs are merged
by query. Nothing but the centres, the descriptions of the groups and, while the
centres are chosen, a bounded sample of vectors reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.sizing import at_most, few_values, materialise, restrict
from clausewright.schema import NATIONAL

SAMPLE = 4096  # vectors of which the centres are chosen
CENTRES = 256  # of each width, at most
ROUNDS = 5  # of moving the centres to the middle of their vectors
WIDTHS = 64  # widths that get centres; vectors of further ones are never left out
GROUP_ROWS = 1024  # vectors of a group, more in very large collections
META_ROWS = 400_000  # groups whose descriptions are sent to all tasks at a time
QUERY_ROWS = 512  # queries of a block
QUERY_BYTES = 64 << 20  # of query vectors that are sent to all tasks at a time
PAIR_ROWS = 20_000  # pairs of a block and a group, of up to 2 kB each, that are sent to all tasks
PROBE = 4  # times a query's limit: vectors that the first scan looks at
BOUND_CELLS = 1 << 22
SLACK = 2e-6  # more than rounding can move a score or a bound
NEVER = 2**31 - 1  # expiry day of vectors that do not expire

ASSIGNED = "chunk_id string, embedding array<double>, jurisdiction string, document_type string, expiry int, width int, centre int, distance double"
PLACES = "width int, centre int, place array<double>"
KINDS = "array<struct<place:string,type:string,n:int>>"
DESCRIBED = f"width int, centre int, lo double, hi double, norm double, kinds {KINDS}"
GROUPS = f"{DESCRIBED}, ids array<string>, places array<string>, types array<string>, expiries array<int>, matrix binary"
BLOCKS = "width int, ids array<string>, places array<string>, types array<string>, fetch array<int>, matrix binary"
PAIRS = "block long, group_id string, rows array<int>"
HITS = "query_id string, chunk_id string, score double"


@dataclass
class VectorGroups:
    """Grouped vectors: ``groups`` as ``GROUPS`` says and ``group_id``; ``centres`` as ``PLACES`` says."""

    groups: DataFrame
    centres: DataFrame
    day: int = -(2**31)  # vectors that expire before this day (since 1970) are not found


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long lists as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def centre_arrays(centres: DataFrame) -> dict[int, np.ndarray]:
    """Centres by width; there are at most ``CENTRES`` for each of at most ``WIDTHS`` widths."""
    rows = sorted(centres.collect(), key=lambda r: (r.width, r.centre))
    return {w: np.array([r.place for r in rows if r.width == w]) for w in {r.width for r in rows}}


def choose_centres(vectors: DataFrame) -> DataFrame:
    """Centres for the vectors of each width, by a few rounds of k-means over a sample picked by a hash of the ids."""
    usable = vectors.where(F.size("embedding") > 0).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    picked = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toArrow()
    width = pc.list_value_length(picked.column("embedding")).to_numpy()
    rows = []
    for w in np.unique(width)[:WIDTHS].tolist():
        own = matrix_of(picked.column("embedding").filter(pa.array(width == w)).combine_chunks(), w)
        places = own[: max(1, min(CENTRES, len(own) // 16))].copy()
        for _ in range(ROUNDS):
            nearest = distances(own, places).argmin(1)
            for k in np.unique(nearest):
                places[k] = own[nearest == k].mean(0)
        rows += [(w, k, p.tolist()) for k, p in enumerate(places)]
    return vectors.sparkSession.createDataFrame(rows, PLACES)


def group_vectors(vectors: DataFrame, centres: DataFrame | None = None, prefix: str = "") -> VectorGroups:
    """Puts vectors into groups.

    ``vectors``: ``chunk_id, embedding, jurisdiction, document_type`` and, if there, ``is_stale`` (such rows are left
    out) and ``expiry_date``. NULL and empty vectors are left out. With ``centres`` no new ones are chosen; ``group_id``
    begins with ``prefix``. The groups are lazy and meant to be written before they are searched; ``stored_groups`` does that. Vectors are sorted by ranges of
    (centre, jurisdiction, document type, distance, id), so many vectors of one kind, or at one place, are split.
    """
    if "is_stale" in vectors.columns:
        vectors = vectors.where(~F.col("is_stale"))
    centres = choose_centres(vectors) if centres is None else centres
    places = vectors.sparkSession.sparkContext.broadcast(centre_arrays(centres))
    expiry = F.lit(None) if "expiry_date" not in vectors.columns else F.unix_date("expiry_date")
    rows = vectors.where(F.size("embedding") > 0).select(
        "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "jurisdiction", "document_type",
        F.coalesce(expiry.cast("int"), F.lit(NEVER)).alias("expiry"),
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.list_value_length(batch.column("embedding")).to_numpy().astype(np.int32)
            centre, distance = np.full(len(width), -1, np.int32), np.zeros(len(width))
            for w in np.unique(width).tolist():
                if w in places.value:
                    own = np.flatnonzero(width == w)
                    far = distances(matrix_of(batch.column("embedding").take(pa.array(own)), w), places.value[w])
                    centre[own], distance[own] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), pa.array(centre), pa.array(distance)], [f.split()[0] for f in ASSIGNED.split(", ")])

    assigned = materialise(rows.mapInArrow(assign, ASSIGNED))
    most = max(GROUP_ROWS, -(-assigned.count() // (META_ROWS // 4)))
    order = ["width", "centre", "jurisdiction", "document_type", "distance", "chunk_id"]
    ordered = assigned.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = ordered.mapInArrow(lambda batches: pack(batches, most), GROUPS)
    numbered = packed.withColumn("group_id", F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))
    return VectorGroups(numbered, centres)


def pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted vectors into groups of one width and centre, and of ``most`` rows at most."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if not table.num_rows:
            continue
        starts = group_starts(table, most)
        for a, b in zip(starts[:-1], starts[1:]):
            yield packed_group(table.slice(a, b - a))
        rest = table.slice(starts[-1])
    if rest is not None:
        yield packed_group(rest)


def group_starts(table: pa.Table, most: int) -> list[int]:
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for name in ("width", "centre"):
        fresh[1:] |= np.diff(table.column(name).to_numpy()) != 0
    kinds = np.flatnonzero(fresh).tolist()
    return [s for a, b in zip(kinds, [*kinds[1:], table.num_rows]) for s in range(a, b, most)]


def packed_group(table: pa.Table) -> pa.RecordBatch:
    width, centre = (table.column(name)[0].as_py() for name in ("width", "centre"))
    far = table.column("distance").to_numpy()
    vectors = matrix_of(table.column("embedding").combine_chunks(), width)
    places, types = table.column("jurisdiction").to_pylist(), table.column("document_type").to_pylist()
    row = {
        "width": width,
        "centre": centre,
        "lo": float(far.min()) if centre >= 0 else 0.0,
        "hi": float(far.max()) if centre >= 0 else float("inf"),
        "norm": float((vectors**2).sum(1).max()),
        "kinds": [{"place": p, "type": t, "n": n} for (p, t), n in Counter(zip(places, types)).items()],
        "ids": table.column("chunk_id").to_pylist(),
        "places": places,
        "types": types,
        "expiries": table.column("expiry").to_pylist(),
        "matrix": vectors.tobytes(),
    }
    kind = pa.list_(pa.struct([("place", pa.string()), ("type", pa.string()), ("n", pa.int32())]))
    strings = pa.list_(pa.string())
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), kind, strings, strings, strings, pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def stored_groups(vectors: DataFrame) -> VectorGroups:
    """Writes the groups to the folder for intermediates, in a folder for each centre."""
    made = group_vectors(vectors)
    return VectorGroups(materialise(made.groups, by="centre"), made.centres)


class Descriptions:
    """What is known of all groups without reading their vectors, and which of them queries need."""

    def __init__(self, table: pa.Table, centres: dict[int, np.ndarray]):
        self.centres = centres
        for name in ("width", "centre", "lo", "hi", "norm"):
            setattr(self, name, table.column(name).to_numpy())
        self.group_id = np.array(table.column("group_id").to_pylist(), object)
        kinds = table.column("kinds").combine_chunks()
        self.owner = np.repeat(np.arange(len(kinds)), pc.list_value_length(kinds).to_numpy(zero_copy_only=False))
        flat = kinds.flatten()
        self.place, self.type = (np.array(flat.field(c).to_pylist(), object) for c in ("place", "type"))
        self.n = flat.field("n").to_numpy()
        self._held: dict[tuple, np.ndarray] = {}

    def held(self, place: str | None, kind: str | None) -> np.ndarray:
        """How many vectors of each group a query with these filters may find."""
        if (place, kind) not in self._held:
            fits = np.ones(len(self.owner), bool)
            if place is not None:
                fits &= (self.place == place) | (self.place == NATIONAL)
            if kind is not None:
                fits &= self.type == kind
            self._held[place, kind] = np.bincount(self.owner[fits], self.n[fits], len(self.lo))
        return self._held[place, kind]

    def best_scores(self, queries: np.ndarray, places: list, types: list) -> np.ndarray:
        """The most that any vector of a group can score, for queries of one width; minus infinity if it has none for it."""
        width = queries.shape[1]
        nearest = np.zeros((len(queries), len(self.lo)))
        known = (self.width == width) & (self.centre >= 0)
        if known.any():
            far = distances(queries, self.centres[width])[:, self.centre[known]]
            nearest[:, known] = np.maximum(0, np.maximum(far - self.hi[known], self.lo[known] - far))
        most = ((queries**2).sum(1)[:, None] + self.norm[None, :] - nearest**2) / 2
        most[:, self.width != width] = -np.inf
        for k, (place, kind) in enumerate(zip(places, types)):
            most[k, self.held(place, kind) == 0] = -np.inf
        return most

    def first_choice(self, most: np.ndarray, held: np.ndarray, limit: int) -> np.ndarray:
        """Groups that a query looks at first: the most promising ones, until they hold enough vectors."""
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > -np.inf]
        return order[: np.searchsorted(np.cumsum(held[order]), PROBE * limit) + 1]


def query_blocks(prepared: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Packs queries of one width that are near to each other; ``prepared`` as ``search.query_frame`` gives it."""
    shared = prepared.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.list_value_length(batch.column("embedding")).to_numpy().astype(np.int32)
            centre = np.full(len(width), -1, np.int32)
            for w in np.unique(width).tolist():
                if w in shared.value:
                    own = np.flatnonzero(width == w)
                    centre[own] = distances(matrix_of(batch.column("embedding").take(pa.array(own)), w), shared.value[w]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), pa.array(centre)], [*batch.schema.names, "width", "near"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.list_(pa.string())] * 3 + [pa.list_(pa.int32())]
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                for at in range(0, len(own), QUERY_ROWS):
                    part = batch.take(pa.array(own[at : at + QUERY_ROWS]))
                    lists = [pa.array([part.column(c).to_pylist()], k) for c, k in zip(("query_id", "wanted", "wanted_type", "fetch"), kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w], pa.int32()), *lists, pa.array([matrix_of(part.column("embedding"), w).tobytes()], pa.binary())], names
                    )

    named = materialise(prepared.where("fetch > 0").mapInArrow(near, prepared.schema.simpleString()[7:-1].replace(":", " ") + ", width int, near int"))
    ordered = named.repartitionByRange("width", "near", "query_id").sortWithinPartitions("width", "near", "query_id")
    return materialise(ordered.mapInArrow(block, BLOCKS).withColumn("block", F.monotonically_increasing_id()))


def pairs(blocks: DataFrame, described, floors: bool) -> DataFrame:
    """Pairs of a block and a group that some of its queries need: those they look at first or, with ``floors``, the
    others that may reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Descriptions = described.value
        step = max(1, BOUND_CELLS // max(1, len(known.lo)))
        for batch in batches:
            for row in batch.to_pylist():
                queries = np.frombuffer(row["matrix"], np.float64).reshape(-1, row["width"])
                found = [(np.empty(0, np.int64),) * 2]
                for at in range(0, len(queries), step):
                    here = slice(at, at + step)
                    most = known.best_scores(queries[here], row["places"][here], row["types"][here])
                    first = np.zeros(most.shape, bool)
                    for k, (place, kind, limit) in enumerate(zip(row["places"][here], row["types"][here], row["fetch"][here])):
                        first[k, known.first_choice(most[k], known.held(place, kind), limit)] = True
                    if floors:
                        floor = np.array([f if f is not None else -np.inf for f in row["floor"][here]])
                        first = ~first & (most > -np.inf) & (most >= floor[:, None] - SLACK)
                    query, group = np.nonzero(first)
                    found.append((query + at, group))
                query, group = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((query, group))
                group, query = group[order], query[order].astype(np.int32)
                one, start = np.unique(group, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(group)), pa.int32()), pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), row["block"])), pa.array(known.group_id[one], pa.string()), lists], ["block", "group_id", "rows"])

    columns = ["block", "width", "places", "types", "fetch", "matrix", *(["floor"] if floors else [])]
    return blocks.select(columns).mapInArrow(run, PAIRS)


def score_pairs(groups: DataFrame, wanted: DataFrame, blocks: DataFrame, day: int, digits: int) -> DataFrame:
    """The best hits of each pair's queries among the vectors of its group, with ``block`` and the query's ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                width = row["width"].as_py()
                vectors = np.frombuffer(row["matrix"].as_buffer(), np.float64).reshape(-1, width)
                ids = row["ids"].values.to_numpy(zero_copy_only=False)
                here, kind = (np.array(row[c].as_py(), object) for c in ("places", "types"))
                live = row["expiries"].values.to_numpy() >= day
                asked = row["rows"].values.to_numpy()
                queries = np.frombuffer(row["queries"].as_buffer(), np.float64).reshape(-1, width)[asked]
                scores = np.round(queries @ vectors.T, digits)
                names, limits, places, types = (row[c].as_py() for c in ("query_ids", "fetch", "asked_places", "asked_types"))
                for q, own in zip(asked.tolist(), scores):
                    fits = live
                    if places[q] is not None:
                        fits = fits & ((here == places[q]) | (here == NATIONAL))
                    if types[q] is not None:
                        fits = fits & (kind == types[q])
                    near, limit = np.flatnonzero(fits), limits[q]
                    if len(near) > limit:
                        near = near[own[near] >= np.partition(own[near], len(near) - limit)[len(near) - limit]]
                    near = near[np.lexsort((ids[near].astype(str), -own[near]))][:limit]
                    for column, values in zip(out, ([row["block"].as_py()] * len(near), [q] * len(near), [names[q]] * len(near), ids[near], own[near].tolist())):
                        column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["block", "row", "query_id", "chunk_id", "score"])

    renamed = {"ids": "query_ids", "places": "asked_places", "types": "asked_types", "matrix": "queries"}
    asked = blocks.select("block", "fetch", *(F.col(a).alias(b) for a, b in renamed.items()))
    centres = few_values(wanted.join(groups.select("group_id", "centre"), "group_id"), "centre", CENTRES + 1)
    some = restrict(restrict(groups, "centre", centres), "group_id", few_values(wanted, "group_id"))
    some = some.select("group_id", "width", "ids", "places", "types", "expiries", "matrix")
    met = some.join(F.broadcast(wanted) if at_most(wanted, PAIR_ROWS) else wanted, "group_id").join(F.broadcast(asked), "block")
    return met.drop("group_id").mapInArrow(run, f"block long, row int, {HITS}")


def search_groups(index: VectorGroups, prepared: DataFrame, digits: int = 6) -> DataFrame:
    """Hits ``query_id, chunk_id, score`` among which are the exact best of each query, as many as its ``fetch``.

    ``prepared``: ``query_id`` (distinct), ``embedding`` (array of double), ``wanted`` (a jurisdiction, which finds
    national vectors too, or NULL for all), ``wanted_type`` (or NULL), ``fetch``. Queries are taken in parts of ``QUERY_BYTES`` at most, descriptions in parts of ``META_ROWS`` groups.
    """
    spark: SparkSession = prepared.sparkSession
    centres = centre_arrays(index.centres)
    blocks = query_blocks(prepared, centres)
    columns = ["group_id", *(f.split()[0] for f in DESCRIBED.split(", "))]
    slices = index.groups.count() // META_ROWS + 1
    size = blocks.agg(F.sum(F.octet_length("matrix"))).first()[0] or 0
    passes = size // QUERY_BYTES + 1
    hits = []
    for part in range(slices):
        groups = index.groups.where(F.pmod(F.xxhash64("group_id"), F.lit(slices)) == part) if slices > 1 else index.groups
        known = groups.select(columns).toArrow()
        described = spark.sparkContext.broadcast(Descriptions(known, centres))
        for k in range(passes):
            own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k) if passes > 1 else blocks
            first = materialise(score_pairs(groups, materialise(pairs(own, described, False)), own, index.day, digits))
            ranks = F.array_sort(F.collect_list("score"), lambda a, b: F.signum(b - a).cast("int"))
            held = first.groupBy("block", "row").agg(ranks.alias("scores"))
            held = held.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "scores"))).alias("held"))
            floor = F.transform("fetch", lambda n, i: F.get(F.try_element_at("held", i), n - 1))
            floored = own.join(held, "block", "left").withColumn("floor", floor).drop("held")
            rest = materialise(pairs(floored, described, True))
            hits += [first, materialise(score_pairs(groups, rest, own, index.day, digits))]
    return reduce(DataFrame.unionByName, hits).select("query_id", "chunk_id", "score")
