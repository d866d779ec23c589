"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.components import components, move
from clausewright.llm.shingles import OnePermutation, Shingler, band_keys, chunks
from clausewright.operators.sizing import at_most, broadcast_when, materialise

BITS = 8  # 256 bins
ROWS = 6  # 42 bands of 6 bins: a pair at a similarity of 0.8 is missed with a chance below 3 in a million
BLOCK = 1024  # members of a bucket that are compared with those of another block at a time
SKETCH_LEAST = 0.68  # 4.8 standard deviations of a 256-bin estimate below 0.8
BROADCAST_IDS = 500_000  # ids of 8 bytes; more are joined by shuffling


def set_keys(hashes: np.ndarray, begins: np.ndarray) -> list[bytes | None]:
    """Digests of shingle sets, None for those without elements."""
    from hashlib import blake2b

    return [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begins[:-1], begins[1:])]


def signatures(docs: DataFrame, words: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each document: ``n_shingles``, ``key`` (digest of its shingle set), ``bands`` (a key for each band),
    ``sketch`` (the lowest byte of each bin), and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(words), OnePermutation(BITS)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            for group in chunks(texts.to_pylist()):
                hashes, begins = shingler.sets(group)
                bins = hasher.signatures(hashes, begins)
                bands = band_keys(bins, ROWS)
                low = (bins & np.uint64(255)).astype(np.uint8)
                sizes = np.diff(begins)
                keys = set_keys(hashes, begins)
                width = np.where(sizes > 0, bands.shape[1], 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32()), pa.array(bands[sizes > 0].ravel(), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array([r.tobytes() for r in low], pa.binary()), *(batch.column(c).slice(at, len(group)) for c in keep)],
                    ["doc_id", "n_shingles", "key", "bands", "sketch", *keep],
                )
                at += len(group)

    own = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(
        run, f"doc_id long, n_shingles long, key binary, bands array<long>, sketch binary{own}"
    )


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``key`` and ``shingles``, the ascending distinct shingle hashes of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            at = 0
            for group in chunks(batch.column(1).to_pylist()):
                hashes, begins = shingler.sets(group)
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(hashes.view(np.int64)))
                keys = pa.array(set_keys(hashes, begins), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), keys, lists], ["doc_id", "key", "shingles"])
                at += len(group)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, shingles array<long>")


def star_pairs(active: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's smallest member with the others, as far as their set sizes allow a link."""
    centre = active.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"))
    met = active.join(centre, "bucket").where("id <> c.id").where(alike_in_size(F.col("n"), F.col("c.n"), percent))
    return met.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def alike_in_size(n, m, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def in_blocks(active: DataFrame, extra: DataFrame) -> DataFrame:
    """Deals the members of each bucket out to pairs of blocks ``i <= j``; ``extra`` has more columns by ``id``.

    The largest component of a bucket has blocks of its own after the others'. They meet the others' blocks only, so
    its members are written once for each of these.
    """
    size = active.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    most = F.max(F.struct("m", "component"))
    size = size.groupBy("bucket").agg(F.sum("m").alias("all"), most.alias("most"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    size = size.select("bucket", F.col("most.component").alias("main"), blocks(F.col("all") - F.col("most.m")).alias("rest"), blocks(F.col("most.m")).alias("own"))
    rows = active.join(size.where("rest > 0"), "bucket").withColumn("inside", F.col("component") == F.col("main"))
    own = F.col("rest") + F.pmod(F.xxhash64("id"), "own")
    rows = rows.withColumn("block", F.when(F.col("inside"), own).otherwise(F.pmod(F.xxhash64("id"), "rest")).cast("int"))
    last = F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return rows.drop("other", "main", "rest", "own", "inside").join(extra, "id")


def near_in_sketch(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the rows of two blocks: a row, and the rows of other components whose sketches promise a link with it.

    A pair that shares several buckets comes up in the first of them only, as told by its band keys: sketches can agree
    in a band whose bins differ.
    """
    ids, n, component, block = (group.column(c).to_numpy() for c in ("id", "n", "component", "block"))
    i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
    low = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    keys = pc.list_flatten(group.column("bands")).to_numpy().reshape(len(ids), -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left:
        y = right[(component[right] != component[x]) & ((ids[right] > ids[x]) | (i != j))]
        y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent]
        y = y[(low[y] == low[x]).sum(axis=1) >= SKETCH_LEAST * low.shape[1]]
        y = y[(keys[y] == keys[x]).argmax(axis=1) == band]
        if len(y):
            yield x, y


def remaining_links(active: DataFrame, sketches: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different components that share a bucket, one for each two components of a group."""

    def promising(group: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)]
        for x, y in near_in_sketch(group, percent):
            found += [[x], y]
        ids = np.unique(group.column("id").to_numpy()[np.concatenate(found).astype(np.int64)])
        return pa.table({"bucket": np.full(len(ids), group.column("bucket")[0].as_py()), "id": ids})

    def linked(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy().copy()
        sets = group.column("shingles").chunk(0)
        values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        a, b = [], []
        for x, near in near_in_sketch(group, percent):
            own = values[at[x] : at[x + 1]]
            for y in near:
                if component[x] != component[y] and jaccard_least(own, values[at[y] : at[y + 1]], percent):
                    a.append(ids[x])
                    b.append(ids[y])
                    component[component == component[y]] = component[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    first = in_blocks(active, sketches).groupBy("bucket", "i", "j").applyInArrow(promising, "bucket long, id long")
    rest = materialise(active.join(first.distinct(), ["bucket", "id"], "left_semi"))
    rows = in_blocks(rest, sketches.join(whole.withColumnRenamed("doc_id", "id"), "id"))
    return rows.groupBy("bucket", "i", "j").applyInArrow(linked, "a long, b long")


def jaccard_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """True when two arrays of distinct values have at least that similarity."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keeps the pairs ``a, b`` whose full shingle sets reach the similarity. ``sets``: ``doc_id, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at_x), (y, at_y) = (
                (c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))
            )
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                keep[k] = jaccard_least(x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]], percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Groups documents whose word-shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns one
    row for each input row: ``doc_id, n_shingles, component_id, kept`` and the columns ``keep``.

    * Documents with equal sets are one class; only one row of it, with its smallest ``doc_id``, takes part in the
      search, so a group of copies or of repeated rows costs one row in each bucket.
    * A bucket holds the classes that agree in one band. Its smallest member is linked with all others, a star of
      candidates that are confirmed on their full sets; this joins most groups. Buckets that still hold two components
      are then searched for links that the star lacks: their members are cut into blocks, and tasks compare two blocks
      at a time, first by sketches, then, where these promise a link, by full sets. They write no candidate pairs, only
      one confirmed link for each two components that meet. So every pair that shares a bucket is confirmed on its full
      sets, refuted, or known to be connected already, and the rows written stay in proportion to the members.
    * NULL and empty texts, and texts of white space only, have no shingles: they stand alone. A text with fewer words
      than a shingle counts as one shingle. A NULL ``doc_id`` is linked with nothing and kept, with a NULL component.
      Repeated rows are copies with one id. Rows with one id and different texts are judged by their own texts: links join
      sets, not ids. An empty
      table gives an empty result.
    """
    signed = materialise(signatures(docs, words, keep))
    sets = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("bands", "bands"), ("sketch", "sketch"))]
    one = sets.groupBy("key").agg(F.min("doc_id").alias("class"), *first)
    own = materialise(one.withColumn("id", F.monotonically_increasing_id()))
    rows = own.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    active = materialise(rows.join(shared, "bucket").withColumn("component", F.col("id")))
    wanted = own.join(active.select("id").distinct(), "id", "left_semi").select("id", "key", F.col("class").alias("doc_id"))
    wanted = materialise(wanted)
    few = at_most(wanted, BROADCAST_IDS)
    ids = broadcast_when(few, wanted.select("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").join(ids, "doc_id", "left_semi")
    whole = shingle_sets(texts, words).join(broadcast_when(few, wanted), ["doc_id", "key"])
    whole = materialise(whole.groupBy("id").agg(F.first("shingles").alias("shingles")).select(F.col("id").alias("doc_id"), "shingles"))
    links = materialise(confirmed(star_pairs(active, percent), whole, percent))
    label = components(links)
    rest = move(active, "component", label)
    open_ = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = materialise(rest.join(open_.select("bucket"), "bucket", "left_semi"))
    sketches = own.select("id", "sketch", "bands").join(rest.select("id").distinct(), "id", "left_semi")
    more = materialise(remaining_links(rest, sketches, whole, percent))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    placed = move(own.select("key", "class", F.col("id").alias("component")), "component", label)
    least = placed.groupBy("component").agg(F.min("class").alias("least"))
    placed = placed.join(least, "component").select("key", "least")
    out = signed.select("doc_id", "n_shingles", "key", *keep).join(placed, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *keep)
