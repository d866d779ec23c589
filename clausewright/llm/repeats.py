"""Byte strings that occur more than once in a collection, by column-wise construction of aligned suffix orders.

Every window of ``length`` bytes is named by its anchor, the seed of least hash
inside it, so equal windows have equal anchors at the same place. Consecutive
windows with one anchor form a string, and all strings with the same anchor a
collection. Within it strings are aligned at the anchor and equal windows start
in the same column. The suffix order of a collection is built from the last
column to the first: each round puts one byte in front of the suffix of every
string. The bytes, taken in suffix order, are that column's part of the
Burrows-Wheeler transform; they give the next order (smaller bytes first, equal
ones in their present order) and, with the lengths that neighbours have in
common, the next common lengths. Collections come one after the other from the
sorted files of a shuffle, each read once; of the transform only the column at
work is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import mix
from clausewright.llm.skew import BROADCAST_ROWS, join_distinct
from clausewright.operators.sizing import at_most, materialise

LENGTH = 400  # bytes of a string that counts as repeated
GROUP = 4096  # strings of a collection that are ordered together; a larger collection is taken window by window
PIECE_BITS = 20  # bytes are hashed in pieces of this size
KEYS = ["k1", "k2"]

RUNS = "k1 long, k2 long, start long, n int, anchor int, h long, s long, times long"
STRINGS = "h long, s long, times long, anchor int, n int, bytes binary"
HITS = "h long, s long, hits array<struct<at:int,n:int>>"


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` consecutive ones."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Windows:
    """Hashes of byte ranges, and runs of windows with one anchor. Two instances anywhere give the same."""

    def __init__(self, length: int):
        self.length, self.seed = length, max(1, length * 8 // 25)
        rng = np.random.default_rng(260713)
        self.letters = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = (1 << PIECE_BITS) + 1
        self.up, self.down = [], []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            for powers, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                step = np.full(size, b, np.uint64)
                step[0] = 1
                powers.append(np.multiply.accumulate(step))

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[which][data] * self.up[which][: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[which][starts])

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a piece of texts that end at ``ends``: first window, windows, anchor (from the first window), hash of the
        anchor's seed, hash of the string."""
        w = self.length - self.seed + 1
        place = np.arange(max(len(data) - self.seed + 1, 0), dtype=np.uint64)
        seeds = self.hashes(data, place.astype(np.int64), place.astype(np.int64) + self.seed, 0)
        low = np.uint64((1 << PIECE_BITS) - 1)
        least = (least_in_windows(seeds & ~low | place, w) & low).astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        window = np.arange(len(least))
        window = window[window + self.length <= np.repeat(ends, sizes)[: len(least)]]
        anchor = least[window]
        head = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
        start, anchor = window[head], anchor[head]
        n = np.diff(np.append(head, len(window)))
        return start, n, anchor - start, seeds[anchor], self.hashes(data, start, start + n - 1 + self.length, 1) ^ mix(n.astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; NULL is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def pieces(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that together hold every window: whole texts together, longer ones cut with an overlap."""
    most = 1 << PIECE_BITS
    begin = end = int(offsets[0])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - begin <= most:
            end = b
            continue
        if end > begin:
            yield begin, end
        while b - a > most:
            yield a, a + most
            a += most - overlap
        begin, end = a, b
    if end > begin:
        yield begin, end


def runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of windows with one anchor in each text, as ``RUNS`` says; ``docs``: ``k1, k2, text``.

    Equal strings of a text come once, with ``times``, and the windows of such strings once more without a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        names = [f.split()[0] for f in RUNS.split(", ")]
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = flat(batch.column(2))
            for a, b in pieces(offsets, length - 1):
                inside = np.clip(offsets, a, b) - a
                start, n, anchor, h, s = windows.runs(data[a:b], inside[1:])
                owner = np.searchsorted(offsets, start + a, side="right") - 1
                start = start + a - offsets[owner]
                order = np.lexsort((start, s, h, owner))
                same = np.ones(len(order), bool)
                same[:1] = False
                for c in (owner[order], h[order], s[order]):
                    same[1:] &= c[1:] == c[:-1]
                first = np.flatnonzero(~same)
                times = np.diff(np.append(first, len(order)))
                one = order[first]
                again = np.sort(order[np.repeat(times > 1, times)])
                joined = (np.diff(owner[again], prepend=-1) == 0) & (start[again] == np.concatenate(([-1], (start + n)[again][:-1])))
                opens = np.flatnonzero(~joined)
                total = np.add.reduceat(n[again], opens) if len(opens) else n[:0]
                mark = again[opens]
                everywhere, none = np.concatenate((one, mark)), np.arange(len(one) + len(mark)) >= len(one)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[owner[everywhere]]), pa.array(k2[owner[everywhere]]), pa.array(start[everywhere]),
                        pa.array(np.concatenate((n[one], total)).astype(np.int32)), pa.array(anchor[everywhere].astype(np.int32)),
                        pa.array(h[everywhere].view(np.int64), mask=none), pa.array(s[everywhere].view(np.int64), mask=none),
                        pa.array(np.concatenate((times, np.zeros(len(mark), np.int64)))),
                    ],
                    names,
                )

    return docs.select(*KEYS, "text").mapInArrow(run, RUNS)


def column_wise(group: np.ndarray, anchor: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes that several strings of a group have in the same column: the string, the window.

    String k is ``data[at[k]:at[k + 1]]``; groups are ascending numbers; column 0 is where the anchor begins.
    """
    size = np.diff(at)
    last = size - anchor
    base, zero = group * 257, at[:-1] + anchor
    order = np.arange(len(group))
    common = np.zeros(len(group), np.int64)  # bytes that a suffix has in common with the one before it
    found = [(order[:0], order[:0])]
    for column in range(int(last.max()) - 1, -int(anchor.max()) - 1, -1):
        there = (column < last) & (column >= -anchor)
        byte = np.where(there, data[np.where(there, zero + column, 0)].astype(np.int64) + 1, 0)
        transform = base + byte[order]
        in_order = np.all(transform[1:] >= transform[:-1])
        if in_order:
            least = common
        else:
            moved = np.argsort(transform, kind="stable")
            before = np.concatenate(([0], moved[:-1]))
            least = common[moved]
            order, transform = order[moved], transform[moved]
            far = np.flatnonzero((moved > before + 1) & (np.diff(transform, prepend=-1) == 0))
            if len(far):
                ranges = np.stack((before[far] + 1, moved[far] + 1), axis=1).ravel()
                least[far] = np.minimum.reduceat(np.append(common, 0), ranges)[::2]
        alike = (np.diff(transform, prepend=-1) == 0) & (byte[order] > 0)
        common = np.where(alike, least + 1, 0)
        if column <= 0:
            enough = common >= length
            enough[:-1] |= enough[1:]
            string = order[enough]
            found.append((string, column + anchor[string]))
    strings, windows = (np.concatenate(x) for x in zip(*found))
    return strings, windows


def ranges_of(windows: np.ndarray) -> list[dict]:
    """Ascending window numbers as ranges."""
    opens = np.flatnonzero(np.diff(windows, prepend=-2) != 1)
    n = np.diff(np.append(opens, len(windows)))
    return [{"at": a, "n": k} for a, k in zip(windows[opens].tolist(), n.tolist())]


def repeated_in_collections(strings: DataFrame, length: int) -> DataFrame:
    """The windows of each string that another string of its collection has too, as ``HITS`` says."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        h, s, anchor, parts = zip(*rows)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        group = np.cumsum(np.diff(np.array(h, np.int64), prepend=h[0]) != 0)
        string, window = column_wise(group, np.array(anchor, np.int64), np.frombuffer(b"".join(parts), np.uint8), at, length)
        order = np.lexsort((window, string))
        string, window = string[order], window[order]
        one, first = np.unique(string, return_index=True)
        hits = [ranges_of(w) for w in np.split(window, first[1:])] if len(one) else []
        columns = [pa.array([h[k] for k in one], pa.int64()), pa.array([s[k] for k in one], pa.int64())]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], ["h", "s", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if waiting and row[:2] == waiting[-1][:2]:
                    continue  # a text that occurs several times has been read more than once
                if len(waiting) >= GROUP and row[0] != waiting[-1][0]:
                    yield solved(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield solved(waiting)

    ordered = strings.repartition("h").sortWithinPartitions("h", "s")
    return ordered.select("h", "s", "anchor", "bytes").mapInArrow(run, HITS)


def repeated_window_by_window(strings: DataFrame, length: int) -> DataFrame:
    """The same for collections of any size: windows are counted by their hashes, combined before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            data, offsets = flat(batch.column("bytes"))
            h, s, times, n = (batch.column(c).to_numpy() for c in ("h", "s", "times", "n"))
            for k in range(batch.num_rows):
                at = np.arange(n[k], dtype=np.int64)
                own = windows.hashes(data[offsets[k] : offsets[k + 1]], at, at + length, 1)
                same = [pa.array(np.full(len(at), c[k])) for c in (h, s, times)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), pa.array(own.view(np.int64))], ["h", "s", "times", "at", "w"])

    split = strings.dropDuplicates(["h", "s"]).select(*(f.split()[0] for f in STRINGS.split(", ")))
    single = materialise(split.mapInArrow(run, "h long, s long, times long, at int, w long"))
    met = materialise(single.groupBy("h", "w").agg(F.sum("times").alias("all"), F.count("*").alias("m")).where("all > 1").drop("all"))
    hits = join_distinct(single, met, ["h", "w"], "m")
    return hits.groupBy("h", "s").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("hits"))


def texts_of(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Joins documents with a frame that has a row for each key of some of them, without moving the others if it can."""
    wanted = keyed.select(KEYS)
    few = docs.join(F.broadcast(wanted), KEYS, "left_semi") if at_most(wanted, BROADCAST_ROWS) else docs
    return few.join(keyed, KEYS)


def strings_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of strings given by a text's key and place, as ``STRINGS`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STRINGS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for text, strings in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py().encode("utf-8", "surrogatepass")
                rows = [(x["h"], x["s"], x["times"], x["anchor"], x["n"], text[x["start"] : x["start"] + x["n"] - 1 + length]) for x in strings]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    lists = wanted.groupBy(KEYS).agg(F.collect_list(F.struct("start", "n", "anchor", "h", "s", "times")).alias("strings"))
    return texts_of(docs, materialise(lists)).select("text", "strings").mapInArrow(run, STRINGS)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Finds and removes all bytes covered by a string of ``length`` bytes that also starts somewhere else.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts are judged as UTF-8 bytes, each within
    itself, by what is given, not by what is left. Returns a row for each row: ``doc_id``, ``n_bytes``, ``spans``
    (``start``, ``end``: the maximal removed ranges, ascending) and ``kept`` (the other bytes). NULL texts are empty; a
    text shorter than ``length`` keeps all. Rows that repeat a text, with the same ``doc_id`` or another or none, are
    copies of each other: each of at least ``length`` bytes is removed as a whole. An empty table gives an empty result.

    Strings are told apart by 128 bits of hashes, texts by 120 bits of a digest. A text that many rows have, a string
    that many texts have and a collection of many strings are each spread over tasks.
    """
    digest = F.sha2("text", 256)
    keys = [F.conv(F.substring(digest, p, 15), 16, 10).cast("long").alias(k) for p, k in ((1, "k1"), (16, "k2"))]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("*", *keys)
    found = materialise(runs(docs, length))
    copies = docs.where(F.octet_length("text") >= length).groupBy(KEYS).agg(F.count("*").alias("m"), F.min("doc_id").alias("least"))
    copies = materialise(copies.where("m > 1"))
    first = [F.first(c).alias(c) for c in ("n", "anchor", "start", *KEYS)]
    strings = materialise(found.where("h IS NOT NULL").groupBy("h", "s").agg(F.sum("times").alias("times"), F.count("*").alias("m"), *first))
    alone = F.sum(F.when(F.col("times") == 1, 1).otherwise(0))
    groups = materialise(strings.groupBy("h").agg(F.count("*").alias("d"), alone.alias("alone")).where("d > 1 AND alone > 0"))
    whole = strings.where("times > 1").select("h", "s", "m", F.array(F.struct(F.lit(0).alias("at"), "n")).alias("hits"))
    hits = [repeated_in_collections(strings_of(docs, join_distinct(strings, groups.where(F.col("d") <= GROUP), ["h"], "d"), length), length)]
    large = groups.where(F.col("d") > GROUP)
    if not large.isEmpty():
        hits.append(repeated_window_by_window(strings_of(docs, join_distinct(strings, large, ["h"], "d"), length), length))
    for some in hits:
        rest = materialise(some).join(strings.where("times = 1").select("h", "s", "m"), ["h", "s"])
        whole = whole.unionByName(rest.select("h", "s", "m", "hits"))
    own = join_distinct(found, copies.select(*KEYS, "m"), KEYS, "m", "left_anti")
    marks = join_distinct(own.where("h IS NOT NULL"), materialise(whole), ["h", "s"], "m").select(*KEYS, "start", F.explode("hits").alias("hit"))
    marks = marks.select(*KEYS, (F.col("start") + F.col("hit.at")).alias("start"), F.col("hit.n").cast("long").alias("n"))
    marks = marks.unionByName(own.where("h IS NULL").select(*KEYS, "start", F.col("n").cast("long")))
    marks = materialise(marks.groupBy(KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("marks")))
    gone = join_distinct(docs, copies.select(*KEYS, "m"), KEYS, "m").select("doc_id", *everything_removed())
    single = join_distinct(docs, copies.select(*KEYS, "m"), KEYS, "m", "left_anti")
    marked = removed(texts_of(single, marks), length)
    clean = single.join(broadcast_if_few(marks.select(KEYS)), KEYS, "left_anti")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    clean = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), spans, F.col("text").cast("binary").alias("kept"))
    return marked.unionByName(gone).unionByName(clean)


def broadcast_if_few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if at_most(keys, BROADCAST_ROWS) else keys


def everything_removed() -> list:
    n = F.octet_length("text").cast("long")
    return [n.alias("n_bytes"), F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"))).alias("spans"), F.lit(b"").alias("kept")]


def removed(docs: DataFrame, length: int) -> DataFrame:
    """Takes the marked windows of each text out."""
    out = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                own: list[dict] = []
                for mark in marks:
                    a, b = mark["start"], mark["start"] + mark["n"] - 1 + length
                    if own and a <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], b)
                    else:
                        own.append({"start": a, "end": b})
                begins = [0, *(x["end"] for x in own)]
                ends = [*(x["start"] for x in own), len(data)]
                sizes.append(len(data))
                spans.append(own)
                kept.append(b"".join(data[a:b] for a, b in zip(begins, ends)))
            columns = [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "spans", "kept"])

    return docs.select("doc_id", "text", "marks").mapInArrow(run, out)
