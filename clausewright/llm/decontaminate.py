"""Benchmark decontamination by greedy string tiling over token seeds with rolling hashes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import Shingler, chunks
from clausewright.operators.sizing import materialise

SEED = 5  # words; also the least length of a tile. A shorter item is a seed as a whole
COVERAGE = 0.6  # of a test item's words, from which a document counts as contaminated
COMMON = 32  # places of the items that share a seed, beyond which the seed alone need not call them up
SLICE_CHARS = 8_000_000  # of the benchmark that is sent to the executors at a time
PUNCTUATION = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))

# First and last code point of scripts that set no blanks between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3041, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF),
)


@cache
def cutter() -> tuple[dict[int, str], frozenset[str]]:
    """What to put in place of characters outside ASCII that separate words or are words of their own, and these."""
    import unicodedata

    put = {c: f" {chr(c)} " for a, b in UNSPACED for c in range(a, b + 1)}
    put |= {c: " " for c in range(128, 0x20000) if unicodedata.category(chr(c))[0] in "PZ"}
    return put, frozenset(map(chr, put))


def bare_words(text: str) -> list[bytes]:
    """Lower-cased words without punctuation; of scripts that set no blanks, each character is a word."""
    text = text.lower()
    if not text.isascii():
        put, special = cutter()
        text = text if special.isdisjoint(set(text)) else text.translate(put)
    return text.encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()


def tile(points: list[tuple[int, int]], text: list[bytes], item: list[bytes], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest matches first, none of which overlap in either sequence.

    ``points`` are places (in the text, in the item) where ``least`` words agree. Returns start in the text, start in
    the item, length. Of equally long matches the earlier one in the text wins, then the earlier one in the item.
    """
    queue = []
    runs: dict[int, list[int]] = {}
    for p, q in sorted(set(points)):
        if text[p : p + least] == item[q : q + least]:
            runs.setdefault(p - q, []).append(p)
    for shift, places in runs.items():
        begin = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] != places[k - 1] + 1:
                length = places[k - 1] - places[begin] + least
                queue.append((-length, places[begin], places[begin] - shift))
                begin = k
    heapq.heapify(queue)
    in_text, in_item, tiles = set(), set(), []
    while queue:
        minus, p, q = heapq.heappop(queue)
        free = [p + k not in in_text and q + k not in in_item for k in range(-minus)]
        if all(free):
            tiles.append((p, q, -minus))
            in_text.update(range(p, p - minus))
            in_item.update(range(q, q - minus))
            continue
        begin = None
        for k in range(len(free) + 1):  # what is left of a match that a longer one has cut
            if k < len(free) and free[k]:
                begin = k if begin is None else begin
            elif begin is not None:
                if k - begin >= least:
                    heapq.heappush(queue, (begin - k, p + begin, q + begin))
                begin = None
    return sorted(tiles)


def covered(hit: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """How many words of each item stand under its seeds that are hit; ``begins`` are the items' first seeds."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    mark = np.zeros(len(hit) + (size - 1) * (len(begins) - 1), bool)
    mark[(np.arange(len(hit)) + owner * (size - 1))[hit]] = True
    under = mark.copy()
    for k in range(1, size):
        under[k:] |= mark[: len(mark) - k]
    words = begins[:-1] + (size - 1) * np.arange(len(begins) - 1)
    return np.add.reduceat(under, words, dtype=np.int64) if len(words) else np.zeros(0, np.int64)


def telling(seeds: np.ndarray, begins: np.ndarray, size: int, coverage: float) -> np.ndarray:
    """The seeds of which a text must have at least one to reach an item's coverage.

    Of seeds that more than ``COMMON`` places of the items share, an item leaves out the first ones, as many as cover
    too little of it together. So nothing is lost, and a passage that very many items share does not call up all of them.
    """
    _, kind, count = np.unique(seeds, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count[kind] > COMMON)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[common]
    first = np.diff(owner, prepend=-1) > 0
    adds = np.where(first, size, np.minimum(np.diff(common, prepend=0), size))  # words that no seed before it covers
    words = np.cumsum(adds)
    words -= np.repeat((words - adds)[first], np.diff(np.flatnonzero(np.append(first, True))))
    keep = np.ones(len(seeds), bool)
    keep[common] = words / (np.diff(begins)[owner] + size - 1) >= coverage
    return keep


def seed_search(size: int, items: list[tuple[int, str]], least: np.ndarray, coverage: float):
    """A search in texts for the items whose seeds have ``size`` words.

    For each text that could cover an item it gives the text's number, and by number of the item the places (in the
    text, in the item) of their common seeds. Items are called up by their telling seeds, then bounded by the words
    under all seeds that the text has, and places are listed only for those that can reach the coverage.
    """
    shingler = Shingler(size, bare_words)
    chosen = np.flatnonzero(least == size)
    seeds, begins, _ = shingler.sequence([items[t][1] for t in chosen])
    lengths = np.diff(begins) + size - 1
    keep = telling(seeds, begins, size, coverage)
    order = np.argsort(seeds[keep], kind="stable")
    keys, owner = seeds[keep][order], np.repeat(np.arange(len(chosen)), np.diff(begins))[keep][order]
    bits = np.uint64((1 << 22) - 1)
    maybe = np.zeros(1 << 22, bool)
    maybe[(keys & bits).astype(np.int64)] = True

    def places(own: np.ndarray, called: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        sizes = np.diff(begins)[called]
        own_begins = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(own_begins[-1]) - np.repeat(own_begins[:-1], sizes)
        theirs = seeds[np.repeat(begins[:-1][called], sizes) + place]
        by_seed = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[by_seed], theirs, "left"), np.searchsorted(own[by_seed], theirs, "right")
        enough = covered(high > low, own_begins, size) / lengths[called] >= coverage
        found = {}
        for c in np.flatnonzero(enough):
            span = range(int(own_begins[c]), int(own_begins[c + 1]))
            found[int(chosen[called[c]])] = [(int(p), int(place[k])) for k in span for p in by_seed[low[k] : high[k]]]
        return found

    def search(group: list[str | None]) -> Iterator[tuple[int, dict[int, list[tuple[int, int]]]]]:
        own, starts, _ = shingler.sequence(group)
        hits = np.flatnonzero(maybe[(own & bits).astype(np.int64)])
        low, high = np.searchsorted(keys, own[hits], "left"), np.searchsorted(keys, own[hits], "right")
        hits, low, high = hits[high > low], low[high > low], high[high > low]
        doc = np.searchsorted(starts, hits, "right") - 1
        for d in np.unique(doc):
            ranges = np.unique(np.stack([low[doc == d], high[doc == d]]), axis=1).T
            called = np.unique(np.concatenate([owner[a:b] for a, b in ranges]))
            if points := places(own[starts[d] : starts[d + 1]], called):
                yield int(d), points

    return search


def slice_leaks(docs: DataFrame, items: list[tuple[int, str]], coverage: float) -> DataFrame:
    """Documents that contain enough of one of these test items."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [(i, bare_words(t)) for i, t in held.value]
        least = np.array([min(SEED, len(words)) for _, words in tests], np.int64)
        searches = [seed_search(int(n), held.value, least, coverage) for n in np.unique(least[least > 0])]
        for batch in batches:
            at = 0
            for group in chunks(batch.column(1).to_pylist()):
                ids, found, share, tiles = [], [], [], []
                met: dict[int, dict[int, list[tuple[int, int]]]] = {}
                for search in searches:
                    for d, points in search(group):
                        met.setdefault(d, {}).update(points)
                for d, points in met.items():
                    words = bare_words(group[d])
                    for t, pairs in points.items():
                        item, test = tests[t]
                        laid = tile(pairs, words, test, int(least[t]))
                        part = sum(n for _, _, n in laid) / len(test)
                        if part >= coverage:
                            ids.append(batch.column(0)[at + int(d)].as_py())
                            found.append(item)
                            share.append(part)
                            tiles.append([{"doc_word": p, "item_word": q, "n_words": n} for p, q, n in laid])
                kind = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), pa.array(found, pa.int64()), pa.array(share, pa.float64()), pa.array(tiles, kind)],
                    ["row", "item_id", "coverage", "tiles"],
                )
                at += len(group)

    return docs.mapInArrow(run, "row binary, item_id long, coverage double, tiles array<struct<doc_word:long,item_word:long,n_words:long>>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Test items whose words are covered by tiles of a document, whatever their order there.

    ``docs``: ``text`` and any key in ``row`` (binary); ``benchmark``: ``item_id, text``. Words are lower-cased and
    freed of punctuation; in scripts without blanks between words each character is one. Every run of ``SEED`` words that a document shares with an item is a seed; matches grown
    from seeds are laid as tiles, the longest first, and an item leaks where its tiles cover at least ``coverage`` of
    its words. Returns ``row, item_id, coverage, tiles`` for each leak. An item with fewer than ``SEED`` words
    is one seed, so it leaks where it stands as a whole. NULL texts and texts without words cannot leak. The benchmark is sent to the tasks in slices of bounded size, one pass over the documents
    for each, so it may have any size; an empty one gives no leaks.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = total // SLICE_CHARS + 1
    found = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        one = slice_leaks(docs.select("row", "text"), [(r[0], r[1]) for r in part.toLocalIterator()], coverage)
        found = one if found is None else found.unionByName(one)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Adds to every row of a table with ``text`` whether it leaks a test item.

    Returns the columns of ``docs`` and ``n_items`` (items that leak), ``item_id`` (the best covered one; of equally
    covered ones the smallest), ``coverage`` and ``contaminated``; columns of these names in ``docs`` are replaced.
    Rows without a leak have 0, NULL, 0 and false. Rows with one text are judged alike: leaks are found by the text's
    digest, so repeated rows and NULL ids are no exception.
    """
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.select(key.alias("row"), "text")
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("minus"))).alias("best")
    found = leaks(keyed, benchmark, coverage).select("row", "item_id", "coverage").distinct()
    found = materialise(found.groupBy("row").agg(F.count("*").alias("_n"), best).withColumnRenamed("row", "_row"))
    own = {
        "n_items": F.coalesce("_n", F.lit(0)),
        "item_id": -F.col("best.minus"),
        "coverage": F.coalesce("best.coverage", F.lit(0.0)),
        "contaminated": F.col("_n").isNotNull(),
    }
    kept = [c for c in docs.columns if c not in own]
    return docs.join(found, key == F.col("_row"), "left").select(*kept, *[v.alias(k) for k, v in own.items()])
