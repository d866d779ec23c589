"""Word shingles of whole texts as 64-bit hashes, computed with NumPy for many texts at a time.

A text is lower-cased (A-Z only), cut into words at the six ASCII white-space
characters and joined again with single blanks. The hash of a shingle is the
hash of its byte range in that form, taken as a difference of prefix sums, so
the cost does not depend on the number of words in a shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20  # texts are hashed in groups of about this size; one longer text is a group of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def chunks(texts: Iterable[str | None], most: int = CHUNK_BYTES) -> Iterator[list[str | None]]:
    """Consecutive groups of texts of about ``most`` characters."""
    group: list[str | None] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text) if text else 0
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


class Shingler:
    """Hashes word shingles. Two instances anywhere give the same hashes."""

    def __init__(self, words: int, tokens=plain_words):
        self.words = words
        self.tokens = tokens
        self.letters = np.random.default_rng(71993).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            base = 0x9E3779B97F4A7C15
            n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
            with np.errstate(over="ignore"):
                step = np.full(n, base, np.uint64)
                back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
                step[0] = back[0] = 1
                self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def sequence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes in text order: the hashes, where each text's begin (one more entry at the end), its words.

        A text with fewer words than a shingle has its whole sequence as one; a text without words has none.
        """
        split = [self.tokens(t) if t else [] for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        total = int(n_words.sum())
        count = np.where(n_words >= self.words, n_words - self.words + 1, np.minimum(n_words, 1))
        begins = np.concatenate(([0], np.cumsum(count)))
        if not total:
            return np.empty(0, np.uint64), begins, n_words
        buffer = np.frombuffer(b" ".join(b" ".join(w) for w in split if w) + b" ", np.uint8)
        self._powers(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.letters[buffer] * self.up[: len(buffer)], out=sums[1:])
        ends = np.flatnonzero(buffer == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        first = np.concatenate(([0], np.cumsum(n_words)))[:-1]  # of each text, in words
        head = np.arange(int(begins[-1])) - np.repeat(begins[:-1] - first, count)
        tail = head + np.repeat(np.minimum(n_words, self.words), count) - 1
        s, e = starts[head], ends[tail]
        return mix((sums[e] - sums[s]) * self.down[s]), begins, n_words

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each text in ascending order, and where each text's begin (one more at the end)."""
        hashes, begins, _ = self.sequence(texts)
        parts = []
        for a, b in zip(begins[:-1], begins[1:]):
            if b - a > 1:
                own = np.sort(hashes[a:b])
                parts.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            else:
                parts.append(hashes[a:b])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else hashes), np.concatenate(([0], np.cumsum(sizes)))


class OnePermutation:
    """One-permutation MinHash of shingle sets: every hash is used once, in the bin named by its top bits.

    Empty bins are filled by optimal densification: each empty bin walks its own
    fixed sequence over all bins and copies the first that was filled.
    """

    def __init__(self, bits: int = 8):
        self.bits, self.bins = bits, 1 << bits
        rng = np.random.default_rng(40627)
        self.start = rng.integers(0, self.bins, self.bins)
        self.stride = rng.integers(0, self.bins // 2, self.bins) * 2 + 1  # odd, so the walk meets every bin

    def signatures(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of bin values for each set, given the ascending hashes; sets without elements get zeros."""
        n = len(begins) - 1
        owner = np.repeat(np.arange(n), np.diff(begins))
        cell = owner * self.bins + (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        least = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.empty(0, bool)
        out = np.zeros(n * self.bins, np.uint64)
        there = np.zeros(n * self.bins, bool)
        out[cell[least]], there[cell[least]] = hashes[least], True
        some = np.repeat(np.diff(begins) > 0, self.bins)
        empty = np.flatnonzero(some & ~there)
        attempt = 0
        while len(empty):
            own = empty % self.bins
            donor = empty - own + (self.start[own] + attempt * self.stride[own]) % self.bins
            got = there[donor]
            out[empty[got]] = out[donor[got]]
            empty = empty[~got]
            attempt += 1
        return out.reshape(n, self.bins)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each run of ``rows`` bins; equal keys mean equal runs at the same place."""
    n, bins = signatures.shape
    bands = bins // rows
    odd = np.random.default_rng(5501).integers(0, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    runs = mix(signatures[:, : bands * rows].reshape(n, bands, rows))
    keys = (runs * odd).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(keys).view(np.int64)
