"""Fill-in-middle: texts cut at token boundaries that a learned rank index finds, written prefix-suffix-middle or suffix-prefix-middle.

A token is a run of ASCII letters or a single other character. The offsets of a
text's token boundaries, as a function of their rank, are covered by straight
segments of bounded error. A cut at rank r is predicted by r's segment and put
right by the residual stored for r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 64  # code points by which a segment may miss an offset; residuals fit into a byte
SEGMENT = 1024  # boundaries that a segment covers at most
FRACTION = 24  # bits after the binary point of a slope
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: texts left plain, and cut texts written suffix first

OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Offsets by rank: straight segments that miss no offset by more than ``error``, and what they miss each by.

    ``offsets`` do not decrease from one of ``starts`` to the next; no segment crosses a start. A segment runs through
    its first and last offset; one that misses an offset by too much is halved.
    """

    def __init__(self, offsets: np.ndarray, starts: np.ndarray, error: int = ERROR):
        if not 0 <= error <= 127:
            raise ValueError("error must be between 0 and 127")
        self.first = np.empty(0, np.int64)
        ends = np.append(starts[1:], len(offsets))
        per_run = -(-(ends - starts) // SEGMENT)
        within = np.arange(per_run.sum()) - np.repeat(np.cumsum(per_run) - per_run, per_run)
        low = np.repeat(starts, per_run) + within * SEGMENT
        high = np.minimum(low + SEGMENT, np.repeat(ends, per_run))
        fitted = []
        while len(low):
            slope = ((offsets[high - 1] - offsets[low]) << FRACTION) // np.maximum(high - 1 - low, 1)
            size = high - low
            at = np.cumsum(size) - size
            rank = np.arange(size.sum()) - np.repeat(at - low, size)
            missed = np.abs(offsets[rank] - line(rank, np.repeat(low, size), np.repeat(offsets[low], size), np.repeat(slope, size)))
            good = np.maximum.reduceat(missed, at) <= error
            fitted.append((low[good], offsets[low[good]], slope[good]))
            half = (low[~good] + high[~good]) // 2
            low, high = np.concatenate((low[~good], half)), np.concatenate((half, high[~good]))
        self.first, self.base, self.slope = (np.concatenate(c) for c in zip(*fitted)) if fitted else (self.first,) * 3
        order = np.argsort(self.first)
        self.first, self.base, self.slope = self.first[order], self.base[order], self.slope[order]
        self.residual = (offsets - self.predict(np.arange(len(offsets)))).astype(np.int8)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return line(ranks, self.first[segment], self.base[segment], self.slope[segment])

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def line(rank, first, base, slope):
    return base + ((rank - first) * slope >> FRACTION)


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token boundaries of each text, from 0 to its length, one text after the other, and where each text's begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    text_at = np.cumsum(sizes) - sizes
    begins[text_at[sizes > 0]] = True
    token_at = np.flatnonzero(begins)
    first = np.searchsorted(token_at, text_at)
    tokens = np.diff(np.append(first, len(token_at)))
    starts = np.concatenate(([0], np.cumsum(tokens + 1)))[:-1]
    offsets = np.empty(len(token_at) + len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), tokens)
    offsets[np.arange(len(token_at)) + owner] = token_at - text_at[owner]
    offsets[starts + tokens] = sizes
    return offsets, starts


def arranged(text: str, a: int, b: int, spm: bool) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def draws(salt: str) -> list[Column]:
    """Four integers of 32 bits for each row, from the digest of salt and ``doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, salt: str = "1") -> DataFrame:
    """Cuts each text at two token boundaries and moves the middle to the end.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row for each row: ``doc_id``, ``n``
    (tokens), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and ``middle_chars`` (NULL if plain) and
    ``output``. The draws depend on ``salt`` and ``doc_id`` only, so repeated rows come out alike; a NULL ``doc_id``
    draws like an empty one. A NULL text is empty. Empty texts and texts that hold one of the marks stay plain, so
    ``restored`` gives every text back. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                offsets, starts = boundaries(texts)
                n = np.diff(np.append(starts, len(offsets))) - 1
                index = RankIndex(offsets, starts)
                x, y = h1 % (n + 1), h2 % (n + 1)
                a, b = index.offset(starts + np.minimum(x, y)), index.offset(starts + np.maximum(x, y))
                marked = np.fromiter((any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts), bool, len(texts))
                plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
                spm = h4 % 100 < SPM_BELOW
                cuts = zip(texts, a.tolist(), b.tolist(), plain.tolist(), spm.tolist())
                output = [t if p else arranged(t, i, j, s) for t, i, j, p, s in cuts]
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(output, pa.string())],
                    ["doc_id", *(f.split()[0] for f in OUT.split(", "))],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *draws(salt))
    return rows.mapInArrow(run, f"doc_id long, {OUT}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
