"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausewright.llm.page_blocks import HINTS, Block, BlockParser
from clausewright.llm.page_samples import labelled_pages
from clausewright.llm.shingles import chunks

PAGES = 600  # labelled pages that the field is trained on
STEPS, RATE, SHRINK = 150, 0.2, 0.02

# Elements above a block that are features.
TAGS = "article main section div nav header footer aside form ul ol li table td p h1 h2 h3 blockquote pre figure label".split()
LENGTHS = (2, 5, 10, 20, 40, 80)  # words, borders of the groups


def feature_names() -> list[str]:
    return [
        *(f"in {t}" for t in TAGS), *(f"is {t}" for t in TAGS), *(f"hint {h}" for h in HINTS),
        *(f"words {k}" for k in range(len(LENGTHS) + 1)), *(f"linked {k}" for k in range(4)),
        "ends a sentence", "copyright sign", "first tenth", "last tenth", "no mark", "always",
    ]


class BlockFeatures:
    """Numbers of the features that a page's blocks have."""

    def __init__(self) -> None:
        self.number = {name: k for k, name in enumerate(feature_names())}
        self.above: dict[tuple, tuple[int, ...]] = {}

    def of_place(self, block: Block) -> tuple[int, ...]:
        key = (block.tag, block.path, block.hints)
        found = self.above.get(key)
        if found is None:
            get = self.number.get
            names = [*(f"in {t}" for t in block.path), f"is {block.tag}", *(f"hint {h}" for h in block.hints)]
            found = tuple(k for k in map(get, names) if k is not None)
            if not block.hints and not block.path & {"article", "main", "nav", "header", "footer", "aside", "form"}:
                found += (self.number["no mark"],)
            self.above[key] = found
        return found

    def of_text(self, block: Block, k: int, n: int) -> list[int]:
        number, text = self.number, block.text
        words = text.count(" ") + 1
        share = block.link / len(text) if block.link else 0.0
        out = [
            number[f"words {sum(words > b for b in LENGTHS)}"],
            number[f"linked {0 if not share else 1 if share < 0.3 else 2 if share < 0.7 else 3}"],
            number["always"],
        ]
        if text[-1] in ".!?…\"'”»":
            out.append(number["ends a sentence"])
        if "©" in text:
            out.append(number["copyright sign"])
        if k * 10 < n:
            out.append(number["first tenth"])
        if (n - 1 - k) * 10 < n:
            out.append(number["last tenth"])
        return out

    def __call__(self, blocks: list[Block]) -> list[list[int]]:
        n = len(blocks)
        return [[*self.of_place(b), *self.of_text(b, k, n)] for k, b in enumerate(blocks)]


def training_set(n: int = PAGES) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the blocks of labelled pages; a label is read off a mark that each piece's text carries."""
    parser, features, out = BlockParser(), BlockFeatures(), []
    for pieces in labelled_pages(n):
        page = "".join(piece if not label else mark_text(piece) for piece, label in pieces)
        blocks = parser(page)
        labels = [int("\u0001" in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\u0001", "") or "."
        if blocks:
            out.append((features(blocks), labels))
    return out


def mark_text(piece: str) -> str:
    """Puts a sign before each text of a piece, so that its blocks can be told after parsing."""
    import re

    return re.sub(r">([^<]+)", ">\u0001\\1", piece)


class Field:
    """Weights of features for each label, of neighbouring labels, and of the first label. 1 is main text."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start


def train(pages: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam on gradients from the forward-backward recursion."""
    n, longest, width = len(pages), max(len(y) for _, y in pages), len(feature_names())
    x, y, there = np.zeros((n, longest, width)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (rows, labels) in enumerate(pages):
        there[p, : len(labels)], y[p, : len(labels)] = True, labels
        for t, row in enumerate(rows):
            x[p, t, row] = 1
    two = np.eye(2)
    gold = two[y] * there[..., None]
    pairs = np.einsum("pti,ptj->ij", gold[:, :-1], gold[:, 1:])
    goal = np.concatenate((np.einsum("ptf,ptk->fk", x, gold).ravel(), pairs.ravel(), gold[:, 0].sum(0)))
    w, m, v = np.zeros_like(goal), np.zeros_like(goal), np.zeros_like(goal)
    for step in range(1, STEPS + 1):
        emit, move, start = w[: width * 2].reshape(width, 2), w[width * 2 : -2].reshape(2, 2), w[-2:]
        s = x @ emit
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = s[:, 0] + start
        for t in range(1, longest):
            new = np.logaddexp(fore[:, t - 1, 0, None] + move[0], fore[:, t - 1, 1, None] + move[1]) + s[:, t]
            fore[:, t] = np.where(there[:, t, None], new, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = s[:, t + 1] + back[:, t + 1]
            new = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
            back[:, t] = np.where(there[:, t + 1, None], new, back[:, t])
        whole = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        single = np.exp(fore + back - whole[:, None, None]) * there[..., None]
        joint = fore[:, :-1, :, None] + move + (s + back)[:, 1:, None, :] - whole[:, None, None, None]
        joint = np.exp(np.where(there[:, 1:, None, None], joint, -np.inf)).sum((0, 1))
        expected = np.concatenate((np.einsum("ptf,ptk->fk", x, single).ravel(), joint.ravel(), single[:, 0].sum(0)))
        grad = (expected - goal) / n + SHRINK * w / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w[: width * 2].reshape(width, 2), w[width * 2 : -2].reshape(2, 2), w[-2:])


def decode(field: Field, rows: list[list[int]]) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi); ties go to 0."""
    gain = (field.emit[:, 1] - field.emit[:, 0]).tolist()
    (m00, m01), (m10, m11) = field.move.tolist()
    zero, one = 0.0, 0.0
    back = []
    for t, row in enumerate(rows):
        e = sum([gain[k] for k in row])
        if t == 0:
            zero, one = float(field.start[0]), float(field.start[1]) + e
            continue
        from0, from1 = one + m10 > zero + m00, one + m11 > zero + m01
        back.append((from0, from1))
        zero, one = (one + m10 if from0 else zero + m00), (one + m11 if from1 else zero + m01) + e
    label = int(one > zero)
    out = [label]
    for from0, from1 in reversed(back):
        label = int(from1 if label else from0)
        out.append(label)
    return out[::-1]


def main_text(pages: DataFrame, field: Field) -> DataFrame:
    """Main text of each whole page.

    ``pages`` needs ``html``. Returns its other columns and ``text``: the blocks that the field labels as main text, in
    page order, each with its white space turned into single blanks, joined by line feeds; ``n_blocks`` and ``n_kept``.
    Columns of these names are replaced. NULL and pages without text give an empty string. Pages may be cut off
    anywhere; unclosed elements end with what surrounds them.
    """
    own = ("text", "n_blocks", "n_kept")
    sent = pages.sparkSession.sparkContext.broadcast((field.emit, field.move, field.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, parser, features = Field(*sent.value), BlockParser(), BlockFeatures()
        for batch in batches:
            at = 0
            for group in chunks(batch.column(batch.schema.get_field_index("html")).to_pylist()):
                texts, total, kept = [], [], []
                for page in group:
                    blocks = parser(page) if page else []
                    labels = decode(field, features(blocks)) if blocks else []
                    texts.append("\n".join(b.text for b, k in zip(blocks, labels) if k))
                    total.append(len(blocks))
                    kept.append(sum(labels))
                part = batch.slice(at, len(group))
                keep = [i for i, f in enumerate(batch.schema) if f.name != "html"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())],
                    [*[batch.schema.names[i] for i in keep], *own],
                )
                at += len(group)

    given = pages.drop(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "html")
    return given.mapInArrow(run, f"{schema + ', ' if schema else ''}text string, n_blocks int, n_kept int")


