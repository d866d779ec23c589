"""Chat formatting: conversations rendered under a template, token offsets, and a loss mask aligned with them.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text
can pass for a mark and the conversation can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # must be there on every node
BATCH_CHARS = 1 << 20

FORMATTED = "conv_id long, n_turns long, formatted string, token_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("<\\|", "<|") for p in parts)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and where the assistant's texts are in it."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        pieces += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(pieces), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(START).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with one of the sorted spans, by binary search in the spans' ends."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    k = np.searchsorted(last, starts, "right")  # the first span that ends after the token's start
    return (k < len(first)) & (first[np.minimum(k, len(first) - 1)] < ends) & (ends > starts)


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Renders, encodes and masks whole conversations.

    ``rows`` needs ``conv_id, turn, role, text``; other columns are ignored. Returns one row for each ``conv_id``:
    the formatted text, token ids, each token's first and last-plus-one code point, and the loss mask, which is true for
    tokens of assistant texts. Turns come by ``turn``, NULL first, equal ones by role and text; repeated rows stay. NULL
    roles and texts are empty; rows with a NULL ``conv_id`` are one conversation. Rows are sorted by conversation and
    streamed, so a task holds the turns of one conversation (or of a batch of short ones) at a time. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        encoder = Tokenizer.from_file(tokenizer)
        encoder.add_special_tokens([START, SEP, END])
        encoder.post_processor = processors.ByteLevel(trim_offsets=False)  # blanks belong to their tokens

        def encoded(group: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            texts, spans = zip(*(render(turns) for _, turns in group))
            ids, starts, ends, loss, sizes = [], [], [], [], [0]
            for e, own in zip(encoder.encode_batch(list(texts), add_special_tokens=False), spans):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                ids.append(np.array(e.ids, np.int32))
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                loss.append(mask(offsets[:, 0], offsets[:, 1], own))
                sizes.append(sizes[-1] + len(offsets))
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, starts, ends, loss)]
            names = [f.split()[0] for f in FORMATTED.split(", ")]
            first = [pa.array([c for c, _ in group], pa.int64()), pa.array([len(t) for _, t in group], pa.int64()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*first, *lists], names)

        waiting: list[tuple[int | None, list[tuple[str, str]]]] = []
        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not waiting or waiting[-1][0] != conv:
                    if size > BATCH_CHARS:
                        yield encoded(waiting)
                        waiting, size = [], 0
                    waiting.append((conv, []))
                waiting[-1][1].append((role, text))
                size += len(text)
        if waiting:
            yield encoded(waiting)

    empty = F.lit("")
    plain = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations say and of what their loss masks cover, read from the output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                conv, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                starts, ends, loss = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                turns = read_turns(text)
                whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                # Tokens may share a character; the pieces between them are put together before they are unescaped.
                a, b = starts[loss], ends[loss]
                reach = np.maximum.accumulate(np.concatenate(([0], b)))[:-1]
                pieces = [text[max(x, r) : y] for x, y, r in zip(a.tolist(), b.tolist(), reach.tolist())]
                masked = unescape("".join(pieces))
                out.append((conv, len(turns), whole, len(masked), sha256(masked.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(starts), int(loss.sum())))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_tokens loss_tokens".split()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return formatted.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long",
    )
