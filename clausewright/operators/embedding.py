"""Embedders: a built-in hashing one, and an adapter for a caller's own model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.arrays import list_slices
from clausewright.functions.text import tokenise

BATCH = 32
MODEL_NAME = "all-MiniLM-L6-v2"


def signed_counts(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """A row of signed counts for each list of tokens."""
    return np.concatenate([np.zeros((0, dimensions)), *(_signed(part, dimensions) for part in list_slices(tokens))])


def _signed(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """The same for a part of a batch; a checksum is taken once for each distinct token."""
    coded = tokens.flatten().dictionary_encode()
    crc = np.array([zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()], dtype=np.int64)
    place, sign = crc % dimensions, np.where(crc & 0x8000, 1, -1)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    token = coded.indices.to_numpy()
    sums = np.bincount(row * dimensions + place[token], sign[token], len(tokens) * dimensions)
    return sums.reshape(len(tokens), dimensions)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()).cast(kind))


def _tokens(text: Column) -> Column:
    return tokenise(F.coalesce(text, F.lit("")))


def hashed_counts(text: Column, dimensions: int) -> Column:
    """Signed counts of a text's tokens, each in the dimension that its checksum names."""

    @F.arrow_udf("array<int>")
    def counts(tokens: pa.Array) -> pa.Array:
        return _lists(signed_counts(tokens, dimensions), pa.int32())

    return counts(_tokens(text))


def hashing_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """Unit vectors of hashed token counts, made in Arrow batches. Needs no model; meant for tests and trials."""

    def embed(text: Column) -> Column:
        @F.arrow_udf("array<float>")
        def unit(tokens: pa.Array) -> pa.Array:
            counts = signed_counts(tokens, dimensions)
            norm = np.sqrt((counts**2).sum(1, keepdims=True))
            return _lists((counts / np.where(norm > 0, norm, 1.0)).astype(np.float32), pa.float32())

        return unit(_tokens(text))

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Callable[[Column], Column]:
    """Embeds in batches of 32 with a model loaded once per task; ``load`` gives its encode function."""

    def default_load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(MODEL_NAME)
        return lambda texts: model.encode(texts, batch_size=BATCH, normalize_embeddings=True, show_progress_bar=False)

    make = load or default_load

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            rows: list = []
            for start in range(0, len(texts), BATCH):
                part = np.asarray(encode(texts.iloc[start : start + BATCH].tolist()), dtype=np.float64)
                norms = np.linalg.norm(part, axis=1, keepdims=True)
                rows.extend((part / np.where(norms > 0, norms, 1.0)).astype(np.float32).tolist())
            yield pd.Series(rows)

    return embed


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]] | None = None):
    """Pair scorer for reranking, loaded once per task; a missing model scores NULL, which keeps the fused order."""

    def default_load():
        from sentence_transformers import CrossEncoder

        return CrossEncoder("cross-encoder/ms-marco-MiniLM-L-6-v2", max_length=512).predict

    make = load or default_load

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            predict = make()
        except Exception:  # an unavailable model is not an error of the query
            predict = None
        for queries, texts in batches:
            try:
                scores = [None] * len(texts) if predict is None else list(map(float, predict(list(zip(queries, texts)))))
            except Exception:
                scores = [None] * len(texts)
            yield pd.Series(scores, dtype="float64")

    return score
