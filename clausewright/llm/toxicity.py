"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import chunks
from clausewright.operators.sizing import materialise

POSITIVES, UNLABELLED = 4_000, 12_000  # documents that the classifier is fitted on, about
PRIOR = 0.1  # share of toxic documents, where no labelled row tells it
FEATURES = 2_048  # of words and their beginnings, at most: the most telling ones
LEAST_DOCS, LEAST_Z = 5, 4.0  # toxic examples that must have a feature, and how far above chance
STEMS = (4, 5, 6)
STEPS, RATE, SHRINK = 400, 0.1, 1e-3
REMEMBERED = 1_000_000


class Features:
    """Hashed features of a word: itself and its first letters."""

    def __init__(self) -> None:
        import re
        from zlib import crc32

        self.find, self.crc = re.compile(r"[^\W_]+").findall, crc32

    def words(self, text: str) -> set[str]:
        return set(self.find(text.lower()))

    def of(self, word: str) -> list[int]:
        return [self.crc(word.encode()), *[self.crc(b"^" + word[:n].encode()) for n in STEMS if len(word) > n]]


def document_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and unlabelled texts each feature occurs: ``feature, p, u``. ``sample``: ``text, positive``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        forms, seen = Features(), (Counter(), Counter())
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[positive].update({f for w in forms.words(text) for f in forms.of(w)})
        items = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array([seen[1][f] for f in items], pa.int64()), pa.array([seen[0][f] for f in items], pa.int64())],
            ["feature", "p", "u"],
        )

    rows = sample.select("text", "positive").mapInArrow(run, "feature long, p long, u long")
    return rows.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def design(sample: DataFrame, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the chosen features in each sampled text (distinct words that have one), and which texts are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, index = Features(), {f: k for k, f in enumerate(chosen)}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [[index[f] for w in forms.words(t) for f in forms.of(w) if f in index] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "positive"])

    rows = sample.select("text", "positive").mapInArrow(run, "found array<int>, positive boolean").toPandas()
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, found in enumerate(rows["found"]):
        np.add.at(x[k], np.asarray(found, np.int64), 1)
    return x, rows["positive"].to_numpy(bool)


def fit_weights(x: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of a logistic loss, by full-batch Adam.

    The risk is ``prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])``. Where the second part falls below zero,
    the step goes against its gradient, so the classifier cannot win by overfitting the toxic examples.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w, b = np.zeros(x.shape[1] + 1), None
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        z = np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30).astype(float)
        p = 1 / (1 + np.exp(-z))
        loss = np.log1p(np.exp(z))  # of calling a text not toxic
        rest = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        if rest >= 0:
            g = np.where(positive, -prior * (1 - p) / n_p - prior * p / n_p, p / n_u)
        else:
            g = np.where(positive, prior * p / n_p, -p / n_u)
        grad = np.concatenate((g.astype(x.dtype) @ x, [g.sum()])) + SHRINK * np.append(w[:-1], 0) / len(z) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    b = w[-1]
    return w[:-1], float(b)


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from ``labels`` (``doc_id, toxic``; only 1 marks an example) and from the texts of ``docs`` (``doc_id, text``).

    About ``POSITIVES`` toxic and ``UNLABELLED`` other documents are used, picked by a hash of the id, so what is sent
    to the driver and to the tasks is bounded. The class prior is the share of 1 among the labelled ids, ``PRIOR`` if
    there is none. Without a toxic example the score is the prior everywhere. NULL texts and labels are left out; an id
    with several labels is toxic if one of them is 1. The unlabelled texts may hold toxic ones, also the examples.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    n, n_p = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    prior = min(0.95, max(0.001, n_p / n)) if n_p else PRIOR
    plain = docs.where("text IS NOT NULL").select("doc_id", "text")
    n_u = plain.count()

    def pick(df: DataFrame, most: int, there: int) -> DataFrame:
        share = int(1_000_000 * min(1.0, most / max(1, there)))
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    ids = pick(marked.where("toxic").select("doc_id"), POSITIVES, n_p)
    toxic = plain.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    others = pick(plain, UNLABELLED, n_u).withColumn("positive", F.lit(False))
    sample = materialise(toxic.unionByName(others).select("text", "positive").distinct())  # copies count once
    counts = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = counts.get(True, 0), max(1, counts.get(False, 0))
    if not n_p:
        return Model({}, float(np.log(prior / (1 - prior))))
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = document_counts(sample).where(F.col("p") >= min(LEAST_DOCS, n_p)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    chosen = [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    x, positive = design(sample, chosen)
    weights, bias = fit_weights(x, positive, prior)
    return Model(dict(zip(chosen, map(float, weights))), bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on, else 0) to a table with ``text``.

    Columns of these names are replaced. NULL, empty texts and texts without a known feature get the score of the bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import fsum

        weights, bias = sent.value
        forms, known = Features(), {}
        for batch in batches:
            at = 0
            for group in chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                out = []
                for text in group:
                    told = [bias]
                    for word in forms.words(text) if text else ():
                        value = known.get(word)
                        if value is None:
                            if len(known) > REMEMBERED:
                                known.clear()
                            value = known[word] = sum(weights.get(f, 0.0) for f in forms.of(word))
                        if value:
                            told.append(value)
                    out.append(fsum(told))  # the same in whatever order a set gives its words
                result = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
                part = batch.slice(at, len(group))
                keep = [i for i, f in enumerate(batch.schema) if f.name not in ("score", "predicted")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array(result), pa.array((result >= threshold).astype(np.int32))],
                    [*[batch.schema.names[i] for i in keep], "score", "predicted"],
                )
                at += len(group)

    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, score double, predicted int")
