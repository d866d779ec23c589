"""Repeated rows, shared ids and labels beyond small numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import langid, neardup
from clausewright.llm.queries import remainder
from conftest import SMALL
from test_text_operators import plain_viterbi


def edited(k, n=12):
    rng = np.random.default_rng(3)
    words = [f"w{rng.integers(1_000_000)}" for _ in range(200)]
    for i in range(k * 30, k * 30 + n):
        words[i % 200] = f"e{k}-{i}"
    return " ".join(words)


def test_a_thousand_repeats_cost_no_more_than_one(spark, monkeypatch):
    """Three documents that share buckets without being one group, two of them repeated."""
    seen, split = [], neardup.in_blocks

    def spy(active, extra):
        rows = split(active, extra)
        seen.append(rows.count())
        return rows

    monkeypatch.setattr(neardup, "in_blocks", spy)
    rows = [(k, edited(k)) for k in range(3)]
    for repeats in (1, 1000):
        df = spark.createDataFrame(rows[:1] + rows[1:] * repeats, "doc_id long, text string")
        assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == {(k, 196, k, True) for k in range(3)}
    assert seen[: len(seen) // 2] == seen[len(seen) // 2 :]


def test_near_dedup_stage_by_rows(spark):
    copy, other = edited(0), "a text about something else " * 4
    rows = [(None, copy, "a"), (None, copy, "a"), (1, copy, "b"), (2, copy + " more", "b"), (2, other, "b"), (3, "x y z", None), (3, "x y z", None), (4, None, "c"), (4, None, "c")]
    for extra in ([], [(9, "unrelated words", "d")] * 2):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string, digest string")
        got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, df, SMALL).collect()), key=str)
        assert got == sorted(rows[:3] + [rows[4], rows[5], rows[7]] + extra[:1], key=str)


@pytest.mark.parametrize("k", [129, 300])
def test_many_labels(k):
    rng = np.random.default_rng(k)
    scores, change = rng.normal(size=(40, k)), np.full(40, 1.5)
    assert list(langid.viterbi(scores, change)) == plain_viterbi(scores, change)


def test_only_letters_tell_and_only_known_scripts(spark):
    known = [("en", "the house and the garden are with the water " * 3), ("de", "das haus und der garten sind mit dem wasser " * 3)]
    model = langid.fit(spark.createDataFrame(known, "lang string, text string"))
    rows = [(1, "½ ² ①"), (2, "漢字 漢字"), (3, "the garden 漢字漢字漢字漢字漢字"), (4, "the½garden and²the house"), (5, "the garden and the house " * 50_000)] * 2
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].explained) == ("und", 0.0, 0.0)
    assert (got[2].score, got[2].explained) == (0.0, 0.0) and got[2].lang_pred in ("en", "de")
    assert got[3].score < 0.5 and (got[4].lang_pred, got[4].score) == ("en", 1.0) == (got[5].lang_pred, got[5].score)
    mixed = "the house and the garden are with the water das haus und der garten sind mit dem wasser "
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*(t for _, t in known), mixed, "漢字 漢字", "½", None])], "doc_id long, text string")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "de"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SMALL).collect()} == {0, 1, 2}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(docs.where(remainder(5) != 0))
    held = langid.identify(docs.where(remainder(5) == 0).where("lang IS NOT NULL"), model)
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
