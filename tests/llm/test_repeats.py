"""Repeated byte strings against a count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from clausewright.llm import queries, repeats
from conftest import SMALL


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return out


def found(df, length):
    rows = repeats.repeated_spans(df, length).collect()
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows}


def words(rng, n):
    return "".join(rng.choice(list("abcdefgh "), n))


@pytest.fixture(scope="module")
def passages():
    """Cuts of one text in other contexts, copies, near copies, runs and periods."""
    rng = np.random.default_rng(4)
    base = words(rng, 2000)
    cut = [words(rng, rng.integers(0, 300)) + base[a : a + n] + words(rng, rng.integers(0, 300)) for a, n in rng.integers((0, 100), (1500, 400), (40, 2))]
    return [*cut, base[300:700], base[300:700], base[300:500] + "ü" + base[500:700], "z" * 500, "z" * 130 + "y", "pq" * 300, "é" * 200, None, "", "short"]


@pytest.mark.parametrize("group", [4096, 2])
@pytest.mark.parametrize("length", [9, 120])
def test_spans_equal_a_count_of_all_windows(spark, passages, monkeypatch, group, length):
    monkeypatch.setattr(repeats, "GROUP", group)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(passages)], "doc_id long, text string, kept string, k1 int").repartition(3)
    assert found(df, length) == dict(enumerate(brute(passages, length)))


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BITS", 9)
    rng = np.random.default_rng(5)
    one = words(rng, 4000)
    texts = [one[:3500] + "end", "start" + one[1000:], "a" * 2500, "b" + "a" * 700, one[2000:2100], words(rng, 600)]
    # The piece size is a constant of the module that tasks import, so the pieces are tested where they are cut.
    windows = repeats.Windows(120)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        covered = []
        for a, b in repeats.pieces(np.array([0, len(data)]), 119):
            start, n, anchor, h, s = windows.runs(data[a:b], np.array([b - a]))
            covered += [w for x, k in zip(start + a, n) for w in range(x, x + k)]
            assert ((anchor >= 0) & (anchor < 120)).all()
        assert sorted(set(covered)) == list(range(max(len(data) - 119, 0)))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = words(np.random.default_rng(6), 300)
    rows = [(1, text), (1, text), (None, text + "!"), (None, None), (2, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.repeated_spans(df, 100).collect()), key=str)
    gone = (1, 300, [(0, 300)], b"")
    assert got == sorted([gone, gone, (0, 301, [(0, 300)], b"!"), (0, 0, [], b""), (2, 5, [], b"other")], key=str)
    assert repeats.repeated_spans(df.limit(0)).isEmpty()


def test_many_repeated_rows_and_a_busy_string(spark):
    rng = np.random.default_rng(7)
    common = words(rng, 150)
    texts = [common] * 60 + [words(rng, 20) + common + words(rng, 20) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df, 120) == dict(enumerate(brute(texts, 120)))


def test_query_over_the_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(rows, brute(rows.values(), 400)))
    got = queries.op12_suffix_array_dedup(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert any(r.n_removed for r in got)
