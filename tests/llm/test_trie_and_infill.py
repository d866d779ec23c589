"""The prefix trie against plain dictionaries, fill-in-middle against plain cuts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import infill, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, n_turns string, a long"


def plain_trie(conversations):
    """``conv_id -> turns`` to the rows of the trie."""
    members, ends = defaultdict(set), defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
        ends[tuple(turns)].append(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = own + sum(saved[k] for k in below)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items()
    )


def rows_of(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def table(spark, conversations):
    rows = [(c, k, role, text, "x", 0) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS).repartition(4)


def trie(df):
    return prefix_trie.prefix_trie(*prefix_trie.turns_and_lengths(df))


def random_conversations(seed, n, depth, choices):
    rng = np.random.default_rng(seed)
    turn = lambda: (["user", "assistant"][rng.integers(2)], "w " * int(rng.integers(choices)))
    return {int(c): [turn() for _ in range(rng.integers(1, depth))] for c in rng.choice(10 * n, n, replace=False) - 5 * n}


@pytest.mark.parametrize("seed,n,depth,choices", [(1, 60, 6, 2), (3, 25, 40, 1)])
def test_trie_equals_plain_dictionaries(spark, seed, n, depth, choices):
    conversations = random_conversations(seed, n, depth, choices)
    assert rows_of(trie(table(spark, conversations))) == plain_trie(conversations)


def test_one_deep_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 2)
    monkeypatch.setattr(prefix_trie, "BUSY", 3)
    deep = [("user", str(k % 3)) for k in range(100)]
    conversations = {0: deep, 1: deep, 2: deep[:60] + [("user", "off")]} | {k: deep[:2] for k in range(3, 40)}
    conversations |= {k: [("user", f"own {k}")] for k in range(40, 60)}
    assert rows_of(trie(table(spark, conversations))) == plain_trie(conversations)


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 2, "u", "b"), (1, 2, "u", "a"), (1, 2, "u", "a"), (2, 0, "", ""), (None, 1, "u", "lost"), (3, 1, "u", "x " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], TURNS)
    want = {1: [("", ""), ("u", "a"), ("u", "a"), ("u", "b")], 2: [("", "")], 3: [("u", "x " * 50_000)]}
    assert rows_of(trie(df)) == plain_trie(want)
    assert trie(df.limit(0)).isEmpty()


def test_shared_heads(spark):
    given = {c: [("u", f"{c // 20} {k}") for k in range(c % 6 + 1)] for c in [*range(0, 45), *range(66, 80, 6), -7]}
    head = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    want = {c: given.get(base(c), [])[: head(c)] + turns[head(c) :] for c, turns in given.items()}
    assert any(not t for t in want.values())
    conv = F.col("conv_id")
    parts = prefix_trie.with_shared_heads(table(spark, given), F.crc32(conv.cast("string")) % 4, conv - conv % 20)
    assert rows_of(prefix_trie.prefix_trie(*parts)) == plain_trie(want)


def plain_cut(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cuts(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abZ é\n😀<P"), int(n))) for n in rng.integers(0, 80, 120)]
    texts += [None, "", "a", "x<P>y", "<S", "<", "b" * 200_000, "a b\n" * 100_000, "a" * 90_000 + "." * 9_000 + "a" * 90_000]
    rows = [(k, t, "x", 5) for k, t in enumerate(texts)] + [(None, "one two", "x", 5)] * 2 + [(3, texts[3], "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 int")
    out = infill.fill_in_middle(df).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.again, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out.collect()]
    want = [(k, t or "", plain_cut(k, t or "")) for k, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).isEmpty()


@pytest.mark.parametrize("error", [0, 5, 127])
def test_rank_index_keeps_its_error_and_is_exact(error):
    rng = np.random.default_rng(9)
    steps = np.where(rng.random(20_000) < 0.001, 5_000, rng.integers(1, 9, 20_000))
    offsets = np.concatenate((np.cumsum(steps[:15_000]), [0], np.cumsum(steps[15_000:]), [0]))
    starts = np.array([0, 15_000, 20_001])
    index = infill.RankIndex(offsets, starts, error)
    ranks = np.arange(len(offsets))
    assert np.abs(offsets - index.predict(ranks)).max() <= error
    assert (index.offset(ranks) == offsets).all() and len(index.first) < len(offsets)
    assert set(starts) <= set(index.first)
