import random

import numpy as np
import pytest

from clausewright.llm.components import components
from clausewright.llm.neardup import BLOCK, in_blocks, near_duplicates, remaining_links
from clausewright.llm.shingles import Shingler


@pytest.fixture
def docs(spark):
    return lambda *rows, columns="doc_id long, text string": spark.createDataFrame(list(rows), columns)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_sets_match_plain_shingles():
    texts = [None, "", " \t\n", "One", "one two THREE", "a b c d e f a b c d", "ÀB c\x0bd e é" * 3]
    hashes, begins = Shingler(4).sets(texts)
    assert list(np.diff(begins)) == [len(shingles(t, 4)) for t in texts]
    same, _ = Shingler(4).sets(["A b  c d e f A B C D"])
    assert set(same) == set(hashes[begins[5] : begins[6]])


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([1, 3, 5, 12, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"x{rng.randint(0, 9)}" for w in base]
            rows.append((len(rows) * 7 % 1009, " ".join(copy).title() if rng.random() < 0.3 else "  ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(*rows), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_null_ids_repeats_and_clashing_columns(spark, docs):
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 2), (5, "a b c d e", 3), (5, "a b c d e", 4), (9, "A B c d e", 5)]
    out = near_duplicates(docs(*rows, columns="doc_id long, text string, kept int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [
        (-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False),
    ]


def test_empty_table(spark, docs):
    out = near_duplicates(docs())
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.isEmpty()


def test_links_where_low_bytes_agree_in_an_earlier_band(spark):
    sketch = bytes(range(256))
    bands = [[1000 * i + k for k in range(42)] for i in (1, 2)]
    bands[1][3:9] = bands[0][3:9]  # bins differ in bands 0 to 2, low bytes nowhere
    active = spark.createDataFrame(
        [(bands[0][k], i, 5, k, i) for k in range(3, 9) for i in (1, 2)], "bucket long, id long, n long, band int, component long"
    )
    sketches = spark.createDataFrame([(i, sketch, b) for i, b in enumerate(bands, 1)], "id long, sketch binary, bands array<long>")
    whole = spark.createDataFrame([(i, [1, 2, 3, 4, 5]) for i in (1, 2)], "doc_id long, shingles array<long>")
    assert [(r.a, r.b) for r in remaining_links(active, sketches, whole, 80).collect()] == [(1, 2)]


def test_blocks_of_one_component_meet_the_others_only(spark):
    m = 8 * BLOCK
    active = spark.range(m + 2).selectExpr("7L bucket", "id", "5L n", "0 band", f"IF(id < {m}, 0L, id) component")
    rows = in_blocks(active, active.select("id")).select("id", "block", "i", "j").toPandas()
    assert len(rows) == m + 2 * 9
    place = rows.groupby(["i", "j"]).id.agg(set)
    assert set().union(*(s for s in place if m in s)) == set(range(m + 2))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 100), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
