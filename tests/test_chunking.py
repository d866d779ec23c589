"""Chunking against a plain-Python restatement of its rules."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.functions.arrays import PAGE
from clausewright.operators import chunking

HEADINGS = [
    re.compile(p, flags)
    for p, flags in (
        (r"^\d+[A-Z]?\.?—?\s*\(\d+\)", re.M),
        (r"^CLASS\s+\d+[A-Z]?", re.M | re.I),
        (r"^Article\s+\d+[A-Z]?", re.M | re.I),
        (r"^\d+\.\s+[A-Z][a-zA-Z\s]+:?$", re.M),
    )
]


def expected_segments(text):
    for rule in HEADINGS:
        cuts = [m.start() for m in rule.finditer(text)]
        if len(cuts) > 2:
            ends = [c + 100 for c in cuts[1:]] + [len(text)]
            return [text[a:b] for a, b in zip(cuts, ends)]
    return [p for p in map(str.strip, re.split("\n\n+", text)) if p]


def expected_pack(items, fits, glue):
    out, held = [], ""
    for item in items:
        if fits(held, item):
            held = glue(held, item)
            continue
        out.append(held)
        held = item
    return [piece for piece in [*out, held] if piece]


def expected_chunks(text):
    merged = expected_pack(expected_segments(text), lambda a, b: len(a + b) < 150, lambda a, b: a + "\n\n" + b)
    sized = []
    for piece in merged:
        if len(piece) > 2000:
            sized += expected_pack(
                re.split("\n\n+", piece), lambda a, b: len(a + b) <= 2000, lambda a, b: f"{a}\n\n{b}" if a else b
            )
        else:
            sized.append(piece)
    return [(i, p.strip()) for i, p in enumerate(sized) if len(p.strip()) >= 150]


def actual_chunks(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, raw_text string")
    got = {i: [] for i in range(len(texts))}
    for r in chunking.chunk_texts(docs).collect():
        got[r.doc].append((r.chunk_index, r.text))
    return [sorted(got[i]) for i in range(len(texts))]


def filler(n, seed=0):
    rng = random.Random(seed)
    words = ("wall", "road", "height", "metres", "porch", "site")
    return " ".join(rng.choice(words) for _ in range(n))


SAMPLE = "Preamble text that is lost.\n" + "\n".join(
    f"CLASS {i} — Heading {i}\n\n{filler(60, i)} not exceeding 40 square metres." for i in (1, 2, 3)
)


def test_sample_text(spark):
    (chunks,) = actual_chunks(spark, [SAMPLE])
    assert [i for i, _ in chunks] == [0, 1, 2]
    assert all(150 <= len(t) <= 2200 for _, t in chunks)
    assert not any("Preamble" in t for _, t in chunks)
    assert any("40" in t and "metres" in t for _, t in chunks)
    assert "CLASS 2" in chunks[0][1]


EDGES = {
    "empty": "",
    "two headings only": f"CLASS 1 {filler(40)}\nCLASS 2 {filler(40)}",
    "short then long": f"CLASS 1 a\nCLASS 2 b\nCLASS 3 {filler(60)}",
    "two short first": f"tiny\n\nsmall\n\n{filler(60)}",
    "next shorter than overlap": f"CLASS 1 {filler(40)}\nCLASS 2 x\nCLASS 3 y\nCLASS 4 {filler(50)}",
    "huge paragraph": filler(900),
    "exactly 2000": "CLASS 1 " + "a" * 992 + "\n\n" + "b" * 1000 + "\nCLASS 2 c\nCLASS 3 d",
    "starts with heading": f"Article 1 {filler(40)}\nARTICLE 2 {filler(40)}\narticle 3A {filler(40)}",
    "numbered headings": "".join(f"{i}. Design Standards:\n{filler(50, i)}\n" for i in range(1, 5)),
    "act sections": "".join(f"{i}A.—({i}) {filler(50, i)}\n" for i in range(1, 5)),
    "carriage returns": f"CLASS 1 {filler(40)}\r\nCLASS 2 {filler(40)}\rCLASS 3 {filler(40)}\nCLASS 4 {filler(40)}\nCLASS 5 x",
    "unicode space": f"CLASS 1 {filler(40)}\nCLASS 2 {filler(40)}\nCLASS 3 {filler(40)}",
}


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, name):
    assert actual_chunks(spark, [EDGES[name]])[0] == expected_chunks(EDGES[name])


def test_many_segments_cross_a_page(spark):
    text = "\n\n".join(filler(30, i) for i in range(3 * PAGE + 5))
    assert actual_chunks(spark, [text])[0] == expected_chunks(text)
    assert len(expected_chunks(text)) > 2 * PAGE


def test_very_many_headings_stay_affordable(spark):
    text = "\n".join(f"CLASS {i} {filler(i % 7 + 1, i)}" for i in range(40_000))
    start = time.monotonic()
    assert actual_chunks(spark, [text])[0] == expected_chunks(text)
    assert time.monotonic() - start < 60


piece = st.one_of(
    st.sampled_from(["\n", "\n\n", "\n\n\n", " ", "CLASS 1 ", "Class 2A", "Article 3 ", "4.—(1) ", "12(3)", "5. Site Rules:", "\r\n"]),
    st.integers(1, 60).map(lambda n: filler(n, n)),
    st.integers(300, 420).map(lambda n: filler(n, n)),
    st.text(alphabet="aé Ü—.:(1)\n", max_size=12),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(piece, max_size=40).map("".join), min_size=25, max_size=40))
def test_random_texts(spark, texts):
    assert actual_chunks(spark, texts) == [expected_chunks(t) for t in texts]


def labels(spark, text, si):
    df = spark.createDataFrame([(text, si)], "t string, si string")
    return df.select(
        chunking.section_reference(F.col("t"), F.col("si")).alias("ref"), chunking.summary_line(F.col("t")).alias("s")
    ).first()


def test_section_reference(spark):
    assert labels(spark, "CLASS 1 then class 2 then class 3", "S.I. No. 1 of 2000").ref == "S.I. No. 1 of 2000 | CLASS 1 | class 2"
    assert labels(spark, "Section 5(2) and S.I. No. 1 of 2000", "S.I. No. 1 of 2000").ref == "Section 5(2) | Section 5 | S.I. No. 1 of 2000"
    assert labels(spark, "nothing here", "").ref == ""
    many = "Class 1 class 1 section 2 (1) article 4 S.I. No. 1 of 2000"
    assert labels(spark, many, "").ref == "Class 1 | class 1 | section 2 (1) | section 2"


def test_summary(spark):
    assert labels(spark, "short\n  a line that is long enough  \nmore", "").s == "a line that is long enough"
    assert labels(spark, "x" * 130, "").s == "x" * 120 + "..."
    assert labels(spark, "x" * 120, "").s == "x" * 120
    assert labels(spark, "a\nb\nc", "").s == "a\nb\nc"


def test_records_are_stable_and_stamped(spark):
    from clausewright.sources.registry import registry

    source = registry(spark).where("id = 'schedule2_part1_seed'")
    raw = source.select(F.struct("*").alias("metadata"), F.lit(SAMPLE).alias("raw_text"))
    first, again = (chunking.chunk_documents(raw, "2024-02-01").orderBy("chunk_index").collect() for _ in range(2))
    assert [r.chunk_id for r in first] == [r.chunk_id for r in again] and len({r.chunk_id for r in first}) == 3
    assert {r.source_doc_id for r in first} == {"schedule2_part1_seed"}
    assert {(r.document_type, r.jurisdiction, r.si_number, r.act_year) for r in first} == {
        ("exemption_schedule", "national", "S.I. No. 600 of 2001", 2001)
    }
    assert all(0 < len(r.summary) <= 123 for r in first)
    assert first[0].section_ref == "S.I. No. 600 of 2001 | CLASS 1 | CLASS 2"
