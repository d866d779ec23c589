"""Steps that got longer, or took more memory in one task, faster than their input grew."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright.functions import arrays
from clausewright.operators import embedding, generation, impacts, index, search
from clausewright.operators.sizing import spread
from clausewright.sources import extract
from conftest import SMALL

TEXTS = ["a b a c.d", "", None, "É İx 7.5 7.5 z", "b " * 50]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _words(text):
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", (text or "").lower())


def test_texts_are_embedded_and_counted_in_batches(spark, monkeypatch):
    monkeypatch.setattr(arrays, "SLICE_ITEMS", 4)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")
    counts = df.select("chunk_id", embedding.hashed_counts(F.col("text"), 16).alias("c"))
    for plan in (_plan(counts), _plan(index.build_documents(df)), _plan(df.select(embedding.hashing_embedder(16)(F.col("text"))))):
        assert "ArrowEvalPython" in plan and "lambda" not in plan
    for row, text in zip(counts.orderBy("chunk_id").collect(), TEXTS):
        expected = [0] * 16
        for word in _words(text):
            code = zlib.crc32(word.encode())
            expected[code % 16] += 1 if code & 0x8000 else -1
        assert row.c == expected
    for row, text in zip(index.build_documents(df).orderBy("chunk_id").collect(), TEXTS):
        if text is None:
            assert row.dl is None and row.terms is None
        else:
            assert row.dl == len(_words(text))
            assert [(t.term, t.tf) for t in row.terms] == sorted(Counter(_words(text)).items())


def test_lists_are_sliced_by_their_items(monkeypatch):
    monkeypatch.setattr(arrays, "SLICE_ITEMS", 4)
    lists = pa.array([["a"] * 3, [], None, ["b"], ["c"] * 9, ["d"]])
    parts = list(arrays.list_slices(lists))
    assert [len(p) for p in parts] == [4, 1, 1] and pa.concat_arrays(parts).equals(lists)


def test_a_group_is_packed_without_python_objects():
    """Its terms come in order, with the chunks that have them."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    terms = [[{"term": "b", "tf": 2}, {"term": "é", "tf": 1}], [], [{"term": "a", "tf": 3}, {"term": "b", "tf": 5}]]
    table = pa.table({"chunk_id": ["x", "y", "z"], "dl": pa.array([3, 0, 8], pa.int32()), "terms": pa.array(terms, kind)})
    [row] = impacts.packed_group(table.slice(0)).to_pylist()
    assert row == {
        "n": 3, "words": ["a", "b", "é"], "most": [3, 5, 1], "least": [8, 3, 3], "ids": ["x", "y", "z"], "lengths": [3, 0, 8],
        "begins": [0, 1, 3, 4], "places": [2, 0, 2, 0], "counts": [3, 2, 5, 1],
    }


def _term_lists(sizes):
    """One chunk for each size, with so many terms; every third term is in all of them."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    terms = [[{"term": f"w{k:04d}" if k % 3 == 0 else f"w{k:04d}c{i}", "tf": 1 + (i + k) % 300} for k in range(n)] for i, n in enumerate(sizes)]
    return pa.table({"chunk_id": [f"c{i:03d}" for i in range(len(sizes))], "dl": pa.array(sizes, pa.int32()), "terms": pa.array(terms, kind)})


def test_groups_of_long_chunks_have_fewer_of_them(monkeypatch):
    """However the chunks come, and with the numbers of the plain lists, which are kept as bytes."""
    monkeypatch.setattr(impacts, "GROUP_ROWS", 4)
    monkeypatch.setattr(impacts, "GROUP_TERMS", 30)
    table = _term_lists([0, 1, 2, 3, 4, 12, 12, 12, 25, 500, 7])
    for size in (1, 3, 11):
        groups = [g.to_pylist()[0] | {"row": row} for g in impacts.pack(iter(table.to_batches(size))) for row in impacts.rows_of(g)]
        assert [g["n"] for g in groups] == [4, 3, 1, 1, 1, 1]
        at = 0
        for group in groups:
            [plain] = impacts.packed_group(table.slice(at, group["n"]).combine_chunks()).to_pylist()
            assert all(group[c] == plain[c] for c in ("words", "most", "least", "ids", "lengths"))
            for c in impacts.AS_BYTES:
                assert impacts.numbers_of(group["row"][c], len(plain[c])).tolist() == plain[c]
            assert len(group["places"]) == len(plain["places"]) and len(group["counts"]) <= 2 * len(plain["counts"])
            at += group["n"]


def test_scores_of_a_group_are_added_up_a_few_pairs_at_a_time(monkeypatch):
    [group] = impacts.pack(iter(_term_lists([9, 30, 60, 61]).to_batches()))
    [row] = impacts.rows_of(group)
    asked = [(f"q{q}", f"w{k:04d}", 0.1 + q / 7 + k / 11) for q in range(5) for k in range(0, 60, 2 + q)]
    own = impacts.Asked(pa.table(dict(zip(("query_id", "term", "weight"), zip(*asked)))), 20.0)
    whole = own.scores(row, np.arange(5))
    made = []
    monkeypatch.setattr(impacts, "ranges", lambda sizes, most, kept=impacts.ranges: made.append(kept(sizes, 7)) or made[-1])
    assert (own.scores(row, np.arange(5)) == whole).all() and whole.any() and len(made[0]) > 10


def test_no_task_groups_all_long_chunks(spark):
    """A tenth of the chunks is long and has nearly all the terms."""
    table = _term_lists([5] * 360 + [300] * 40)
    documents = spark.createDataFrame(table.to_pylist(), "chunk_id string, dl int, terms array<struct<term:string,tf:int>>").repartition(16, "chunk_id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        rows = impacts.group_documents(documents).select("n", F.size("words").alias("words"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(r.n for r in rows) == 400
    words = Counter()
    for r in rows:
        words[r.task] += r.words
    assert max(words.values()) < 0.5 * sum(words.values())


def test_scores_are_added_up_a_few_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(search, "SCORE_PAIRS", 10)
    before = np.array([0, 4, 9, 10, 40, 41])
    assert search.chunk_ranges(before) == [(0, 3), (3, 4), (4, 5)]
    assert search.chunk_ranges(np.array([0])) == []


def test_few_values_of_a_batch_are_unpacked_at_a_time():
    class Batch:
        most = 0

        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            return Batch(self.values[at : at + n])

        def to_pylist(self):
            Batch.most = max(Batch.most, len(self.values))
            return self.values

    got = extract.apply_to(str.upper, Batch(["a", None, "b"] * 100))
    assert got.to_pylist() == ["A", None, "B"] * 100 and Batch.most == extract.SOME_VALUES


def test_an_answer_text_is_parsed_once_in_each_way(spark):
    raw = spark.createDataFrame([('x {"a": 1} y',)], "raw string")
    expression = generation.parse_answer(F.col("raw"))._jc.toString()
    assert expression.count("try_parse_json") == 3
    assert raw.select(F.to_json(generation.parse_answer(F.col("raw")))).first()[0] == '{"a":1}'


def test_turns_of_one_conversation_are_dealt_over_tasks(spark, monkeypatch):
    from workload import answers, data

    turns = spark.createDataFrame([(7, i, "same") for i in range(400)], "conv_id long, turn long, text string").coalesce(1)
    tables = {"documents": spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "conversations": turns}
    dealt = []
    monkeypatch.setattr(data, "table", lambda spark, sf, table: tables[table])
    monkeypatch.setattr(data, "spread", lambda *a, **k: dealt.append(spread(*a, **k)) or dealt[-1])
    answers.cases(spark, "unused")
    [rows] = [df for df in dealt if "conv_id" in df.columns]
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 300


def test_documents_that_no_turn_names_are_not_moved(spark, monkeypatch):
    """Three documents are named; with more numbers than are sent to all tasks none is left out, with the same cases."""
    from workload import answers, data

    turns = spark.createDataFrame([(1, 0, "a"), (4, 2, "b"), (13, 0, "c"), (10**7, 0, "d")], "conv_id long, turn long, text string")
    tables = {"documents": spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "conversations": turns}
    monkeypatch.setattr(data, "table", lambda spark, sf, table: tables[table])
    docs = tables["documents"]
    assert sorted(r.doc_id for r in answers.named_only(turns)(docs).collect()) == [1, 2, 7]
    few = sorted(map(str, answers.cases(spark, "unused").collect()))
    monkeypatch.setattr(answers, "WANTED", 0)
    assert answers.named_only(turns)(docs).count() == docs.count() > 4
    assert sorted(map(str, answers.cases(spark, "unused").collect())) == few


def test_texts_stay_where_no_turn_needs_them(spark):
    """Entities are taken from a document before it is moved; a report without an answer reads no text of a document."""
    from workload import answers

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joins = plan(answers.ref_grounding(spark, SMALL)).split("Join LeftOuter")
    assert "regexp_extract_all(lambda" not in joins[0] and joins[-1].count("struct(entities") == 2
    reads = [line for line in plan(answers.report_before_answer(spark, SMALL)).splitlines() if "Project [doc_id#" in line]
    assert reads and not any("text#" in line for line in reads)


def test_each_split_is_dealt_to_all_slots(spark):
    slots = spark.sparkContext.defaultParallelism
    two = spark.range(100).repartition(2)
    assert slots < 3 or spread(two, "id").rdd.getNumPartitions() == 2 * slots


def test_turns_without_a_chunk_are_dealt_over_many_keys(spark):
    from workload.answers import chunk_key

    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS query_id", "CAST(NULL AS BIGINT) AS n")
    keys = {r[0] for r in rows.select(chunk_key(F.col("n"))).collect()}
    assert len(keys) > 1000 and not any(k.lstrip("-").isdigit() for k in keys)


CHECKED = "ref_grounding numeric_grounding answer_report report_before_answer flag_details prompt_build citations generate_mock"


@pytest.mark.parametrize("name", ["cases", *CHECKED.split()])
def test_no_task_gets_all_turns_without_a_chunk(spark, tmp_path, monkeypatch, name):
    """Neither turns whose rule gives them no chunk nor turns without a number, which have no chunk of the second join."""
    from workload import answers, data

    shape = "conv_id long, turn long, text string"
    tables = {
        "documents": spark.read.parquet("/root/testdata/sf0.001/documents.parquet"),
        "conversations": spark.createDataFrame(
            [(13 * i, i % 7, f"no chunk {i}") for i in range(300)] + [(13 * i + 1, None, f"no number {i}") for i in range(300)], shape
        ),
    }
    monkeypatch.setattr(data, "table", lambda spark, sf, table: tables[table])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = getattr(answers, name)(spark, "unused").select("query_id", F.spark_partition_id().alias("task"))
        by_kind = rows.groupBy(F.col("query_id").isNull().alias("unnumbered"), "task").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for kind in {r.unnumbered for r in by_kind}:
        sizes = [r["count"] for r in by_kind if r.unnumbered == kind]
        assert max(sizes) < 0.5 * sum(sizes)


@pytest.mark.parametrize("name", ["cases", "numeric_grounding", "prompt_build", "generate_mock"])
def test_no_task_gets_all_turns_that_name_one_document(spark, tmp_path, monkeypatch, name):
    """Neither the turns of a long conversation, which share their first chunk, nor turns that share their second one."""
    from workload import answers, data

    long_one = [(5, i, f"long {i}") for i in range(200)]
    tables = {
        "documents": spark.read.parquet(f"{SMALL}/documents.parquet"),
        "conversations": spark.createDataFrame(
            long_one + [(6, 2, f"same number {i}") for i in range(300)] + [(i, 0, f"other {i}") for i in range(30)] + [(None, None, None)],
            "conv_id long, turn long, text string",
        ),
    }
    monkeypatch.setattr(data, "table", lambda spark, sf, table: tables[table])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        whole = getattr(answers, name)(spark, "unused").collect()
        monkeypatch.setattr(answers, "SHARE", 10)
        rows = getattr(answers, name)(spark, "unused")
        dealt = rows.withColumn("task", F.spark_partition_id()).collect()
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole)) and len(whole) == 531
        turns = answers.cases(spark, "unused").selectExpr("query_id", "query", "CAST(5 AS LONG) AS first_doc")
        often = spark.createDataFrame([(5, 60)], "n long, shares int")
        docs, turns = answers.with_keys(spark.range(9).toDF("n"), turns, "first_doc", often)
        assert docs.count() == 68 and max(r["count"] for r in turns.groupBy("key").count().collect()) < 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = Counter(r.task for r in dealt if r.query_id == "6-2")
    assert max(sizes.values()) < 0.5 * sum(sizes.values())
