"""Plans that must keep their shape."""

import pytest
from pyspark.sql import functions as F

from clausewright.operators import impacts, search, vectors
from clausewright.operators.sizing import few_values, materialise, restrict
from conftest import SMALL
from workload import data as d
from workload import records, splitting


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not __import__("os").path.exists(SMALL), reason="no tables")
class TestPlans:
    def test_chunking_never_shuffles_big_inputs(self, spark, monkeypatch):
        monkeypatch.setattr(d, "spread", lambda df, key: df)
        text = plan(splitting.chunk_texts(spark, SMALL))
        assert "Exchange" not in text and "Python" not in text

    def test_postings_need_no_shuffle(self, spark, monkeypatch):
        monkeypatch.setattr(d, "spread", lambda df, key: df)
        assert "Exchange" not in plan(records.bm25_postings(spark, SMALL))

    def test_freshness_reads_no_text(self, spark):
        text = plan(records.staleness_gate(spark, SMALL))
        assert "ReadSchema: struct<doc_id:bigint>" in text

    def scored(self, spark):
        asks = d.asks(spark, SMALL)
        scores = search.sparse_hits(records.searched(spark, SMALL)[0], asks, 60)
        return plan(search.ranked(scores, 60, F.desc("score"), F.asc("chunk_id")))

    def test_keyword_search_shuffles_only_each_tasks_best_hits(self, spark):
        text = self.scored(spark)
        assert text.count("Exchange") == text.count("Exchange hashpartitioning(query_id") == 1
        assert text.count("WindowGroupLimit") == 2 and text.count("MapInArrow") == 1

    def test_group_vectors_are_read_where_they_are_needed(self, spark):
        groups = vectors.stored_groups(d.vectors(spark, SMALL)).groups
        some = groups.select("group_id").limit(1).withColumns({"block": F.lit(0).cast("long"), "rows": F.array(F.lit(0))})
        asks = search.query_frame(d.asks(spark, SMALL), 5)
        blocks = vectors.query_blocks(asks, {})
        text = plan(vectors.score_pairs(groups, materialise(some), blocks, 0, 6))
        scans = [line for line in text.splitlines() if "matrix#" in line and "FileScan" in line and "centre#" in line]
        assert len(scans) == 1 and "(centre#" in scans[0].split("PartitionFilters")[1], text
        assert "EqualTo(group_id" in scans[0] or "In(group_id" in scans[0]
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text

    def test_bounds_of_term_groups_are_read_without_the_lists(self, spark):
        groups = materialise(impacts.group_documents(records.searched(spark, SMALL)[0].documents))
        asked = spark.sparkContext.broadcast(None)
        text = plan(impacts.further_pairs(groups, asked, asked))
        assert "ReadSchema: struct<words:array<string>,most:array<int>,least:array<int>,group_id:string>" in text
        assert "Exchange" not in text

    def test_few_ids_reach_the_files(self, spark, tmp_path):
        path = str(tmp_path / "t")
        spark.range(100).selectExpr("cast(id as string) chunk_id", "id").write.parquet(path)
        table = spark.read.parquet(path)
        ids = few_values(table.where("id < 20"), "chunk_id")
        assert "In(chunk_id, [" in plan(restrict(table, "chunk_id", ids)).split("PushedFilters")[1]
        assert few_values(table, "chunk_id", 99) is None

    def test_vectors_are_scanned_once_without_shuffle(self, spark):
        df = search.dense_search(d.vectors(spark, SMALL), d.asks(spark, SMALL))
        assert plan(df).count("MapInArrow") == 1
