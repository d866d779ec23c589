"""What a batch of queries costs: sizes measured once, tables shared by a session."""

import os

import pytest

from clausewright.operators import search, sizing
from conftest import SMALL
from workload import data as d
from workload import records
from workload import retrieval as queries


def test_sizes_of_a_batch(spark):
    rows = [("a", "Solar roof, roof"), ("b", ""), ("c", None), ("c", "S.I. 2")]
    asked = spark.createDataFrame(rows, "query_id string, query string")
    assert search.measure(asked) == search.BatchSize(4, 5)  # solar roof roof, s.i 2
    assert search.measure(asked.limit(0)) == search.BatchSize(0, 0)


def test_values_are_not_counted_far_beyond_the_limit(spark):
    def refuse():
        raise AssertionError("counted")

    class Unread:
        select = property(lambda self: refuse())

    assert sizing.few_values(Unread(), "id", 8, rows_at_most=8 * sizing.WORTH_COUNTING + 1) is None
    assert sorted(sizing.few_values(spark.range(8), "id", 8, rows_at_most=8 * sizing.WORTH_COUNTING)) == list(range(8))


def test_made_once_until_its_tables_are_gone(spark):
    made = []

    def make():
        made.append(sizing.materialise(spark.range(3)))
        return made[-1]

    first = sizing.once(spark, "test table", make)
    assert sizing.once(spark, "test table", make) is first and len(made) == 1
    sizing.once(spark, "other table", make)
    assert len(made) == 2
    files, path = sizing._located(spark, first.inputFiles()[0].rsplit("/", 1)[0])
    files.delete(path, True)
    again = sizing.once(spark, "test table", make)
    assert len(made) == 3 and again.count() == 3


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "counted")
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup(None, None)
    return found


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")
def test_retrieval_over_stored_tables_stays_within_its_jobs(spark):
    records.searched(spark, SMALL)
    d.boost_vector(spark, SMALL)
    assert 0 < jobs_of(spark, lambda: queries.hybrid_topk(spark, SMALL).collect()) <= 36
