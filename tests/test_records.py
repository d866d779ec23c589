import datetime as dt

from pyspark.sql import functions as F

from clausewright import schema
from clausewright.operators import index, validation
from helpers import records

AS_OF = "2024-02-01"


def freshness(spark, **over):
    return validation.with_freshness(records(spark, over), AS_OF).first()


def test_domains():
    assert len(schema.DOCUMENT_TYPES) == 7
    assert len(schema.COUNCILS) == 31 and len(schema.JURISDICTIONS) == 32
    assert len(set(schema.JURISDICTIONS)) == 32


def test_staleness(spark):
    assert not freshness(spark).is_stale
    assert freshness(spark, superseded_by="S.I. No. 9 of 2023").is_stale
    assert not freshness(spark, superseded_by="").is_stale
    assert not freshness(spark, superseded_by=" \n\t").is_stale
    assert freshness(spark, expiry_date=dt.date(2023, 12, 31)).is_stale
    assert not freshness(spark, expiry_date=dt.date(2025, 1, 31)).is_stale
    assert not freshness(spark, expiry_date=dt.date(2024, 2, 1)).is_stale


def test_reverification(spark):
    day = dt.date(2024, 2, 1)
    assert freshness(spark, last_verified=day - dt.timedelta(days=31)).needs_reverification
    assert not freshness(spark, last_verified=day - dt.timedelta(days=30)).needs_reverification
    row = freshness(spark, last_verified=day)
    assert not row.needs_reverification and row.days_since_verified == 0


def test_validation_splits_rows(spark):
    rows = records(
        spark,
        {"chunk_id": "ok", "superseded_by": "  x "},
        {"chunk_id": "short", "text": "Too short"},
        {"chunk_id": "type", "document_type": "leaflet"},
        {"chunk_id": "place", "jurisdiction": None},
        {"chunk_id": "both", "confidence": "sure", "text": "Too short"},
    )
    checked = validation.validate(rows)
    assert [(r.chunk_id, r.superseded_by) for r in checked.valid.collect()] == [("ok", "x")]
    errors = {r.chunk_id: len(r.errors) for r in checked.rejects.collect()}
    assert errors == {"short": 1, "type": 1, "place": 1, "both": 2}


def test_flat_metadata_has_no_nulls(spark):
    row = validation.flat_metadata(
        records(spark, {"act_year": None, "effective_date": None, "summary": None}), AS_OF
    ).first()
    assert row.act_year == 0 and row.effective_date == "" and row.summary == "" and row.expiry_date == ""
    assert row.last_verified == "2024-02-01" and row.is_stale is False and len(row) == 20
    assert None not in tuple(row)


def test_new_chunks_skip_stored_and_repeated(spark):
    rows = records(spark, {"chunk_id": "a"}, {"chunk_id": "a"}, {"chunk_id": "b"}, {"chunk_id": "c"})
    stored = spark.createDataFrame([("b",)], "chunk_id string")
    assert sorted(r.chunk_id for r in index.new_chunks(rows, stored).collect()) == ["a", "c"]


def test_manifest_and_stats(spark):
    rows = records(
        spark,
        {"chunk_id": "a", "source_doc_id": "d1", "source_title": "first"},
        {"chunk_id": "b", "source_doc_id": "d1", "chunk_index": 1, "superseded_by": "new"},
        {"chunk_id": "c", "source_doc_id": "d2", "last_verified": dt.date(2023, 1, 1)},
    )
    found = {r.doc_id: (r.title, r.chunk_count) for r in index.manifest(rows).collect()}
    assert found == {"d1": ("first", 2), "d2": ("Regulations", 1)}
    stats = index.corpus_stats(rows, AS_OF).first()
    assert (stats.total_chunks, stats.indexed_chunks, stats.total_docs_ingested) == (3, 2, 2)
    assert (stats.stale_chunks, stats.chunks_needing_reverify) == (1, 1)
    none = index.corpus_stats(rows.where(F.lit(False)), AS_OF).first()
    assert none.total_chunks == 0 and none.last_updated == "never"
