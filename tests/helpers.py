"""Small builders shared by the tests."""

from __future__ import annotations

import datetime as dt


METADATA = (
    "chunk_id string, section_ref string, source_title string, jurisdiction string, document_type string, "
    "confidence string, is_stale boolean, effective_date string, needs_reverification boolean"
)
CHUNK = f"struct<text:string,metadata:struct<{METADATA.replace(' string', ':string').replace(' boolean', ':boolean')}>,rrf_score:double,rerank_score:double,dense_rank:int,sparse_rank:int,source:string>"


def chunk(chunk_id="c1", text="Class 1 extension up to 40 square metres is exempt.", section_ref="Class 1", **over):
    meta = {
        "chunk_id": chunk_id,
        "section_ref": section_ref,
        "source_title": "PDR 2001 Schedule 2",
        "jurisdiction": "national",
        "document_type": "exemption_schedule",
        "confidence": "high",
        "is_stale": False,
        "effective_date": "2001-10-01",
        "needs_reverification": False,
    }
    own = {"rrf_score": 0.02, "rerank_score": 5.0, "dense_rank": 1, "sparse_rank": 1, "source": "both"}
    for key, value in over.items():
        (own if key in own else meta)[key] = value
    return {"text": text, "metadata": meta, **own}


def results(spark, *rows):
    """Result rows from (query, chunks, overrides) triples."""
    schema = (
        f"query_id string, query string, council string, chunks array<{CHUNK}>, total_dense_hits int, "
        "total_sparse_hits int, reranker_used boolean, retrieval_quality double, generated string"
    )
    out = []
    for i, (query, chunks, over) in enumerate(rows):
        row = {
            "query_id": str(i),
            "query": query,
            "council": "dublin_city",
            "chunks": chunks,
            "total_dense_hits": 5,
            "total_sparse_hits": 5,
            "reranker_used": True,
            "retrieval_quality": 0.75,
            "generated": None,
        }
        row.update(over)
        out.append(row)
    return spark.createDataFrame(out, schema)


def record(**over):
    row = {
        "chunk_id": "c1",
        "source_doc_id": "test_doc_001",
        "chunk_index": 0,
        "text": "A rear extension of at most 40 square metres is exempt under Class 1.",
        "summary": "Class 1",
        "document_type": "exemption_schedule",
        "jurisdiction": "national",
        "source_title": "Regulations",
        "source_url": "https://example.org",
        "section_ref": "Class 1 | S.I. No. 600 of 2001",
        "si_number": "S.I. No. 600 of 2001",
        "act_year": 2001,
        "effective_date": dt.date(2001, 10, 1),
        "last_verified": dt.date(2024, 2, 1),
        "superseded_by": None,
        "expiry_date": None,
        "confidence": "high",
        "is_verbatim": True,
        "verified_url": False,
        "ingested_at": dt.datetime(2024, 2, 1),
        "version": "1.0",
    }
    row.update(over)
    return row


def records(spark, *overrides):
    from clausewright.schema import CHUNK_SCHEMA

    return spark.createDataFrame([record(**o) for o in overrides], CHUNK_SCHEMA)


