import pytest

import corpus_pipeline
from clausewright.llm import queries
from clausewright.llm.secret_scan import Scanner
from clausewright.operators.sizing import materialise
from conftest import SMALL

duckdb = pytest.importorskip("duckdb")


def test_every_query_runs_over_all_rows(spark):
    sizes = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op3_html_extraction", "op4_language_id", "op8_toxicity", "op9_secret_scans", "op10_benchmark_decontamination"):
        assert queries.QUERIES[name](spark, SMALL).count() == sizes["pages" if "html" in name else "documents"]


def test_sql_of_queries(spark):
    from check_oracles import TABLES, normal

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df, cursor = queries.QUERIES[name](spark, SMALL), con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), names), name


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision on what the one before has kept."""
    from test_neardup import brute

    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, seen = given, [given.toPandas().set_index("doc_id")]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL))
        assert docs.columns == given.columns, name
        seen.append(docs.toPandas().set_index("doc_id"))
    first, spoken, single, unseen, clean, mixed = seen
    gone = first.text[~first.index.isin(spoken.index)]
    assert len(gone) <= 2 and len(spoken) + len(gone) == len(first)
    groups = brute(list(spoken.text.items()), 5, 80)
    assert set(single.index) == {i for i, (_, c) in groups.items() if i == c}
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas().text
    assert {i for i, t in single.text.items() if any(x in t for x in items)} == set(single.index) - set(unseen.index)
    assert set(clean.index) == set(unseen.index) and (clean.n_chars == clean.text.str.len()).all()
    scanner = Scanner()
    assert any(scanner.spans(t) for t in unseen.text) and not any(scanner.spans(t) for t in clean.text)
    assert set(mixed.index) <= set(clean.index) and mixed.groupby(level=0).size().max() <= 3
    assert (mixed.text == clean.text[mixed.index]).all()


def test_pipeline_stages_on_empty_tables(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).isEmpty()
