import datetime as dt
import sys
import urllib.error
from email.message import Message

import pytest
from pyspark.sql import functions as F

from clausewright.operators.embedding import hashing_embedder, model_embedder
from clausewright.plans import service
from clausewright.plans.ingestion import run_ingestion
from clausewright.plans.knowledge import KnowledgeBase
from clausewright.plans.service import Service
from clausewright.schema import REQUEST_SCHEMA
from clausewright.sources import extract, reading
from clausewright.sources.registry import SOURCES, find_source, registry
from clausewright.streaming.ingest import ingest_stream, stream_documents
from helpers import records
from test_chunking import SAMPLE, filler

AS_OF = "2024-02-01"


def test_councils(spark):
    rows = service.councils(spark).collect()
    assert len(rows) == 31 and [r.name for r in rows] == sorted(r.name for r in rows)
    assert {r.slug: r.name for r in rows}["dun_laoghaire_rathdown"] == "Dun Laoghaire Rathdown"


def test_request_validation(spark):
    rows = [
        ("hi", "national", 5),
        ("Do I need permission?", "moon_base", 5),
        ("Do I need permission?", "kerry", 11),
        ("x" * 501, None, None),
        ("Do I need permission?", None, None),
        ("Do I need permission?", "kerry", 1),
        ("     a      ", "kerry", 1),
    ]
    got = service.validate_requests(spark.createDataFrame(rows, REQUEST_SCHEMA)).collect()
    assert [r.status for r in got] == [422, 422, 422, 422, 200, 200, 200]
    assert [r.jurisdiction for r in got[4:]] == [None, "kerry", "kerry"] and got[4].top_k == 5
    assert [r.form_ok for r in got[4:]] == [True, True, False]
    assert got[1].errors == ["Unknown council: 'moon_base'"]


def test_request_ids(spark):
    ids = [r[0] for r in spark.range(50).select(service.request_id()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 16 and i.startswith("req_") for i in ids)


def test_registry(spark):
    sources = registry(spark)
    assert sources.count() == 11 and len({s[0] for s in SOURCES}) == 11
    assert find_source(sources, "npf_2040").first().act_year == 2018
    assert find_source(sources, "nowhere").count() == 0


HTML = {
    "main first": ("<body><div id='content'>a</div><main>b</main></body>", "b"),
    "then id": ("<body><article>x</article><p id='content'>a<b>b</b> c</p></body>", "a\nb\nc"),
    "then class": ("<body><article>x</article><div class='left MAINpart'>y</div></body>", "y"),
    "then article": ("<body>z<article>x  y</article></body>", "x y"),
    "then body": ("<html><head><title>t</title></head><body>one<br>two</body></html>", "one\ntwo"),
    "nothing": ("just <i>text</i>", "just\ntext"),
    "boilerplate": ("<body><nav>n</nav><header>h</header>a<footer>f</footer><aside>s</aside><noscript>n</noscript><style>p{}</style><script>x='</p>'</script></body>", "a"),
    "dropped container": ("<body><nav><main>no</main></nav>yes</body>", "yes"),
    "unclosed": ("<body><p>one<p>two<div>three", "one\ntwo\nthree"),
    "odd references": ("<body>a &amp b &notit; &foo; &copy; &#65; &amp;lt;</body>", "a &amp b &notit; &foo; © A &lt;"),
    "no body": ("<title>T</title><p>text</p>", "text"),
    "head without body": ("<html><head><title>T</title><meta charset='utf-8'></head>one<p>two</p></html>", "one\ntwo"),
    "late body": ("<title>T</title><p>a</p><body class=x>b</body>", "a\nb"),
    "unclosed head": ("<html><head><title>T</title><noscript><img>n</noscript><p>a</p>", "a"),
    "only a title": ("<title>T</title>", "T"),
    "self-closed container": ("<body>x<div id='content'/>in</div>out</body>", "in"),
    "self-closed elsewhere": ("<body><nav/>a<svg><path d='x'/></svg>b<svg/>c<br/>d</body>", "a\nb\nc\nd"),
    "entities and comments": ("<body>a &amp; b<!-- c -->d&nbsp;</body>", "a & b\nd"),
}


def test_html_text(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in HTML.items()], "k string, html string")
    got = {r.k: r.t for r in df.select("k", extract.html_text(F.col("html")).alias("t")).collect()}
    assert got == {k: v[1] for k, v in HTML.items()}


def test_charsets(spark):
    cases = {
        "é".encode(): "é", b"\xe9": "é", b"<meta charset=iso-8859-2>\xb1": "<meta charset=iso-8859-2>ą",
        b'<meta http-equiv=x content="text/html; charset=windows-1252">\x80': '<meta http-equiv=x content="text/html; charset=windows-1252">€',
        b"<meta charset=nonsense>\xc3\xa9": "<meta charset=nonsense>é", "\ufeffé".encode(): "é", "\ufeffé".encode("utf-16-le"): "é",
        b"<meta charset=utf-16>a\r\nb": "<meta charset=utf-16>a\nb", b"": "",
    }
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "k int, b binary")
    got = {r.k: r.t for r in df.select("k", extract.page_source(F.col("b")).alias("t")).collect()}
    assert got == dict(enumerate(cases.values()))
    header = Message()
    header["Content-Type"] = "text/html; charset=windows-1252"
    assert extract.decode_page(reading._marked(b"\x80", header)) == "€"


def test_pdf_needs_a_reader(monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", None)
    assert extract.pdf_pages(b"no pdf") == ""
    with pytest.raises(RuntimeError, match="pypdf"):
        extract.pdf_pages(b"%PDF-1.7 ...")


def test_only_named_files_are_read(spark, tmp_path, monkeypatch):
    for name in ("a.txt", "b {1},[x]*.txt", "c.txt", "big.pdf"):
        (tmp_path / name).write_text(f"text of {name}")
    sources = spark.createDataFrame(
        [("1", "local://a.txt"), ("2", "local://b {1},[x]*.txt"), ("3", "local://a.txt"), ("4", "local://gone.txt"), ("5", "http://c.txt")], "id string, url string"
    )
    names = sources.selectExpr("replace(url, 'local://', '') AS file")
    assert len(reading.named_files(spark, str(tmp_path), names).inputFiles()) == 2
    want = {"1": "text of a.txt", "2": "text of b {1},[x]*.txt", "3": "text of a.txt"}
    assert {r.id: r.raw_text for r in reading.local_texts(sources, str(tmp_path)).collect()} == want
    monkeypatch.setattr(reading, "NAMED_FILES", 1)
    assert {r.id: r.raw_text for r in reading.local_texts(sources, str(tmp_path)).collect()} == want
    assert reading.local_texts(sources.limit(0), str(tmp_path)).isEmpty()


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v) for k, v in enumerate([[1.0, 2.0], None, [], [1.0], [1.0, None], [nan, 1.0], [-inf, 1.0]])]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    bad = df.select("k", service.unusable_vector(F.col("v"), 2).alias("w"), service.unusable_vector(F.col("v")).alias("n")).orderBy("k").collect()
    assert [r.w for r in bad] == [False] + [True] * 6 and [r.n for r in bad] == [False, True, True, False, True, True, True]


def test_http_policy():
    tried, slept = [], []

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return b"ok"

    def opener(failures, code=None):
        def open_(request, timeout):
            tried.append(timeout)
            if len(tried) <= failures:
                raise urllib.error.HTTPError("u", code, "m", None, None) if code else OSError("down")
            return Reply()

        return open_

    assert reading.http_get("http://x", opener(2), slept.append) == b"ok" and slept == [2, 4] and tried == [30] * 3
    tried.clear(), slept.clear()
    assert reading.http_get("http://x", opener(9, 500), slept.append) is None and len(tried) == 3
    tried.clear(), slept.clear()
    assert reading.http_get("http://x", opener(9, 404), slept.append) is None and len(tried) == 1 and slept == []


def test_model_embedder_normalises(spark):
    fake = model_embedder(lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    rows = spark.range(70).select(fake(F.format_string("t%d", "id")).alias("v")).collect()
    assert all([round(x, 5) for x in r.v] == [0.6, 0.8] for r in rows)


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path / "kb"), hashing_embedder(16))


def some(spark, *ids, **over):
    return records(spark, *[{"chunk_id": i, "text": f"rule {i} about sheds and porches, number {i}", **over} for i in ids])


def stored(kb):
    return sorted(r.chunk_id for r in kb.chunks().collect())


def test_adding_is_incremental_and_repeatable(spark, kb):
    assert kb.batches() == [] and kb.chunks().count() == 0
    assert kb.add_chunks(some(spark, "a", "b", "b"), AS_OF, batch_id="one") == 2
    assert kb.add_chunks(some(spark, "a", "b", "c"), AS_OF, batch_id="one") == 0
    assert kb.add_chunks(some(spark, "a", "b", "c"), AS_OF) == 1
    assert kb.add_chunks(some(spark, "a"), AS_OF) == 0
    assert kb.add_chunks(some(spark, "s", superseded_by="x"), AS_OF) == 0
    assert kb.add_chunks(some(spark, "bad", document_type="leaflet"), AS_OF) == 0
    assert stored(kb) == ["a", "b", "c"] and kb.vectors(AS_OF).count() == 3
    corpus = kb.sparse_index().corpus.first()
    assert corpus.n_docs == 3
    from clausewright.operators.index import build_sparse_index

    rebuilt = build_sparse_index(kb.chunks())
    want = {(r.term, r.df, round(r.idf, 9)) for r in rebuilt.term_stats.collect()}
    assert {(r.term, r.df, round(r.idf, 9)) for r in kb.sparse_index().term_stats.collect()} == want
    asks = spark.createDataFrame([("q", "sheds c")], "query_id string, query string")
    pruned = kb.sparse_index(asks)
    assert {r.term for r in pruned.postings.collect()} == {r.term for r in pruned.term_stats.collect()} == {"sheds", "c"}
    text = pruned.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in text or "batch_id" in text.split("PartitionFilters")[1]
    assert "In(term, [" in text.split("PushedFilters")[1]


def test_uncommitted_batches_stay_invisible(spark, kb):
    kb.add_chunks(some(spark, "a"), AS_OF)
    kb._write(some(spark, "ghost"), "chunks", "crashed", key="chunk_id")
    assert stored(kb) == ["a"]


def test_overwrite_and_rebuild(spark, kb):
    kb.add_chunks(some(spark, "a", "b"), AS_OF)
    assert kb.add_chunks(some(spark, "b", summary="new"), AS_OF, overwrite=True) == 2
    assert {r.chunk_id: r.summary for r in kb.chunks().collect()} == {"a": "Class 1", "b": "new"}
    for table in (kb.vectors(AS_OF), kb.sparse_index().documents):
        assert sorted(r.chunk_id for r in table.collect()) == ["a", "b"]
    assert kb.chunk_total().first().total_chunks == kb.sparse_index().corpus.first().n_docs == 2


def test_overwrite_embeds_new_texts_only(spark, kb, tmp_path):
    kb.add_chunks(some(spark, "a", "b"), AS_OF)
    marked = KnowledgeBase(spark, kb.path, lambda text: F.array(F.lit(-1.0).cast("float"), F.lit(0.0).cast("float")))
    marked.add_chunks(some(spark, "b"), AS_OF, overwrite=True)
    widths = {r.chunk_id: len(r.embedding) for r in marked.vectors(AS_OF).collect()}
    assert widths["b"] == 2 != widths["a"]


def test_rebuild_replaces_everything(spark, kb):
    kb.add_chunks(some(spark, "a", "b"), AS_OF)
    assert kb.add_chunks(some(spark, "z"), AS_OF, rebuild=True) == 1
    assert stored(kb) == ["z"] and kb.sparse_index().corpus.first().n_docs == 1 and kb.vectors(AS_OF).count() == 1


def test_ingestion_service_and_feedback(spark, kb, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "schedule2_part1_classes1to7_seed.txt").write_bytes(SAMPLE.replace("\n", "\r\n").encode() + b"\xff")
    (raw / "dublin_city_devplan_2022.pdf").write_bytes(b"not a pdf")
    asked = []

    def get(url):
        asked.append(url)
        if "citizens" in url:
            return f"<html><body><main><p>{filler(50)}</p></main></body></html>".encode()
        return None

    ids = ["schedule2_part1_seed", "dublin_city_devplan_2022", "citizens_info_appeal", "npf_2040"]
    run = lambda **k: run_ingestion(
        kb, registry(spark), str(raw), str(tmp_path / "cache"), source_ids=ids, get=get, as_of=AS_OF, **k
    )
    reading.RATE_LIMIT_SECONDS = 0
    first = run()
    assert (first["sources_attempted"], first["sources_succeeded"], first["errors"]) == (4, 2, 0)
    assert first["chunks_added"] == first["total_chunks"] == 4 and len(asked) == 2
    again = run()
    assert again["chunks_added"] == 0 and len(asked) == 3  # only what is not cached yet is asked for again
    assert run(rebuild=True)["chunks_added"] == 4
    assert {r.doc_id: r.chunk_count for r in kb.list_sources().collect()} == {"schedule2_part1_seed": 3, "citizens_info_appeal": 1}

    desk = Service(kb, as_of=AS_OF)
    assert desk.health().first().status_code == 200 and desk.stats().first().total_chunks == 4
    requests = spark.createDataFrame(
        [("Is a porch of 40 square metres exempt?", "national", 2), ("hi", "national", 5), ("Do I need permission here?", "moon_base", 5)],
        REQUEST_SCHEMA,
    )
    rows = {r.query: r for r in desk.answer(requests).collect()}
    good = rows["Is a porch of 40 square metres exempt?"]
    assert good.status == 200 and good.meta.chunks_retrieved == 2 and good.query_type == "EXEMPTION"
    assert good.answer.citations and good.answer.useful and good.request_id.startswith("req_")
    assert rows["hi"].status == 422 and rows["hi"].answer is None
    assert rows["Do I need permission here?"].errors == ["Unknown council: 'moon_base'"]

    reply = desk.submit_feedback(
        spark.createDataFrame([("r1", "q", True, None), ("r2", "q", False, "wrong")], "request_id string, query string, helpful boolean, comment string")
    )
    assert reply["status"] == "received"
    total = service.feedback_summary(kb.feedback(), "query").first()
    assert (total.n, total.n_helpful, total.n_unhelpful_with_comment) == (2, 1, 1)
    kb.save_manifest(str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 2


def test_one_error_for_each_document(spark):
    from clausewright.operators.validation import document_errors

    raw = spark.createDataFrame(
        [(("d1", "leaflet", "moon", "high"),), (("d2", "primary_act", "national", "high"),), (("d3", "primary_act", "national", None),)],
        "metadata struct<id:string,document_type:string,jurisdiction:string,confidence:string>",
    )
    chunks = spark.createDataFrame([("d1", ["b", "a"]), ("d1", ["b"]), ("d2", [])], "source_doc_id string, errors array<string>")
    out = {r.source_doc_id: r.errors for r in document_errors(raw, chunks).collect()}
    assert set(out) == {"d1", "d3"} and out["d1"] == ["a", "b", *sorted(out["d1"][2:])] and len(out["d1"]) == 4 and len(out["d3"]) == 1
    assert document_errors(raw.limit(0), chunks.limit(0)).isEmpty()


def test_streaming_ingest(spark, kb, tmp_path):
    from clausewright.streaming.ingest import RAW_SCHEMA

    folder, state = str(tmp_path / "in"), str(tmp_path / "state")

    def drop(source_id, text):
        row = (source_id, "t", "u", "primary_act", "national", "", 2000, dt.date(2000, 1, 1), "high", True)
        spark.createDataFrame([(row, text)], RAW_SCHEMA).write.mode("append").parquet(folder)

    def run():
        ingest_stream(kb, stream_documents(spark, folder), state, AS_OF).awaitTermination()

    drop("one", SAMPLE)
    run()
    assert kb.chunks().count() == 3
    drop("two", SAMPLE)
    drop("one", SAMPLE)
    run()
    assert kb.chunks().count() == 6 and len(kb.batches()) == 2


def test_empty_store_answers(spark, kb):
    desk = Service(kb, as_of=AS_OF)
    assert desk.health().first().status_code == 503
    rows = desk.answer(spark.createDataFrame([("Do I need permission?", "kerry", 5)], REQUEST_SCHEMA)).collect()
    assert rows[0].answer.is_blocked and rows[0].meta.chunks_retrieved == 0
