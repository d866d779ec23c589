"""Answer checking, classification, parsing, citations and assembled responses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from clausewright.operators import checking, fusion, generation, prompts, providers
from clausewright.operators.sizing import at_most, materialise
from clausewright.schema import JURISDICTIONS
from workload import data as d
from workload.retrieval import BLOCK_SQL, ENTITIES_SQL

CASE = {
    "query_id": f"{d.text_of('conv_id')} || '-' || {d.text_of('turn')}",
    "query": d.TURN_QUERY,
    "generated": d.TURN_ANSWER,
    "council": d.pick(JURISDICTIONS, "conv_id % 32"),
    "retrieval_quality": "CAST((conv_id * 7 + turn) % 11 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "total_dense_hits": "CAST(conv_id % 3 AS INT)",
    "total_sparse_hits": "CAST((conv_id + turn) % 4 AS INT)",
    "first_doc": "CASE WHEN conv_id % 13 = 0 OR turn % 3 = 2 THEN NULL ELSE conv_id END",
    "second_doc": "CASE WHEN conv_id % 13 = 0 OR turn % 2 = 1 THEN NULL ELSE conv_id + turn + 1 END",
}

KEYS = 4096  # over which turns without a chunk are dealt
WANTED = 500_000  # chunk numbers that are sent to all tasks; when turns name more, all documents are moved
SHARE = 4096  # turns that meet a document under one key; a document that more turns name gets several keys


def chunk():
    """A document as a chunk. Columns need a session, and this module is read before there is one."""
    return F.struct(
        "text",
        F.struct(
            "chunk_id",
            "section_ref",
            "source_title",
            "jurisdiction",
            "document_type",
            "confidence",
            "is_stale",
            F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"),
            "needs_reverification",
        ).alias("metadata"),
    )


def chunk_key(number, *by):
    """Key of a turn's chunk. Turns without one get keys that no chunk has, or one task of the join would get them all.

    They are dealt by ``by``, the columns that tell turns apart; a turn without a number has no ``query_id``.
    """
    place = F.pmod(F.xxhash64(*(by or ("query_id",))), F.lit(KEYS))
    return F.coalesce(number.cast("string"), F.concat(F.lit("none "), place.cast("string")))


def numbers_of(turns):
    """The number of each chunk that a turn names."""
    return turns.selectExpr(f"explode(array({CASE['first_doc']}, {CASE['second_doc']})) AS n").where("n IS NOT NULL")


def named_only(turns):
    """Keeps the documents that some turn names. The others have no part in the joins, and their texts need not be moved."""
    numbers = numbers_of(turns).distinct()
    few = at_most(numbers, WANTED)
    own = F.expr(d.CORPUS["chunk_index"]).cast("long")
    return lambda docs: docs.join(F.broadcast(numbers), own == F.col("n"), "left_semi") if few else docs


def often_named(turns):
    """Documents that more than ``SHARE`` turns name, as the turns of a long conversation do, with a number of keys for
    each; None when there are none. No more than one in ``SHARE`` of all numbers is such a document."""
    counted = numbers_of(turns).groupBy("n").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    often = materialise(counted.where("shares > 1"))
    return None if at_most(often, 0) else often


def with_keys(docs, turns, name, often):
    """Both sides of a join by ``key``: a document stands under each of its keys once, a turn has one of them."""
    number, by = F.col("n").cast("string"), ("query_id", "query")
    key = chunk_key(F.col(name), *by)
    if often is None:
        return docs.withColumn("key", number), turns.withColumn("key", key)
    docs = docs.join(F.broadcast(often), "n", "left")
    keys = F.transform(F.sequence(F.lit(1), F.coalesce("shares", F.lit(1))), lambda i: F.concat(number, F.lit(" "), i.cast("string")))
    docs = docs.withColumn("key", F.explode(F.when(F.col("shares").isNull(), F.array(number)).otherwise(keys))).drop("shares")
    place = F.concat(key, F.lit(" "), (F.pmod(F.xxhash64(*by), F.col("shares")) + 1).cast("string"))
    turns = turns.join(F.broadcast(often.withColumnRenamed("n", name)), name, "left")
    return docs, turns.withColumn("key", F.coalesce(place, key)).drop("shares")


def cases(spark, sf, kept=None):
    """Each turn as a question with an answer text and up to two retrieved chunks, whole or only ``kept`` of each."""
    table = d.table(spark, sf, "conversations")
    turns = d.spread(table, "conv_id", "turn").selectExpr(*[f"{e} AS {n}" for n, e in CASE.items()])
    kept = chunk() if kept is None else kept
    docs = d.fresh_corpus(spark, sf, named_only(table)).select(F.col("chunk_index").cast("long").alias("n"), kept.alias("c"))
    often = often_named(table)
    for name, found in (("first_doc", "c1"), ("second_doc", "c2")):
        own, turns = with_keys(docs, turns, name, often)
        turns = turns.join(own.select("key", F.col("c").alias(found)), "key", "left").drop("key", name)
    both = F.filter(F.array("c1", "c2"), lambda c: c.isNotNull())
    return turns.withColumn("chunks", both).drop("c1", "c2")


def joined(col):
    return F.coalesce(F.array_join(col, "; "), F.lit(""))


def query_classify(spark, sf):
    turns = d.table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{d.TURN_QUERY} AS query")
    return turns.select("conv_id", "turn", generation.classify_query(F.col("query")).alias("query_type"))


def classify_documents(spark, sf):
    """Keywords count inside words too, so plain documents are classified by accident."""
    docs = d.spread(d.table(spark, sf, "documents"), "doc_id")
    return docs.groupBy(generation.classify_query(F.col("text")).alias("query_type"), "lang").agg(
        F.count(F.lit(1)).alias("n")
    )


def escalation(spark, sf):
    turns = d.table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{d.TURN_QUERY} AS query")
    return turns.select(
        "conv_id", "turn", F.coalesce(checking.escalation_pattern(F.col("query")), F.lit("")).alias("pattern")
    )


def ref_grounding(spark, sf):
    """Entities are found once in each document, so that its text need not be moved to the turns."""
    own = F.struct(fusion.entity_set(F.array(chunk())).alias("entities"))
    entities = F.array_distinct(F.flatten(F.transform("chunks", lambda c: c["entities"])))
    refs = checking.ungrounded_references(F.col("generated"), entities)
    return cases(spark, sf, own).select("query_id", joined(refs).alias("ungrounded"))


def numeric_grounding(spark, sf):
    numbers = checking.ungrounded_numbers(F.col("generated"), checking.all_chunk_text(F.col("chunks")))
    return cases(spark, sf).select("query_id", joined(numbers).alias("ungrounded"))


def report_columns(report):
    warning = F.create_map(*[F.lit(x) for k, v in checking.WARNINGS.items() for x in (v, k)])
    return [
        F.round(report["confidence_score"], 6).alias("confidence_score"),
        report["confidence_label"].alias("confidence_label"),
        joined(F.transform(report["flags"], lambda f: f["code"])).alias("codes"),
        joined(F.transform(report["flags"], lambda f: f["severity"])).alias("severities"),
        joined(report["ungrounded_claims"]).alias("claims"),
        report["requires_escalation"].alias("requires_escalation"),
        report["escalation_reason"].alias("escalation_reason"),
        report["chunks_used"].alias("chunks_used"),
        report["is_blocked"].alias("is_blocked"),
        F.element_at(warning, report["user_warning"]).alias("warning"),
        report["status"].alias("status"),
    ]


def answer_report(spark, sf):
    checked = checking.check_answers(cases(spark, sf), "generated")
    return checked.select("query_id", *report_columns(F.col("report")))


def report_before_answer(spark, sf):
    """Without an answer the texts of the chunks are not read, and not moved."""
    textless = F.struct(F.lit(None).cast("string").alias("text"), chunk()["metadata"].alias("metadata"))
    checked = checking.check_answers(cases(spark, sf, textless))
    return checked.select("query_id", *report_columns(F.col("report")))


def flag_details(spark, sf):
    checked = checking.check_answers(cases(spark, sf), "generated")
    return checked.select("query_id", F.posexplode("report.flags").alias("pos", "f")).select(
        "query_id", "pos", "f.code", "f.severity", "f.detail"
    )


def detector_log(spark, sf):
    checked = checking.check_answers(cases(spark, sf), "generated")
    return checked.groupBy(F.col("report.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("report.flags")).alias("n_flags"),
        F.sum(F.size("report.ungrounded_claims")).alias("n_claims"),
        F.round(F.avg("report.confidence_score"), 6).alias("mean_confidence"),
    )


def prompt_build(spark, sf):
    df = cases(spark, sf)
    query_type = generation.classify_query(F.col("query"))
    prompt = prompts.build_prompt(
        query_type, fusion.context_string(F.col("chunks")), F.col("query"), F.col("council")
    )
    return df.select("query_id", query_type.alias("query_type"), F.length(prompt).alias("n_chars"), F.md5(prompt).alias("prompt_md5"))


# An event's properties as the model answer of one of eight kinds.
_BODY = (
    "'{\"answer_summary\": \"' || event_type || ' ' || CAST(user_id AS STRING) || '\", \"confidence\": \"' || "
    + d.pick(("high", "medium", "low", "certain"), "event_id % 4")
    + " || '\", \"chunks_used\": [1, ' || CAST(event_id % 4 AS STRING) || '], \"props\": ' || props || '}'"
)
ANSWER = (
    f"CASE event_id % 8 WHEN 0 THEN {_BODY} WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || {_BODY} || chr(10) || '```' "
    f"WHEN 2 THEN 'Sure. ' || {_BODY} || ' Done.' WHEN 3 THEN 'not json: [' || event_type || '] at all' "
    f"WHEN 4 THEN '[1, 2, 3]' WHEN 5 THEN '```' || {_BODY} || '``` and more' WHEN 6 THEN '  ' || props || '  ' ELSE '{{}}[]' END"
)


def answers(spark, sf):
    events = d.spread(d.table(spark, sf, "events"), "event_id")
    return events.selectExpr("event_id", f"{ANSWER} AS raw").withColumn(
        "parsed", generation.parse_answer(F.col("raw"))
    )


def json_cascade(spark, sf):
    field = lambda name, kind: generation.answer_field(F.col("parsed"), name, kind)
    return answers(spark, sf).select(
        "event_id",
        F.coalesce(field("answer_summary", "string"), F.lit(generation.DEFAULT_SUMMARY)).alias("answer_summary"),
        F.coalesce(field("confidence", "string"), F.lit("medium")).alias("confidence"),
        joined(field("chunks_used", "array<int>").cast("array<string>")).alias("chunks_used"),
        generation.useful_answer(F.col("parsed")).alias("useful"),
        generation.badge(F.lit("blocked"), F.col("parsed")).alias("badge"),
    )


def lowest_confidence(spark, sf):
    labels = ("high", "medium", "low", "blocked", "unsure")
    pairs = d.table(spark, sf, "events").selectExpr(
        "event_id",
        f"{d.pick(labels, 'event_id % 5')} AS answer_label",
        f"{d.pick(labels, 'user_id % 5')} AS detector_label",
    )
    return pairs.select(
        "event_id", generation.lowest_confidence(F.col("answer_label"), F.col("detector_label")).alias("confidence")
    )


def citations(spark, sf):
    """Chunk numbers 0 to 3, some out of range and some repeated, resolved against each case's chunks."""
    numbers = F.expr("transform(sequence(0, 3), i -> CAST((length(query) + i * i) % 4 AS INT))")
    cited = cases(spark, sf).withColumn("c", generation.cite(numbers, F.col("chunks")))
    return cited.select("query_id", F.posexplode("c").alias("pos", "c")).select(
        "query_id", "pos", "c.chunk_num", "c.source_title", "c.section_ref", "c.jurisdiction", "c.effective_date", "c.text_preview"
    )


def generate_mock(spark, sf):
    """The whole answer stage over the cases, with the built-in provider."""
    responses = generation.generate_answers(cases(spark, sf))
    return response_columns(responses)


def response_columns(responses):
    warning = F.create_map(*[F.lit(x) for k, v in checking.WARNINGS.items() for x in (v, k)])
    return responses.select(
        "query_id",
        "query_type",
        "jurisdiction",
        "confidence",
        F.round("confidence_score", 6).alias("confidence_score"),
        F.element_at(warning, F.col("user_warning")).alias("warning"),
        "requires_escalation",
        "is_blocked",
        F.when(F.col("block_reason") == "", "").otherwise("blocked").alias("block"),
        joined(F.col("chunks_used").cast("array<string>")).alias("chunks_used"),
        joined(F.transform("citations", lambda c: c["source_title"])).alias("cited"),
        F.when(F.col("is_blocked"), "warning").otherwise(F.col("answer_summary")).alias("summary"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        query_classify,
        classify_documents,
        escalation,
        ref_grounding,
        numeric_grounding,
        answer_report,
        report_before_answer,
        flag_details,
        detector_log,
        prompt_build,
        json_cascade,
        lowest_confidence,
        citations,
        generate_mock,
    )
}


# -- SQL -------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def classify_sql(column: str) -> str:
    q = f"lower({column})"
    return (
        f"CASE WHEN {any_of(q, ('exempt', 'exempted', 'exemption', 'permission needed', 'do i need', 'require permission', 'need planning', 'without permission', 'shed', 'solar', 'fence', 'gate', 'attic', 'garage conversion', 'porch'))} THEN 'EXEMPTION' "
        f"WHEN {any_of(q, ('need planning', 'require planning', 'planning permission for', 'do i need permission', 'is permission required', 'extension', 'conservatory', 'outbuilding'))} THEN 'ELIGIBILITY' "
        f"WHEN {any_of(q, ('how do i apply', 'how to apply', 'application process', 'how long does', 'appeal', 'timeline', 'what documents', 'how much does', 'planning fee', 'submit', 'observation'))} THEN 'PROCESS' "
        "ELSE 'ELIGIBILITY' END"
    )


def pattern_sql(column: str) -> str:
    topics = (
        "appeal", "an bord plean", "an coimisi", "enforcement", "unauthorised development",
        "section 5 declaration", "judicial review", "compensation", "injunction",
    )
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{t}') THEN '{t}'" for t in topics) + " ELSE '' END"


CHUNK_FIELDS_SQL = (
    "{'text': text, 'chunk_id': chunk_id, 'source_title': source_title, 'section_ref': coalesce(section_ref, ''), "
    "'jurisdiction': jurisdiction, 'confidence': confidence, 'effective_date': coalesce(strftime(effective_date, '%Y-%m-%d'), ''), "
    "'is_stale': is_stale, 'old': needs_reverification, 'ents': " + ENTITIES_SQL + "}"
)
CASES_CTES = f"""
docs AS (SELECT chunk_index AS n, {CHUNK_FIELDS_SQL} AS c FROM ({d.FRESH_SQL})),
turns AS (SELECT {d.select_sql(CASE)} FROM conversations),
cases AS (
  SELECT t.* EXCLUDE (first_doc, second_doc), list_filter([a.c, b.c], lambda c: c IS NOT NULL) AS chunks
  FROM turns t LEFT JOIN docs a ON a.n = t.first_doc LEFT JOIN docs b ON b.n = t.second_doc
)"""
NUMBERS_SQL = "flatten([" + ", ".join(
    f"regexp_extract_all(generated, '{p}', 0, 'i')"
    for p in (
        "\\d+\\s*square\\s*metres?", "\\d+\\s*sq\\.?\\s*m", "\\d+\\s*metres?\\s*high", "\\d+\\s*metres?\\s*from",
        "\\d+\\s*weeks?", "\\d+\\s*days?",
    )
) + "])"
REFS_SQL = "regexp_extract_all(generated, '(?:class|section|article|schedule)\\s+\\d+[A-Z]?|S\\.I\\.\\s*No\\.\\s*\\d+\\s*of\\s*\\d{4}', 0, 'i')"


def report_ctes(source: str, name: str = "report", prefix: str = "") -> str:
    """Checks of a relation with query, generated, chunks, quality and hit counts."""
    return f"""
{prefix}found AS (
  SELECT *, list_distinct(flatten(list_transform(chunks, lambda c: c.ents))) AS entities,
    lower(array_to_string(list_transform(chunks, lambda c: c.text), ' ')) AS context_text, {pattern_sql('query')} AS pattern,
    {REFS_SQL} AS all_refs, {NUMBERS_SQL} AS all_numbers,
    len(list_filter(chunks, lambda c: c.is_stale)) AS n_stale, len(list_filter(chunks, lambda c: c.old)) AS n_old
  FROM {source}
),
{prefix}missed AS (
  SELECT *, list_filter(all_refs, lambda r: len(list_filter(entities, lambda e: contains(e, lower(r)))) = 0) AS refs,
    list_filter(all_numbers, lambda m: NOT contains(context_text, lower(m))) AS numbers
  FROM {prefix}found
),
{prefix}flagged AS (
  SELECT *, CASE WHEN len(chunks) = 0
    THEN [{{'code': 'NO_CHUNKS_RETRIEVED', 'severity': 'block', 'detail': 'Query: ' || left(query, 80)}}]
    ELSE list_concat(list_filter([
      CASE WHEN retrieval_quality < 0.3::DOUBLE THEN {{'code': 'LOW_RETRIEVAL_QUALITY', 'severity': 'warning', 'detail': 'Quality score: ' || printf('%.2f', retrieval_quality)}} END,
      CASE WHEN total_dense_hits = 0 OR total_sparse_hits = 0 THEN {{'code': 'SINGLE_METHOD_RETRIEVAL', 'severity': 'warning', 'detail': 'Dense: ' || total_dense_hits || ' | Sparse: ' || total_sparse_hits}} END,
      CASE WHEN n_stale > 0 THEN {{'code': 'STALE_CHUNKS_IN_CONTEXT', 'severity': 'block', 'detail': n_stale || ' stale chunks detected'}} END,
      CASE WHEN n_old > 0 THEN {{'code': 'CHUNKS_NEED_REVERIFICATION', 'severity': 'warning', 'detail': n_old || ' chunks not verified in 30+ days'}} END,
      CASE WHEN pattern <> '' THEN {{'code': 'ESCALATION_REQUIRED', 'severity': 'escalate', 'detail': 'Pattern matched: ' || pattern}} END,
      CASE WHEN len(refs) > 0 THEN {{'code': 'UNGROUNDED_SECTION_REFERENCE', 'severity': 'warning', 'detail': 'Ungrounded: [''' || array_to_string(list_slice(refs, 1, 5), ''', ''') || ''']'}} END
    ], lambda f: f IS NOT NULL), list_transform(numbers, lambda m: {{'code': 'UNGROUNDED_NUMERIC_THRESHOLD', 'severity': 'warning',
      'detail': 'The answer contains ''' || m || ''', the retrieved chunks do not'}})) END AS flags,
    CASE WHEN len(chunks) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_concat(refs, numbers) END AS claims,
    len(chunks) > 0 AND pattern <> '' AS escalates, len(chunks) = 0 OR n_stale > 0 AS is_blocked
  FROM {prefix}missed
),
{prefix}scored AS (
  SELECT *, CASE WHEN len(chunks) = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE,
    list_reduce(list_transform(flags, lambda f: CASE f.severity WHEN 'escalate' THEN 0.15::DOUBLE WHEN 'block' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END),
      lambda acc, x: acc - x, retrieval_quality) - 0.08::DOUBLE * len(claims)
    + CASE WHEN retrieval_quality > 0.6::DOUBLE THEN 0.05::DOUBLE ELSE 0 END)) END AS score
  FROM {prefix}flagged
),
{prefix}labelled AS (
  SELECT *, CASE WHEN score >= 0.75::DOUBLE THEN 'high' WHEN score >= 0.5::DOUBLE THEN 'medium' WHEN score >= 0.3::DOUBLE THEN 'low' ELSE 'blocked' END AS label
  FROM {prefix}scored
),
{name} AS (
  SELECT *, CASE WHEN is_blocked THEN 'blocked' WHEN escalates THEN 'escalation' WHEN label IN ('low', 'medium') THEN label ELSE 'default' END AS warning,
    CASE WHEN is_blocked THEN 'BLOCKED' WHEN escalates THEN 'ESCALATE' ELSE 'OK' END AS status
  FROM {prefix}labelled
)"""


REPORT_COLUMNS_SQL = """query_id, round(score, 6) AS confidence_score, label AS confidence_label,
  array_to_string(list_transform(flags, lambda f: f.code), '; ') AS codes,
  array_to_string(list_transform(flags, lambda f: f.severity), '; ') AS severities, array_to_string(claims, '; ') AS claims,
  escalates AS requires_escalation,
  CASE WHEN escalates THEN 'Query involves ''' || pattern || ''' — formal legal process' ELSE '' END AS escalation_reason,
  CAST(len(chunks) AS INTEGER) AS chunks_used, is_blocked, warning, status"""
_BARE = "(SELECT * REPLACE ('' AS generated) FROM cases)"
_TASK = {k: quoted(v) for k, v in prompts._TASKS.items()}
CONTEXT_SQL = f"""
coalesce((SELECT string_agg({BLOCK_SQL.replace("strftime(effective_date, '%Y-%m-%d')", "nullif(effective_date, '')")}, chr(10) || chr(10) ORDER BY rank)
  FROM (SELECT unnest(chunks, recursive := true), generate_subscripts(chunks, 1) AS rank)), 'No relevant planning law chunks found.')"""
_CLEAN = f"trim(raw, {d.WS})"


def _object(expr: str) -> str:
    return f"try_cast({expr} AS JSON)"


PARSE_CTES = f"""
raws AS (SELECT event_id, {ANSWER} AS raw FROM events),
tried AS (
  SELECT event_id, raw, coalesce({_object(_CLEAN)},
    {_object("nullif(trim(regexp_extract(raw, '```(?:json)?\\s*([\\s\\S]*?)```', 1), " + d.WS + "), '')")},
    {_object("nullif(regexp_extract(raw, '\\{[\\s\\S]*\\}', 0), '')")}) AS value FROM raws
),
parsed AS (
  SELECT event_id, raw, CASE WHEN json_type(value) = 'OBJECT' THEN value END AS body,
    trim(regexp_replace(left(raw, 300), '[{{}}\\[\\]]', '', 'g'), {d.WS}) AS stripped FROM tried
)"""
_LEVEL = "CASE {c} WHEN 'high' THEN 3 WHEN 'low' THEN 1 WHEN 'blocked' THEN 0 ELSE 2 END"
_LABEL = "CASE least({a}, {b}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'blocked' END"
_ALL = ("high", "medium", "low", "blocked", "unsure")

MOCKS = {
    "ELIGIBILITY": providers.MOCK_ELIGIBILITY,
    "EXEMPTION": providers.MOCK_EXEMPTION,
    "PROCESS": providers.MOCK_PROCESS,
}


def by_class(values: dict[str, str]) -> str:
    return "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


MOCK_TEXT_SQL = by_class({k: quoted(json.dumps(v)) for k, v in MOCKS.items()})
RESPONSE_SQL = f"""
SELECT query_id, CASE WHEN is_blocked THEN 'OTHER' ELSE class END AS query_type,
  CASE WHEN is_blocked THEN 'national' ELSE council END AS jurisdiction,
  CASE WHEN is_blocked THEN 'blocked' ELSE {_LABEL.format(a=_LEVEL.format(c="label"), b=_LEVEL.format(c=by_class({k: quoted(v["confidence"]) for k, v in MOCKS.items()})))} END AS confidence,
  round(CASE WHEN is_blocked THEN pre_score ELSE score END, 6) AS confidence_score, warning,
  is_blocked OR escalates AS requires_escalation, is_blocked, CASE WHEN is_blocked THEN 'blocked' ELSE '' END AS block,
  CASE WHEN is_blocked THEN '' ELSE {by_class({k: quoted("; ".join(map(str, v["chunks_used"]))) for k, v in MOCKS.items()})} END AS chunks_used,
  CASE WHEN is_blocked THEN '' ELSE coalesce(array_to_string(list_transform(list_slice(chunks, 1, {by_class({k: str(len(v["chunks_used"])) for k, v in MOCKS.items()})}), lambda c: c.source_title), '; '), '') END AS cited,
  CASE WHEN is_blocked THEN 'warning' ELSE {by_class({k: quoted(v["answer_summary"]) for k, v in MOCKS.items()})} END AS summary"""


def response_ctes(source: str) -> str:
    """Reports before and after the mock answer over a relation of cases."""
    return f"""
{report_ctes(f"(SELECT * REPLACE ('' AS generated) FROM {source})", "pre", "pre_")},
asked AS (
  SELECT c.* EXCLUDE (generated), class, {MOCK_TEXT_SQL} AS generated, p.score AS pre_score
  FROM (SELECT *, {classify_sql('query')} AS class FROM {source}) c JOIN (SELECT query_id, score FROM pre) p USING (query_id)
),
{report_ctes("asked", "post", "post_")}"""


SQL = {
    "query_classify": f"SELECT conv_id, turn, {classify_sql('query')} AS query_type FROM (SELECT conv_id, turn, {d.TURN_QUERY} AS query FROM conversations)",
    "classify_documents": f"SELECT {classify_sql('text')} AS query_type, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "escalation": f"SELECT conv_id, turn, {pattern_sql('query')} AS pattern FROM (SELECT conv_id, turn, {d.TURN_QUERY} AS query FROM conversations)",
    "ref_grounding": f"WITH {CASES_CTES}, {report_ctes('cases')} SELECT query_id, array_to_string(refs, '; ') AS ungrounded FROM report",
    "numeric_grounding": f"WITH {CASES_CTES}, {report_ctes('cases')} SELECT query_id, array_to_string(numbers, '; ') AS ungrounded FROM report",
    "answer_report": f"WITH {CASES_CTES}, {report_ctes('cases')} SELECT {REPORT_COLUMNS_SQL} FROM report",
    "report_before_answer": f"WITH {CASES_CTES}, {report_ctes(_BARE)} SELECT {REPORT_COLUMNS_SQL} FROM report",
    "flag_details": f"""
WITH {CASES_CTES}, {report_ctes('cases')}, rows_ AS (
  SELECT query_id, CAST(generate_subscripts(flags, 1) - 1 AS INTEGER) AS pos, unnest(flags) AS f FROM report)
SELECT query_id, pos, f.code AS code, f.severity AS severity, f.detail AS detail FROM rows_""",
    "detector_log": f"""
WITH {CASES_CTES}, {report_ctes('cases')} SELECT status, count(*) AS n, CAST(sum(len(flags)) AS BIGINT) AS n_flags,
  CAST(sum(len(claims)) AS BIGINT) AS n_claims, round(avg(score), 6) AS mean_confidence FROM report GROUP BY status""",
    "prompt_build": f"""
WITH {CASES_CTES}, built AS (
  SELECT query_id, class, {quoted(prompts._HEAD[0])} || {CONTEXT_SQL} || {quoted(prompts._HEAD[1])} || query || {quoted(prompts._HEAD[2])} || council
    || {by_class(_TASK)} AS prompt FROM (SELECT *, {classify_sql('query')} AS class FROM cases))
SELECT query_id, class AS query_type, CAST(length(prompt) AS INTEGER) AS n_chars, md5(prompt) AS prompt_md5 FROM built""",
    "json_cascade": f"""
WITH {PARSE_CTES} SELECT event_id,
  CASE WHEN body IS NOT NULL THEN coalesce(body->>'$.answer_summary', 'No summary available.')
    WHEN stripped = '' THEN {quoted(generation.FALLBACK_SUMMARY)} ELSE stripped END AS answer_summary,
  CASE WHEN body IS NOT NULL THEN coalesce(body->>'$.confidence', 'medium') ELSE 'low' END AS confidence,
  CASE WHEN body IS NOT NULL THEN coalesce(array_to_string(CAST(body->'$.chunks_used' AS INTEGER[]), '; '), '') ELSE '1' END AS chunks_used,
  CASE WHEN body IS NOT NULL THEN len(json_keys(body)) > 1 ELSE true END AS useful,
  CASE WHEN body IS NOT NULL AND len(json_keys(body)) = 0 THEN 'blocked' ELSE 'low' END AS badge FROM parsed""",
    "lowest_confidence": f"""
SELECT event_id, {_LABEL.format(a=_LEVEL.format(c='answer_label'), b=_LEVEL.format(c='detector_label'))} AS confidence
FROM (SELECT event_id, {d.pick(_ALL, 'event_id % 5')} AS answer_label, {d.pick(_ALL, 'user_id % 5')} AS detector_label FROM events)""",
    "citations": f"""
WITH {CASES_CTES}, numbered AS (
  SELECT query_id, chunks, list_filter(list_transform([0, 1, 4, 9], lambda i: (length(query) + i) % 4), lambda i: i >= 1 AND i <= len(chunks)) AS used FROM cases
), rows_ AS (
  SELECT query_id, chunks, CAST(generate_subscripts(used, 1) - 1 AS INTEGER) AS pos, CAST(unnest(used) AS INTEGER) AS chunk_num FROM numbered
), picked AS (SELECT query_id, pos, chunk_num, chunks[chunk_num] AS c FROM rows_)
SELECT query_id, pos, chunk_num, c.source_title AS source_title, c.section_ref AS section_ref, c.jurisdiction AS jurisdiction,
  c.effective_date AS effective_date, left(c.text, 120) || '...' AS text_preview FROM picked""",
    "generate_mock": f"WITH {CASES_CTES}, {response_ctes('cases')} {RESPONSE_SQL} FROM post",
}
