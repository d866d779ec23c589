"""Mixing sources to target weights: repetition rates by source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.ordering import positions
from clausewright.operators.sizing import at_most, materialise

WEIGHTS = (1, 2, 3)  # by the order of the sources, repeating
MOST = 3  # times a source's or a document's size
SEEDS = 32  # of which each source takes the one whose draw comes nearest to its target
FEW_SOURCES = 10_000  # a plan with more rows than this is joined by shuffling, with salted sources
SALTS = 64
SPAN = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: Column) -> Column:
    """A number from 0 to 1 for a row with the hash halves ``_a`` and ``_b``; pairwise independent between rows."""
    return F.pmod(F.col("_a") + seed * F.col("_b"), F.lit(SPAN)) / F.lit(float(SPAN))


def targets(sources: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to a table ``source, source_size``: all sizes, shared by weight, no source above its limit.

    The weights go to the sources by code point, NULL last. What a source cannot take is shared among the others by
    weight: the common level rises until no source is above its limit. Each step is one sum over the sources.
    """
    ranked = positions(sources, "source", nulls_last=True)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight.cast("double")).withColumn("limit", (most * F.col("source_size")).cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("limit") < F.col("weight") * level
        taken, free = ranked.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        before = level
        level = max(level, (total - taken) / free) if free else level
    return ranked.withColumn("target", F.round(F.least("limit", F.col("weight") * level), 6)).select("source", "source_size", "target")


def join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins a table by source to rows of ``_source``; a large one by salted shuffle, so that a hot source is split."""
    plan = plan.withColumnsRenamed({c: f"_{c}" for c in plan.columns if not c.startswith("_")} | {"source": "_key"})
    if at_most(plan, FEW_SOURCES):
        return rows.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    plan = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.col("_a"), F.lit(SALTS)).cast("int"))
    same = F.col("_source").eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy"))
    return rows.join(plan, same).drop("_key", "_copy", "_salt")


def measured(docs: DataFrame) -> DataFrame:
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = docs.withColumns({"_source": F.col("source"), "_size": word_count(F.col("text")), "_h": digest})
    half = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("long")
    return rows.withColumns({"_a": half(1), "_b": half(9)}).drop("_h")


def mix(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How often each document is emitted so that the sources come near their targets.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. Returns its columns and
    ``size`` (words of the text; NULL: 0), ``source_size``, ``target``, ``rate``
    (target / source size) and ``copies``: floor(rate), and one more with a
    probability equal to the fraction. Columns of these names in ``docs`` are
    replaced. The draw is a hash of ``doc_id`` and text under one of ``SEEDS``
    seeds; a source takes the seed whose draw comes nearest to its target, so
    reruns agree, and rows that are equal are drawn alike. NULL is a source of
    its own. Where all sizes are 0, targets, rates and copies are 0; an empty
    table gives an empty result.
    """
    narrow = materialise(measured(docs.select("doc_id", "text", "source")).select("_source", "_size", "_a", "_b"))
    sources = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    plan = targets(sources, most, weights).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = materialise(plan)
    drawn = join_plan(narrow, plan).withColumn("_part", F.col("_rate") - F.floor("_rate"))
    sums = [F.sum(F.when(draw(F.lit(s)) < F.col("_part"), F.col("_size")).otherwise(0)) for s in range(1, SEEDS + 1)]
    off = F.transform("extra", lambda e: F.abs(e + F.floor("rate") * F.col("source_size") - F.col("target")))
    seeds = drawn.groupBy(F.col("_source").alias("source")).agg(F.array(*sums).alias("extra"))
    joined = plan.join(seeds.withColumnRenamed("source", "_key"), F.col("source").eqNullSafe(F.col("_key"))).drop("_key")
    plan = joined.withColumn("off", off).withColumn("seed", F.array_position("off", F.array_min("off"))).drop("off", "extra")
    out = join_plan(measured(docs), materialise(plan))
    whole = F.floor("_rate")
    copies = whole + F.when(draw(F.col("_seed")) < F.col("_rate") - whole, 1).otherwise(0)
    own = {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "rate": F.col("_rate")}
    own["copies"] = copies.cast("int")
    return out.select(*[c for c in docs.columns if c not in own], *[v.alias(k) for k, v in own.items()])


def emitted(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each document as often as ``mix`` says, with the columns of ``docs``."""
    return mix(docs, most, weights).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)
