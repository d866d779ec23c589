"""Fingerprints of documents: one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions are used. A text's words (runs of characters other
than ASCII white space) give shingles; each shingle is hashed once and falls
into the bin named by its top bits, where the smallest hash stays. An empty bin
walks its own fixed sequence of bins and copies the first one that was filled.
The lowest ``LOW`` bits of each bin are packed into longs and written as hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.ordering import positions
from clausewright.operators.sizing import materialise

WORDS = 5
BITS = 8  # 256 bins
LOW = 4  # bits kept of each bin
PROBES = ((0, 7), (8, 47), (48, 255))  # the walk of an empty bin, in stages
NIBBLES = 0x1111111111111111


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the packed bins (an array of longs) of a text column; no words (or NULL): an empty array.

    A text with fewer words than a shingle has its whole sequence as one.
    """
    tmp = ("_words", "_hashes", "_least", "_bins")
    walk = "(hash(i, 1) & 255) + t * ((hash(i, 2) & 255) | 1)"
    tries = [f"get(filter(transform(sequence({a}, {b}), t -> get(_bins, ({walk}) & 255)), v -> v IS NOT NULL), 0)" for a, b in PROBES]
    df = df.withColumn("_words", F.expr(rf"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    df = df.withColumn(
        "_hashes",
        F.expr(
            f"CASE WHEN size(_words) = 0 THEN array() ELSE sort_array(transform(sequence(0, greatest(size(_words) - {WORDS}, 0)), "
            f"i -> xxhash64(slice(_words, i + 1, {WORDS})))) END"
        ),
    )
    df = df.withColumn("_least", F.expr("filter(_hashes, (x, i) -> i = 0 OR shiftright(x, 56) <> shiftright(get(_hashes, i - 1), 56))"))
    gap = "CAST(coalesce(shiftright(get(_least, i + 1), 56), 128) - shiftright(x, 56) - 1 AS INT)"
    df = df.withColumn(
        "_bins",
        F.expr(
            "CASE WHEN size(_least) = 0 THEN array() ELSE concat(array_repeat(CAST(NULL AS BIGINT), CAST(shiftright(get(_least, 0), 56) + 128 AS INT)), "
            f"flatten(transform(_least, (x, i) -> concat(array(x), array_repeat(CAST(NULL AS BIGINT), {gap}))))) END"
        ),
    )
    df = df.withColumn("_bins", F.expr(f"transform(_bins, (x, i) -> coalesce(x, {', '.join(tries)}))"))
    packed = (
        f"CASE WHEN size(_bins) = 0 THEN array() ELSE transform(sequence(0, 15), g -> aggregate(slice(_bins, g * 16 + 1, 16), 0L, "
        f"(p, x) -> shiftleft(p, {LOW}) | (x & {(1 << LOW) - 1}))) END"
    )
    return df.withColumn(out, F.expr(packed)).drop(*tmp)


def as_text(packed: str) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity from two packed fingerprints, 0 to 1.

    Bins of different sets agree by chance in one of ``2 ** LOW`` cases; the share of equal bins is corrected for that.
    Two empty sets are alike (1), an empty and another one are not (0).
    """
    z = "(x ^ y)"
    differ = f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {NIBBLES}L)"
    share = F.expr(f"1 - aggregate(zip_with({a}, {b}, (x, y) -> {differ}), 0, (s, d) -> s + d) / 256")
    chance = 0.5**LOW
    estimate = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 0, estimate).when(empty == 2, 1.0).otherwise(0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and of how alike they are.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. The edited text is the text with its last quarter
    (code points, rounded down) replaced by as many from the start of the next document's, or by all of that if it is
    shorter. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next greater ``doc_id``, the first after the last one; NULL counts as the
    smallest. Rows that share a ``doc_id`` have the same next document, and as somebody's next they count with their
    smallest text and fingerprint. A single document is its own next. NULL is an empty text: no words, an empty
    fingerprint. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    ordered = materialise(positions(ids, "doc_id"))
    n = ordered.count()
    after = ordered.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("position") - 1, F.lit(max(n, 1))).alias("position"))
    follows = materialise(ordered.select(F.col("doc_id").alias("own_id"), "need", "position").join(after, "position"))
    heads = texts.join(follows, F.col("doc_id").eqNullSafe(F.col("next_id")))
    heads = heads.select("own_id", F.substring("text", F.lit(1), F.col("need")).alias("head"))
    heads = heads.groupBy("own_id").agg(F.min("head").alias("head"))
    both = texts.join(heads, F.col("doc_id").eqNullSafe(F.col("own_id")))
    quarter = F.floor(F.length("text") / 4).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - quarter)
    both = both.select("doc_id", "text", F.concat(kept, F.substring("head", F.lit(1), quarter)).alias("edited"))
    both = with_fingerprint(with_fingerprint(both, "text", "packed"), "edited", "edited_packed")
    own = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "packed", "edited_packed")
    own = materialise(own)
    after = own.select(F.col("doc_id").alias("next_id"), "packed").join(follows.select("own_id", F.col("next_id").alias("to")), F.col("next_id").eqNullSafe(F.col("to")))
    after = after.groupBy("own_id").agg(F.min("packed").alias("next_packed"))
    out = own.join(after, F.col("doc_id").eqNullSafe(F.col("own_id")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("packed").alias("fingerprint"),
        as_text("edited_packed").alias("edited_fingerprint"),
        likeness("packed", "edited_packed").alias("near_edited"),
        likeness("packed", "next_packed").alias("near_next"),
    )
