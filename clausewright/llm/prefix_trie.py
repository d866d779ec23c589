"""A trie of conversation prefixes, its subtree totals found by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is a pair of 64-bit hashes
of sums over its turns' hashes, each taken together with the turn's place, so
that keys come from running sums, which long conversations add up in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.sizing import at_most, broadcast_when, materialise

BLOCK = 1024  # turns of a conversation that one window adds up
ENDS_BITS = 12  # conversation ids that differ in these low bits only are joined to one string first
BROADCAST_ROWS = 500_000
BUSY = 1000  # children from which a parent's row is sent to all tasks instead of its children to one
VALUES = ["n_leaves", "saved_tokens"]


def turn_positions(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: turns numbered from 1 in each conversation.

    Turns come by ``turn``, NULL first, equal ones by role and text. NULL roles and texts are empty. Rows with a NULL
    ``conv_id`` belong to no conversation and are left out. Rows are dealt out by ranges of the whole order, so a long
    conversation is numbered by many tasks.
    """
    empty = F.lit("")
    plain = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    first = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = materialise(plain.repartitionByRange(*first, F.substring("text", 1, 32)).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", "conv_id").orderBy(*first[1:], "text")
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "_range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    before = before.where("before > 0").drop("n")  # one row at most for each range but the first
    numbered = dealt.withColumn("place", F.row_number().over(own)).join(F.broadcast(before), ["conv_id", "_range"], "left")
    return numbered.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "role", "text")


def turns_and_lengths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns with their conversation's ``n_turns``, and ``conv_id, n_turns`` of all conversations."""
    turns = materialise(turn_positions(rows))
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    return turns.join(broadcast_when(at_most(sizes, BROADCAST_ROWS), sizes), "conv_id"), sizes


def with_shared_heads(rows: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are replaced by those of conversation ``base``, all it has if fewer.

    ``head`` (below 8) and ``base`` are expressions of ``conv_id``. Returns what ``turns_and_lengths`` returns, with
    conversations left without a turn in the second frame only.
    """
    turns, sizes = turns_and_lengths(rows)
    turns = turns.drop("n_turns")
    plan = sizes.select("conv_id", F.col("n_turns").alias("own"), head.cast("long").alias("head"), base.cast("long").alias("base"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there"))
    plan = plan.join(there, "base", "left").withColumn("shared", F.least("head", F.coalesce("there", F.lit(0).cast("long"))))
    plan = plan.withColumn("n_turns", F.col("shared") + F.greatest(F.col("own") - F.col("head"), F.lit(0).cast("long")))
    plan = materialise(plan.select("conv_id", "head", "base", "shared", "n_turns"))
    planned = broadcast_when(at_most(plan, BROADCAST_ROWS), plan)
    tails = turns.join(planned, "conv_id").where("position > head")
    tails = tails.select("conv_id", (F.col("position") - F.col("head") + F.col("shared")).alias("position"), "role", "text", "n_turns")
    first = turns.where("position < 8").withColumnRenamed("conv_id", "base")
    heads = plan.join(first, "base").where("position <= shared").select("conv_id", "position", "role", "text", "n_turns")
    return tails.unionByName(heads), plan.select("conv_id", "n_turns")


def node_keys(turns: DataFrame) -> DataFrame:
    """Adds to each turn the key ``a, b`` of the prefix that it ends, and that of the prefix before it, ``pa, pb``."""
    parts = []
    for k in (1, 2):
        own = F.xxhash64(F.lit(k), "position", "role", "text")
        parts += [own.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(own, 32)]
    names = [f"s{k}" for k in range(4)]
    hashed = turns.select("*", *(p.alias(n) for p, n in zip(parts, names)), F.floor((F.col("position") - 1) / BLOCK).alias("block"))
    sums = hashed.groupBy("conv_id", "block").agg(*(F.sum(n).alias(n) for n in names))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("conv_id", "block", *(F.sum(n).over(earlier).alias(f"b{n}") for n in names)).where("block > 0")
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    out = hashed.join(earlier, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    before = {n: F.coalesce(F.sum(n).over(running), zero) + F.coalesce(f"b{n}", zero) for n in names}
    out = out.select("*", *(c.alias(f"p{n}") for n, c in before.items()))
    key = lambda depth, i, j: F.xxhash64(depth, i, j)
    after = [F.col(n) + F.col(f"p{n}") for n in names]
    place = F.col("position")
    return out.select(
        "conv_id", place.alias("depth"), "text", "n_turns",
        key(place, after[0], after[1]).alias("a"), key(place, after[2], after[3]).alias("b"),
        key(place - 1, F.col("ps0"), F.col("ps1")).alias("pa"), key(place - 1, F.col("ps2"), F.col("ps3")).alias("pb"),
    )


def root_key() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [F.xxhash64(zero, zero, zero).alias("a"), F.xxhash64(zero, zero, zero).alias("b")]


def id_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: the digest of each node's ``conv_id`` values, ascending, joined by commas.

    Ids are first joined in groups of at most 4,096; a node's joined groups are then streamed through the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        out: list[list] = [[], [], []]
        key = digest = None

        def full() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()))]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "ends_sha256"])

        def close() -> None:
            for column, value in zip(out, (*key, digest.hexdigest())):
                column.append(value)

        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (a, b) == key:
                    digest.update(b",")
                else:
                    if key:
                        close()
                    key, digest = (a, b), sha256()
                digest.update(ids.encode())
            if out[0]:
                yield full()
        if key:
            close()
            yield full()

    group = F.shiftright("conv_id", ENDS_BITS).alias("group")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("a", "b", group).agg(joined.alias("ids"))
    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "group")
    return ordered.select("a", "b", "ids").mapInArrow(run, "a long, b long, ends_sha256 string")


def compress(unary: DataFrame, values: list[str]) -> DataFrame:
    """For each node with one child: the first node below it with none or several, and the sums on the way to there.

    ``unary``: ``a, b``, the only child's key ``na, nb``, values. Every round doubles the way that a node sees.
    """
    jump = materialise(unary.select("a", "b", "na", "nb", *values, F.lit(True).alias("open")))
    while not jump.where("open").isEmpty():
        step = jump.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), *(F.col(v).alias(f"m{v}") for v in values))
        met = jump.where("open").join(step, ["na", "nb"], "left")
        moved = met.select(
            "a", "b", F.coalesce("ma", "na").alias("na"), F.coalesce("mb", "nb").alias("nb"),
            *((F.col(v) + F.coalesce(f"m{v}", F.lit(0).cast("long"))).alias(v) for v in values), F.col("ma").isNotNull().alias("open"),
        )
        jump = materialise(moved.unionByName(jump.where("NOT open")))
    return jump.drop("open")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of values over the subtree of every node, by contraction of the tree and expansion in reverse.

    ``nodes``: ``a, b``, the parent's key ``pa, pb`` (NULL at a root), values (long). Every round compresses all unary
    chains, then rakes the leaves into their parents, which leaves at most half of the leaves; the rounds grow with the
    logarithm of the nodes, however deep the tree. Joins are by keys that are unique on both sides, sums over children
    are combined before they are shuffled. Returns ``a, b`` and the totals.
    """
    live = nodes.select("a", "b", "pa", "pb", *values)
    raked, chains = [], []
    while not live.isEmpty():
        kids = live.where("pa IS NOT NULL").groupBy("pa", "pb").agg(F.count("*").alias("n"), F.min("a").alias("na"), F.min("b").alias("nb"))
        kids = kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n", "na", "nb")
        marked = materialise(live.join(kids, ["a", "b"], "left"))
        unary, rest = marked.where("n = 1"), marked.where("n IS NULL OR n > 1")
        adds = rest.limit(0).select("pa", "pb", *values)
        if not unary.isEmpty():
            jump = compress(unary, values)
            chains.append(jump)
            below = unary.select(F.col("na").alias("a"), F.col("nb").alias("b"))
            tops = unary.select("a", "b", "pa", "pb").join(below, ["a", "b"], "left_anti").join(jump, ["a", "b"])
            tops = materialise(tops.select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("pa").alias("ta"), F.col("pb").alias("tb"), *values))
            adds = tops.select(F.col("ta").alias("pa"), F.col("tb").alias("pb"), *values)
            met = rest.join(tops.select("a", "b", "ta", "tb", F.lit(True).alias("hung")), ["a", "b"], "left")
            parent = [F.when(F.col("hung"), F.col(t)).otherwise(F.col(p)).alias(p) for t, p in (("ta", "pa"), ("tb", "pb"))]
            rest = materialise(met.select("a", "b", *parent, *values, "n"))
        leaves = rest.where("n IS NULL")
        raked.append(leaves.select("a", "b", *values))
        adds = adds.unionByName(leaves.select("pa", "pb", *values)).where("pa IS NOT NULL")
        adds = adds.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*(F.sum(v).alias(f"m{v}") for v in values))
        sums = [(F.col(v) + F.coalesce(f"m{v}", F.lit(0).cast("long"))).alias(v) for v in values]
        live = materialise(rest.where("n > 1").join(adds, ["a", "b"], "left").select("a", "b", "pa", "pb", *sums))
    if not raked:
        return nodes.select("a", "b", *values)
    totals = reduce(DataFrame.unionByName, raked)
    for jump in reversed(chains):
        found = totals.select(F.col("a").alias("na"), F.col("b").alias("nb"), *(F.col(v).alias(f"m{v}") for v in values))
        back = jump.join(found, ["na", "nb"]).select("a", "b", *((F.col(v) + F.col(f"m{v}")).alias(v) for v in values))
        totals = materialise(totals.unionByName(back))
    return totals


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of all conversation prefixes, a row for each node.

    ``turns``: ``conv_id, position`` (1, 2, ...), ``role``, ``text``, ``n_turns`` of the conversation, none of them NULL;
    ``members``: ``conv_id, n_turns``, turnless conversations included. Both as ``turns_and_lengths`` gives them, which
    also says what becomes of NULLs, ties and repeated rows. Other columns are ignored.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``,
    ``n_leaves``, ``saved_tokens`` (words that the subtree's nodes save by being kept once) and ``ends_sha256`` (digest of
    the members that end there). The root has depth 0; without any member there is no node.
    """
    rows = node_keys(turns.select("conv_id", F.col("position").cast("long"), "role", "text", "n_turns"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = materialise(rows.select("conv_id", "depth", "n_turns", "a", "b", "pa", "pb", words.alias("words")))
    first = [F.first(c).alias(c) for c in ("depth", "pa", "pb", "words")]
    inner = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *first)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.min(F.col("conv_id").cast("long")).alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("*", *root_key(), zero.alias("depth"), none.alias("pa"), none.alias("pb"), zero.alias("words"))
    nodes = inner.unionByName(root)
    kids = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves")
    nodes = materialise(nodes.select("*", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    totals = subtree_totals(nodes, VALUES)
    last = rows.where("depth = n_turns").select("a", "b", "conv_id")
    ends = id_digests(last.unionByName(members.where("n_turns = 0").select(*root_key(), F.col("conv_id").cast("long"))))
    out = with_parents(nodes.drop(*VALUES, "words")).join(totals, ["a", "b"]).join(ends, ["a", "b"], "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *VALUES, digest)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``. Parents with many children are sent to all tasks, as far as these parents are few."""
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    busy = parents.where(F.col("n_children") >= BUSY).drop("n_children")
    if not at_most(busy, BROADCAST_ROWS):
        return nodes.join(parents.drop("n_children"), ["pa", "pb"], "left")
    found = nodes.join(F.broadcast(busy), ["pa", "pb"], "left")
    rest = found.where("parent_conv_id IS NULL").drop("parent_conv_id")
    rest = rest.join(parents.where(F.col("n_children") < BUSY).drop("n_children"), ["pa", "pb"], "left")
    return found.where("parent_conv_id IS NOT NULL").unionByName(rest)
