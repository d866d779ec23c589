"""Array helpers for long arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 256
SLICE_ITEMS = 1 << 18


def list_slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Parts of a list column with ``SLICE_ITEMS`` items at most, or of one list; work on a part needs little memory."""
    before = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(), dtype=np.int64))
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(before, before[a] + SLICE_ITEMS, "right")) - 1)
        yield lists.slice(a, b - a)
        a = b


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes a value once per row and binds it for ``body``.

    An expression named inside the lambda of another array function may otherwise
    be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_pack(items: Column, joins: Callable[[Column, Column], Column], glue: Callable[[Column, Column], Column]) -> Column:
    """Greedy left-to-right packing of strings.

    A buffer absorbs the next item while ``joins(buffer, item)`` holds, through
    ``glue``; otherwise the buffer is emitted and restarts from the item. Empty
    buffers are not emitted.

    Spark copies a fold's state at every step. The items are therefore folded in
    blocks: within a block the state holds what that block has emitted, and only
    once per block it is appended to everything before.
    """

    def step(acc: Column, item: Column) -> Column:
        page, buf = acc["page"], acc["buf"]
        absorbed = joins(buf, item)
        return F.struct(
            F.when(~absorbed & (buf != ""), F.concat(page, F.array(buf))).otherwise(page).alias("page"),
            F.when(absorbed, glue(buf, item)).otherwise(item).alias("buf"),
        )

    def block_step(acc: Column, block: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("page"), acc["buf"].alias("buf"))
        return let(
            F.aggregate(block, start, step),
            lambda done: F.struct(
                F.concat(acc["pages"], F.array(done["page"])).alias("pages"), done["buf"].alias("buf")
            ),
        )

    def finish(acc: Column) -> Column:
        return F.filter(F.concat(F.flatten(acc["pages"]), F.array(acc["buf"])), lambda s: s != "")

    def fold(bound: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(bound) + 1, F.lit(PAGE)), lambda s: s <= F.size(bound))
        blocks = F.transform(starts, lambda s: F.slice(bound, s, F.lit(PAGE)))
        nothing = F.struct(F.array().cast("array<array<string>>").alias("pages"), F.lit("").alias("buf"))
        return F.aggregate(blocks, nothing, block_step, finish)

    return let(items, fold)


def present(*candidates: Column) -> Column:
    """Array of the candidates that are not NULL, in the given order."""
    return F.filter(F.array(*candidates), lambda c: c.isNotNull())


def l2_normalise(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))

    def scale(length: Column) -> Column:
        return F.transform(
            vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))
        )

    return let(norm, scale)
