"""Joins with a table of distinct keys, some of which very many rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators.sizing import at_most

BROADCAST_ROWS = 500_000  # keys and a few numbers each; more are joined by shuffling
BUSY = 1000  # rows from which a key's entry is sent to all tasks instead of its rows to one


def join_distinct(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table that has one entry for each key; ``weight`` is its column with the number of rows.

    ``how`` is ``inner`` or ``left_anti``. A small table is broadcast. Of a larger one, the entries that at least
    ``BUSY`` rows have are broadcast, if few enough, so that only keys with few rows are joined by shuffling.
    """
    if at_most(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(table), keys, how)
    busy = table.where(F.col(weight) >= BUSY)
    if not at_most(busy, BROADCAST_ROWS):
        return rows.join(table, keys, how)
    rest = table.where(F.col(weight) < BUSY)
    if how == "left_anti":
        return rows.join(F.broadcast(busy), keys, how).join(rest, keys, how)
    common = rows.join(F.broadcast(busy), keys)
    others = rows.join(F.broadcast(busy), keys, "left_anti").join(rest, keys)
    return common.unionByName(others)
