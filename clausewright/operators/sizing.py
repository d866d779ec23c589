"""Size checks that decide between a broadcast and a shuffle, and between a scan and a spread."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def at_most(df: DataFrame, rows: int) -> bool:
    """True when the frame has no more than ``rows`` rows; reads at most ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_when(small: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small else df


FEW_VALUES = 256
WORTH_COUNTING = 4  # rows for each value allowed, above which few values are not to be expected


def few_values(df: DataFrame, column: str, most: int = FEW_VALUES, rows_at_most: int | None = None) -> list | None:
    """The distinct values of a column when there are at most ``most`` of them, else None.

    A caller that knows a bound on the rows may give it: far above ``most`` they are not counted, which gives None.
    """
    if rows_at_most is not None and rows_at_most > WORTH_COUNTING * most:
        return None
    rows = df.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def restrict(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Keeps the rows with these values, as a filter that reaches the files; None keeps all rows."""
    if values is None:
        return df
    return df.where(F.col(column).isin(*values)) if values else df.where(F.lit(False))


def spread(df: DataFrame, *keys: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Uses the idle cores when an input has fewer splits than there are task slots.

    Each split is dealt to as many tasks as there are slots, so that tasks do not get longer as splits are added. A
    large input has many more splits than slots and is read as it is. Rows with the same ``keys`` come to one task. ``keep`` selects
    rows before they are dealt.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    kept = keep(df) if keep else df
    return kept.repartition(slots * max(1, splits), *keys) if splits < slots else kept


_WRITTEN: list[tuple[SparkSession, str]] = []
_MADE: dict[tuple, tuple[SparkSession, list[str], Any]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else the session's warehouse.

    Both are shared by the driver and all executors, on a cluster as in a local session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes an intermediate that is read more than once to the shared folder, in folders by a column if named, and
    reads it back.

    The table outlives lost executors, and its size is known to whatever joins
    it. ``release`` removes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/clausewright-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, make: Callable[[], Any]) -> Any:
    """What ``make()`` gives, made at the first call of a session and handed out again until ``release``.

    For tables that many queries of a session share, such as an index. It is made anew when the folder for
    intermediates has changed, or a table that ``make`` wrote is gone.
    """
    key = (id(spark), shared_folder(spark), name)
    kept = _MADE.get(key)
    if kept is None or kept[0] is not spark or not all(_exists(spark, path) for path in kept[1]):
        before = len(_WRITTEN)
        value = make()
        kept = _MADE[key] = (spark, [path for owner, path in _WRITTEN[before:] if owner is spark], value)
    return kept[2]


def _located(spark: SparkSession, path: str):
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


def _exists(spark: SparkSession, path: str) -> bool:
    files, named = _located(spark, path)
    return files.exists(named)


def release(spark: SparkSession) -> None:
    """Removes the tables that ``materialise`` has written for this session. Frames that read them are void then."""
    for key in [k for k, made in _MADE.items() if made[0] is spark]:
        del _MADE[key]
    for entry in [e for e in _WRITTEN if e[0] is spark]:
        files, named = _located(spark, entry[1])
        files.delete(named, True)
        _WRITTEN.remove(entry)
