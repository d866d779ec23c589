"""Raw documents: local files, the fetch cache and the fetch stage."""

from __future__ import annotations

import codecs
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.sizing import at_most, broadcast_when
from clausewright.schema import SOURCE_SCHEMA
from clausewright.sources.extract import html_text, page_source, pdf_text, plain_text

# Fetch policy.
TIMEOUT_SECONDS = 30
ATTEMPTS = 3
RETRY_DELAY_SECONDS = 2
RATE_LIMIT_SECONDS = 1.5
LOCAL_SCHEME = "local://"

BROADCAST_SOURCES = 100_000
NAMED_FILES = 10_000  # up to so many files are read by name; more are found by scanning the folder
CACHE_SCHEMA = "id string, cache_key string, raw_text string"


def cache_key(source_id: Column, url: Column) -> Column:
    return F.concat(source_id, F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8))


def is_local(url: Column) -> Column:
    return F.startswith(url, F.lit(LOCAL_SCHEME))


def raw_documents(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """``metadata, raw_text, char_count`` of the sources that have a text (``id, raw_text``)."""
    metadata = F.struct(*[F.col(f"s.{f.name}").alias(f.name) for f in SOURCE_SCHEMA.fields])
    return (
        sources.alias("s")
        .join(texts.alias("t"), F.col("s.id") == F.col("t.id"))
        .where(F.col("t.raw_text").isNotNull())
        .select(metadata.alias("metadata"), F.col("t.raw_text").alias("raw_text"))
        .withColumn("char_count", F.length("raw_text"))
    )


def named_files(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """``file, path, content`` of the files in a folder that ``names`` (``file``) lists; others may be among more than ``NAMED_FILES``."""
    files = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    small = at_most(names, BROADCAST_SOURCES)
    there = files.select("path", "file").join(broadcast_when(small, names), "file", "left_semi").select("path")
    paths = [r.path for r in there.limit(NAMED_FILES + 1).collect()]
    if not paths:
        return files.where(F.lit(False))
    if len(paths) > NAMED_FILES:
        return files
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path in paths]
    return spark.read.format("binaryFile").load(literal).withColumn("file", F.element_at(F.split("path", "/"), -1))


def local_texts(sources: DataFrame, folder: str) -> DataFrame:
    """Texts of ``local://`` sources; missing and empty files give no row.

    ``.txt`` files are decoded, anything else is read as PDF. The folder is listed
    first, without opening a file; only the files that a source names are read.
    """
    spark = sources.sparkSession
    wanted = sources.where(is_local(F.col("url"))).select(
        "id", F.replace(F.col("url"), F.lit(LOCAL_SCHEME), F.lit("")).alias("file")
    )
    files = named_files(spark, folder, wanted.select("file"))
    both = files.join(broadcast_when(at_most(wanted, BROADCAST_SOURCES), wanted), "file")
    is_text = F.endswith(F.lower("file"), F.lit(".txt"))
    texts = both.where(is_text).select("id", plain_text(F.col("content")).alias("raw_text")).unionByName(
        both.where(~is_text).select("id", pdf_text(F.col("content")).alias("raw_text"))
    )
    return texts.where(F.col("raw_text") != "")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty when nothing has been cached yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def cache_misses(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Remote sources whose text is not cached under their id and url."""
    keyed = sources.where(~is_local(F.col("url"))).withColumn("cache_key", cache_key(F.col("id"), F.col("url")))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def _marked(body: bytes, headers) -> bytes:
    charset = headers.get_content_charset() if headers is not None and headers.get_content_maintype() == "text" else None
    try:
        return codecs.BOM_UTF8 + body.decode(charset, "replace").encode() if charset else body
    except LookupError:
        return body


def http_get(url: str, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes | None:
    """Three attempts with growing pauses; 404 gives up at once.

    A text whose header names its charset comes back as UTF-8 with a byte order mark.
    """
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with opener(urllib.request.Request(url), timeout=TIMEOUT_SECONDS) as reply:
                return _marked(reply.read(), getattr(reply, "headers", None))
        except urllib.error.HTTPError as problem:
            if problem.code == 404:
                return None
        except OSError:
            pass
        if attempt < ATTEMPTS:
            sleep(RETRY_DELAY_SECONDS * attempt)
    return None


def fetch_missing(
    sources: DataFrame, cache_path: str, get: Callable[[str], bytes | None] = http_get, pause: float = RATE_LIMIT_SECONDS
) -> DataFrame:
    """Fetches what the cache lacks and returns the cached texts of the sources.

    Fetching is polite and sequential: sources stream through the driver one by
    one, and each body is written out before the next is asked for. Extraction
    runs in Spark over the written bodies.
    """
    spark = sources.sparkSession
    for row in cache_misses(sources, read_cache(spark, cache_path)).select("id", "url", "cache_key").toLocalIterator():
        body = get(row.url)
        time.sleep(pause)
        if body is None:
            continue
        one = spark.createDataFrame([(row.id, row.cache_key, bytearray(body))], "id string, cache_key string, body binary")
        if row.url.endswith(".pdf"):
            text = pdf_text(F.col("body"))
        else:
            text = html_text(page_source(F.col("body")))
        one.select("id", "cache_key", text.alias("raw_text")).write.mode("append").parquet(cache_path)
    keys = sources.select("id", cache_key(F.col("id"), F.col("url")).alias("cache_key"))
    return read_cache(spark, cache_path).join(keys, ["id", "cache_key"]).select("id", "raw_text")
