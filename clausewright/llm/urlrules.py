"""URL filter rules: host-suffix and path-prefix expressions, joined by short digests, confirmed by full ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.sizing import at_most

RULES = (  # host, path, verdict
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"  # where no rule fits
SHORT = 8  # hex digits of a digest by which URLs and rules are joined
FEW_RULES = 200_000  # more rules, or lengths of rules, than this are joined by shuffling
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to a table with a column ``url``.

    A rule fits its host and all subdomains where the path starts with the rule's. The longest rule (host and path)
    wins; of equally long ones that with the longer host, then ``block``. A URL without a fitting rule, also NULL or one
    without ``://``, has a NULL rule and the default verdict. Columns of these names in ``pages`` are replaced. Each URL
    that occurs is judged once, however often it occurs; the lengths that some rule has are a table, joined by the number
    of labels, so any number of rules makes one plan, and a URL with very many labels or a very long path few expressions. Rules with a NULL host or path are ignored; with an
    empty table of rules every URL has the default verdict.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    )
    sizes = rules.select(F.size(F.split("host", r"\.")).alias("wanted"), F.length("path").alias("chars")).distinct()
    sizes = F.broadcast(sizes) if at_most(sizes, FEW_RULES) else sizes
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").where("url IS NOT NULL").distinct().select("url", host.alias("_host"), path.alias("_path"))
    suffixes = urls.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("_host", r"\.")))))
    form = F.concat(F.expr("substring_index(_host, '.', -labels)"), F.expr("substring(_path, 1, chars)"))
    forms = suffixes.join(sizes, (F.col("labels") == F.col("wanted")) & (F.length("_path") >= F.col("chars"))).select("url", form.alias("form"))
    forms = forms.withColumn("digest", F.sha2("form", 256)).withColumn("short", F.substring("digest", 1, SHORT)).drop("form")
    name = F.concat("host", "path")
    strength = F.struct(F.length(name), F.length("host"), F.col("verdict"), name.alias("rule"))
    listed = rules.select(F.sha2(name, 256).alias("full"), F.substring(F.sha2(name, 256), 1, SHORT).alias("short"), strength.alias("strength"))
    listed = F.broadcast(listed) if at_most(listed, FEW_RULES) else listed
    best = forms.join(listed, "short").where("digest = full").groupBy("url").agg(F.max("strength").alias("_best"))
    own = {"host": host, "path": path, "rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}
    kept = [F.col(c) for c in pages.columns if c not in own]
    return pages.join(best, "url", "left").select(*kept, *[v.alias(k) for k, v in own.items()])
