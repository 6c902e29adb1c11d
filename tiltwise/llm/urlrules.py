"""URL filter rules as a sort-merge range join, in DataFrame functions only.

A rule is a host with a path prefix.  Its canonical key is the reversed host, a slash and the path, so the urls that it
fits are those whose key begins with the rule's: an interval in key order.  A rule also fits subdomains, so a url has one
key for each number of host labels that a rule has (never more than its own labels).  Rules and keys are dealt to key
ranges; in each range a sorted sweep carries the last rule that began, with the stack of rules around it.  The entries of
that stack that still cover the key are the rules that fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import host_of, lowered, path_of

END = "\U0010ffff"


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str = "/"


def canonical_key(host: Column, path: Column, labels: Column) -> Column:
    """The last ``labels`` labels of the host in reverse order, a slash, and the path."""
    parts = F.reverse(F.split(host, r"\."))
    return F.concat(F.concat_ws(".", F.slice(parts, 1, labels)), F.lit("/"), path)


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below the key: a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at)
    )


def range_bounds(keys: DataFrame, ranges: int, per_range: int = 32) -> list[str]:
    """Bounds that deal ``keys`` (column ``sort_key``) evenly, from a sample of about ``per_range`` keys for each range.

    They only say which task sweeps what; results do not depend on them.  The driver gets ``ranges * per_range`` keys.
    """
    total = keys.count()
    if ranges < 2 or total < 2:
        return []
    sample = keys.sample(fraction=min(1.0, ranges * per_range / total), seed=7).select("sort_key").limit(2 * ranges * per_range)
    found = sorted(r[0] for r in sample.collect())
    if not found:
        return []
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)})


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows ``(verdict, host, path)``; any DataFrame with these columns serves as well."""
    rows = [(r.verdict, r.host, r.path) for r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None
) -> DataFrame:
    """Return ``id_col, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; of several, the longest
    (host and path together, then the host) wins, and of rules with the same host and path the first verdict in
    alphabetical order.  Without a rule, ``rule`` is null and ``verdict`` is ``default``.  A null url, or one without
    ``://``, has empty host and path and fits no rule.  Rows that repeat are judged each; extra columns are ignored.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    rules = (
        rules.where("host is not null and host <> ''")
        .select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("labels", F.size(F.split("host", r"\.")))
        .withColumn("key", canonical_key(F.col("host"), F.col("path"), F.col("labels")))
    )
    # The stack of each rule: those of its own prefixes that are rules.
    prefixes = rules.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.col("key").substr(F.lit(1), n))).alias("outer_key"))
    outer = rules.select(F.col("key").alias("outer_key"), F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("key"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    stacked = prefixes.join(outer, "outer_key").groupBy("key").agg(F.sort_array(F.collect_list("entry"), asc=False).alias("stack"))
    depths = sorted(r[0] for r in rules.select("labels").distinct().collect())  # host names have at most 127 labels
    if not depths:
        return pages.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    salt = F.hex(F.xxhash64("id", "path"))
    labels = F.size(F.split("host", r"\."))
    # One key for each depth; rows without a key stay by the outer explode.
    fit = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: (F.col("host") != "") & (d <= labels))
    keyed = (
        pages.withColumn("depth", F.explode_outer(fit))
        .withColumn("key", F.when(F.col("depth").isNotNull(), canonical_key(F.col("host"), F.col("path"), F.col("depth"))))
        .withColumn("sort_key", F.concat(F.coalesce("key", F.lit("")), F.lit("\x01"), salt))
    )
    bounds = range_bounds(keyed.select("sort_key"), ranges)
    swept = keyed.withColumn("range", _range_of(F.col("sort_key"), bounds))
    begun = (
        stacked.withColumn("first", _range_of(F.col("key"), bounds))
        .withColumn("last", _range_of(F.concat("key", F.lit(END)), bounds))
        .withColumn("range", F.explode(F.sequence("first", "last")))
        .select("range", F.col("key").alias("sort_key"), "stack")
    )
    rows = swept.select("range", "sort_key", F.lit(True).alias("is_url"), "id", "host", "path", "depth", "key", F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack")).unionByName(
        begun.withColumn("is_url", F.lit(False)), allowMissingColumns=True
    )
    sweep = Window.partitionBy("range").orderBy("sort_key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.filter(F.last("stack", ignorenulls=True).over(sweep), lambda e: F.coalesce(F.startswith(F.col("key"), e["key"]), F.lit(False)))
    best = rows.withColumn("best", F.get(active, F.lit(0))).where("is_url")
    if len(depths) > 1:
        # The keys of one row meet again only where more than one depth fits; the others are done.
        best = best.groupBy("id", "host", "path", "depth").agg(F.max("best").alias("best"), F.count("*").alias("n"))
        best = best.groupBy("id", "host", "path").agg(F.max("best").alias("best"), F.max("n").alias("n"))
        best = best.select("id", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
