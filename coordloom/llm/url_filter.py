"""URL rules: a blocked Bloom filter of listed prefixes, then an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.llm.bloom import block_of, blocks_for, filled, mask_of


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(
        host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """Columns ``key``, ``host``, ``path``, ``rule`` and ``verdict`` for every row.

    ``rules`` has ``host``, ``path`` and ``verdict``; a path starts and ends with ``/``. A
    rule fits its host and the subdomains where the path starts with the rule's; the
    longest rule wins (of equal ones that with the longer host). Without a rule ``rule``
    is null and ``verdict`` is ``default``. A null url, or one without ``://``, has an
    empty host and path and so no rule. Repeated urls and rows each get their row.
    Rules with a null, or with a path of another shape, raise; of repeated rules with
    different verdicts ``block`` wins.

    Each url names the few prefixes as deep as the deepest rule. Only those that pass the
    Bloom filter, whose size is bounded, go on to the exact join with the list, so urls
    that fit no rule do not move for it. One group-by then picks the longest rule.
    """
    shape = F.col("path").rlike("(?s)^/(.*/)?$") & (F.col("host") != "") & F.col("verdict").isNotNull()
    listed = rules.select(
        F.when(F.coalesce(shape, F.lit(False)), F.concat("host", "path"))
        .otherwise(F.raise_error(F.lit("a rule needs a host, a path from / to /, a verdict")))
        .alias("key"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.size(F.split("path", "/")) - 1).alias("folders"))
    listed = listed.groupBy("key").agg(
        F.max("verdict").alias("verdict"), F.max("labels").alias("labels"),
        F.max("folders").alias("folders"))
    deepest = listed.agg(F.count("*").alias("n"), F.max("labels").alias("labels"),
                         F.max("folders").alias("folders")).first()
    pages = urls.select(
        F.col(key).alias("key_of_row"), host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"))
    if not deepest["n"]:
        return pages.select(F.col("key_of_row").alias(key), "host", "path",
                            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = blocks_for(deepest["n"])
    sieve = F.broadcast(filled(listed, "key", blocks))

    labels, parts = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest["labels"]))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    folders = F.least(F.size(parts) - 1, F.lit(deepest["folders"]))
    paths = F.when(folders > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(folders, F.lit(1))),
        lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    prefixes = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(
        F.concat(h, p).alias("key"), F.length(h).alias("of_host")))))
    named = pages.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "key_of_row", "host", "path", F.posexplode_outer(prefixes).alias("place", "p"))
    passed = named.withColumn("block", block_of(F.col("p.key"), blocks)).join(sieve, "block", "left")
    possible = F.coalesce(
        F.col("bits").bitwiseAND(mask_of(F.col("p.key"))) == mask_of(F.col("p.key")), F.lit(False))
    # One row of every url goes on, under a key that no rule has and no other row.
    passed = passed.select(
        "row", "key_of_row", "host", "path", F.col("p.of_host").alias("of_host"),
        F.coalesce("place", F.lit(0)).alias("place"), possible.alias("possible"),
        F.when(possible, F.col("p.key")).otherwise(
            F.concat(F.lit(" "), F.col("row").cast("string"))).alias("key")
    ).filter(F.col("possible") | (F.col("place") == 0))
    exact = passed.join(listed.select("key", "verdict"), "key", "left")
    best = exact.groupBy("row").agg(
        F.first("key_of_row").alias(key), F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(F.when(F.col("verdict").isNotNull(), F.struct(
            F.length("key").alias("length"), "of_host", "key", "verdict"))).alias("best"))
    return best.select(
        key, "host", "path", F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
