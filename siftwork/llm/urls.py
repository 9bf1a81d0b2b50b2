"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.session import prepare

#: Bits of the filter for each listed URL, bits set by one, and blocks that are still broadcast (16 bytes each).
BITS_PER_KEY, PROBES, BROADCAST_BLOCKS = 16, 4, 1 << 20
#: Listed keys that are still broadcast to the exact join.
BROADCAST_KEYS = 100_000
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Listed pages of the method itself, as (host, path prefix): all pages of these hosts are blocked where no rule speaks.
LISTED = tuple((h, "/") for h in ("ads-track.example.com", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net"))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _mask(key: Column) -> Column:
    """PROBES bits of a 64-bit block."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int")) for i in range(PROBES)]
    return reduce(Column.bitwiseOR, bits)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has host, path, verdict; ``listed`` has host, path. Either fits a
    host and its subdomains where the page's path starts with the given one. The
    longest fitting rule (host and path together; ties: the first in order) gives
    rule and verdict; where none fits, rule is null and the verdict is block for
    listed pages, else allow.

    Canonical keys of a page are its host suffixes with its path's prefixes of
    the lengths that occur in the tables, so a fitting entry equals one of them.
    Pages themselves take no part in the joins by key: what is found for a host
    and path is joined back to its pages, where a hot one can be split. Only
    ``id_col`` and ``url_col`` are read. Null urls and those without :// have an
    empty host and path. Rows with equal or null ids stay separate; an empty
    table of any kind is allowed.
    """
    prepare(pages.sparkSession)
    entries = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule")).unionByName(listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
    entries = entries.filter("host is not null and path is not null and host <> ''").distinct()
    keys = entries.withColumn("key", F.concat("host", "path"))
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()  # lengths: a few small numbers
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // 64))

    def block(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks).cast("long"))

    bloom = keys.groupBy(block(F.col("key")).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    lengths = F.array(*[F.lit(k) for k in sorted(size["lengths"])]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probes = rows.filter("host <> ''").select("host", "path", F.explode(candidates).alias("key")).withColumn("block", block(F.col("key")))
    possible = probes.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block").filter(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    exact = keys.select("key", F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("verdict").alias("said"), "is_rule")
    hits = possible.select("host", "path", "key").distinct().join(F.broadcast(exact) if size["n"] <= BROADCAST_KEYS else exact, "key")
    suits = ((F.col("host") == F.col("of_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("of_host")))) & F.startswith(F.col("path"), F.col("of_path"))
    rule = F.when(F.col("is_rule"), F.struct((-F.length("key")).alias("size"), F.col("key").alias("rule"), F.col("said").alias("said")))
    best = hits.filter(suits).groupBy("host", "path").agg(F.min(rule).alias("best"), F.bool_or(~F.col("is_rule")).alias("listed"))
    verdict = F.coalesce("best.said", F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def default_tables(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string"), spark.createDataFrame(list(LISTED), "host string, path string")
