"""URL filters: rules on a host with its subdomains and a path's beginning, found through digests of a url's expressions.

Each url stands for its host's suffixes, from a dot to the end, times its path's prefixes, up to a slash or as long as a rule that
ends elsewhere. Expressions meet rules by an equi-join on the first 32 bits of their SHA-256; the full digests confirm. Of the rules that
fit, the longest (host and path together; of equals the one with the longer host) decides; without one the default does. Distinct pairs of a host
and as much of the path as any rule has are judged, once each; pages are then joined to the pairs that a rule fits.

Defined results: hosts of rules and urls differ by A-Z not at all; a url that is null or has no :// has an empty host and path, and only a rule with
an empty host could fit it; ports and user names belong to the host; of two rules with equal host and path, block wins; null host or path of a rule:
empty; repeated pages are judged alike and stay; no rules: the default everywhere; empty table: no rows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: Hexadecimal digits of a digest that expressions and rules are joined on.
PREFIX_DIGITS = 8
#: A side of a join goes to all executors if its rows take no more bytes; else rows are shuffled.
BROADCAST_BYTES = 16 << 20
#: Tasks that pages of one pair of host and path are dealt to where pairs are too many to be broadcast.
SALTS = 32

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict of a short list."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """From the first :// up to / ? # or the end, lower-cased; then up to ? # or the end."""
    whole, part = F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lowered(F.regexp_extract(whole, part, 1)), F.regexp_extract(whole, part, 2)


def expressions(host: Column, path: Column, labels: int, slashes: int, lengths: list[int]) -> Column:
    """Structs (host suffix, path prefix) that a rule of at most `labels` labels and `slashes` slashes, or with a path of one of the lengths, can equal."""
    words, pieces = F.split(host, r"\."), F.split(path, "/")
    first = F.greatest(F.size(words) - labels + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "."))
    depth = F.least(F.size(pieces) - 1, F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), F.greatest(i, F.lit(1))), "/"), F.lit("/"))))
    if lengths:
        fit = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
        prefixes = F.array_union(prefixes, F.transform(fit, lambda n: F.left(path, n)))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def _small(df: DataFrame, *columns: str) -> bool:
    """Whether the rows' strings, and 100 bytes a row beside them, fit into BROADCAST_BYTES."""
    row = df.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in columns), F.lit(100))), F.lit(0))).first()
    return row[0] <= BROADCAST_BYTES


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages: page_id, url. rules: host, path, verdict (allow or block). page_id, host, path, rule, verdict."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = rules.select(lowered(text("host")).alias("h"), text("path").alias("p"), F.col("verdict")).groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("h", "p").cast("binary"), 256)
    known = stash(known.select("*", F.concat("h", "p").alias("rule"), digest.alias("digest"), F.left(digest, F.lit(PREFIX_DIGITS)).alias("prefix")), "rules")
    odd = (F.col("p") != "") & ~F.col("p").endswith("/")
    shape = known.agg(
        F.coalesce(F.max(F.size(F.split("h", r"\."))), F.lit(1)).alias("labels"), F.coalesce(F.max(F.length("p")), F.lit(0)).alias("longest"),
        F.coalesce(F.max(F.when(~odd, F.length("p") - F.length(F.replace("p", F.lit("/"), F.lit(""))))), F.lit(0)).alias("slashes"),
        F.collect_set(F.when(odd, F.length("p"))).alias("lengths")).first()

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("site", F.left("path", F.lit(shape["longest"])))
    asked = rows.select("host", "site").distinct().select("host", "site", F.explode(expressions(F.col("host"), F.col("site"), shape["labels"], shape["slashes"], sorted(shape["lengths"]))).alias("x"))
    asked = asked.withColumn("digest", F.sha2(F.concat("x.h", "x.p").cast("binary"), 256)).select("host", "site", "digest", F.left("digest", F.lit(PREFIX_DIGITS)).alias("prefix"))
    table = known.select("prefix", F.col("digest").alias("full"), "rule", "verdict", F.length("h").alias("n"))
    met = asked.join(F.broadcast(table) if _small(known, "rule", "digest") else table, "prefix").filter("digest = full")
    best = stash(met.groupBy("host", "site").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "n")).alias("m")).select("host", "site", "m.rule", "m.verdict"), "fits")
    if _small(best, "host", "site", "rule"):
        out = rows.join(F.broadcast(best), ["host", "site"], "left")
    else:
        dealt = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "site", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
