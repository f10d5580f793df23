"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes.

A rule names a host and a path; it fits its host and all subdomains if the URL's path starts with the
rule's. Every distinct address (host, path) is expanded into expressions: each suffix of the host at a
label, with each prefix of the path that ends at a slash, and with no path. Rules are stored under the
same kind of expression, with what their path has after its last slash as a rest. Expressions meet
rules in an equi-join on the first bytes of their SHA-256; the full digest and the rest are then
confirmed, and the longest rule wins. Expressions longer than any rule's are not made, which loses
nothing and bounds them for any URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved

ALLOW, BLOCK = "allow", "block"
PREFIX_HEX = 8
"""Hex digits of the digest that the join compares: four bytes."""
BROADCAST_CHARS = 4_000_000
"""Rules of at most so many characters are broadcast; more are joined by shuffle."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 2)


def _host_suffixes(host: Column, most_labels: int) -> Column:
    labels = F.split(host, "\\.")
    count = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(count, F.lit(most_labels))),
                       lambda n: F.array_join(F.slice(labels, count - n + 1, n), "."))


def _path_prefixes(path: Column, most_slashes: int) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most_slashes))),
                       lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _keyed(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, PREFIX_HEX).alias("prefix"), digest.alias("digest")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
          default: str = ALLOW) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and action (allow or block). The longest rule that fits wins (host and path
    together; then the longer host, then the larger text); if one host and path has both actions, block
    does. Pages that no rule fits have a null rule and the verdict ``default``: a filter lists what it
    knows, and lets the rest pass. Null URLs and URLs without ``://`` have an empty host and path. Rules
    with a null in any column are left out. Repeated pages are each judged; other columns are ignored.
    """
    own = rules.select("host", "path", "action").dropna().groupBy(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(
        F.max(F.when(F.col("action") == BLOCK, BLOCK)).alias("blocks"))
    folder = _folder(F.col("rule_path"))
    listed = own.select(
        *_keyed(F.concat("rule_host", folder)), "rule_path", F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"), F.coalesce("blocks", F.lit(ALLOW)).alias("action"))
    shape = own.agg(
        F.coalesce(F.sum(F.length("rule_host") + F.length("rule_path")), F.lit(0)).alias("chars"),
        F.coalesce(F.max(F.size(F.split("rule_host", "\\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split(folder, "/")) - 1), F.lit(0)).alias("slashes")).first()
    if shape["chars"] <= BROADCAST_CHARS:
        listed = F.broadcast(listed)

    named = pages.select(F.col(id_column).alias("page_id"), host_of(F.col(url_column)).alias("host"),
                         path_of(F.col(url_column)).alias("path"))
    addresses = named.select("host", "path").distinct()
    suffixed = addresses.withColumn("suffix", F.explode(_host_suffixes(F.col("host"), shape["labels"])))
    prefixed = suffixed.withColumn("folder", F.explode(_path_prefixes(F.col("path"), shape["slashes"])))
    expressions = prefixed.select("host", "path", *_keyed(F.concat("suffix", "folder")))
    hits = expressions.alias("e").join(listed.alias("r"), "prefix").where(
        (F.col("e.digest") == F.col("r.digest")) & F.col("path").startswith(F.col("rule_path")))
    # written down, so that both sides of the last join are plain shuffles, whose hot addresses Spark can split
    best = saved(hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "action")).alias("best")), "verdicts")
    # addresses compress well, so the size of their files says little about a broadcast
    return named.join(best.hint("merge"), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
