"""URL filters by hashed expressions.

A URL expands into its host suffixes (label by label) times its path prefixes (of the lengths that
rules have, the empty one included). A rule is one such expression. URL expressions and rules are
equi-joined on the first 32 bits of their SHA-256, confirmed on all 256 bits, and the longest rule that is left wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host, up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _suffixes(h: Column) -> Column:
    """a.b.c: a.b.c, b.c, c."""
    labels = F.split(h, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The columns ``keep`` of every row of pages, with host, path, rule and verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains of it, if the path starts with the
    rule's. The longest rule text (host + path) wins, then the longer host, then block before allow; a rule
    that is listed twice counts once. rule is that text, null if none fits; the verdict is then ``default``.
    Null and malformed URLs have an empty host and path, which no rule with a host fits. Repeated rows
    are judged one by one. An empty table gives an empty result; without rules all get the default.

    The rules are joined by the planner's choice: broadcast if they are under its threshold, else shuffled.
    Distinct (host, path) are judged and joined back, so a hot URL costs one judgement and only the last join sees its rows.
    """
    keep = keep if keep is not None else pages.columns
    made = {"host", "path", "rule", "verdict"}
    keep = [c for c in keep if c not in made]
    rules = rules.select(
        F.coalesce("host", F.lit("")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv")
    ).groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    rules = rules.withColumn("digest", F.sha2(F.concat("rh", F.lit("\n"), "rp"), 256)).withColumn("short", F.substring("digest", 1, 8))
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("rp"))).alias("n"))  # distinct lengths of paths: bounded by the longest URL
    n = [int(x) for x in lengths.first().n]
    base = pages.select(*[pages[c] for c in keep], host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    once = base.where("host <> ''").select("host", "path").distinct()  # a hot URL is judged once
    prefixes = F.array(*[F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in n]) if n else F.array().cast("array<string>")
    each = once.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("h"), prefixes.alias("ps"))
    each = each.select("host", "path", "h", F.explode(F.filter("ps", lambda p: p.isNotNull())).alias("p"))
    each = each.withColumn("d", F.sha2(F.concat("h", F.lit("\n"), "p"), 256)).withColumn("short", F.substring("d", 1, 8))
    hit = each.join(rules, "short").where((F.col("d") == F.col("digest")) & (F.col("h") == F.col("rh")) & (F.col("p") == F.col("rp")))
    rank = F.struct(F.length(F.concat("rh", "rp")), F.length("rh"), "rv", F.concat("rh", "rp").alias("rule"))
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rv").alias("rv"))
    return base.join(best, ["host", "path"], "left").select(*[base[c] for c in keep], "host", "path", "rule", F.coalesce("rv", F.lit(default)).alias("verdict"))
