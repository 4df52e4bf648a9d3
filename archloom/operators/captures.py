"""From records to captures, and the sets, edges and winners among them. ``seq`` (a struct that sorts) is the order of capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions import headers as H
from archloom.functions.charset import declared_charset
from archloom.functions.url import in_domains, is_http, normalized, resolved


def header(column: str, name: str) -> Column:
    """The first value of a header, whatever the case of its name."""
    return F.try_element_at(F.filter(F.col(column), lambda h: F.lower(h["name"]) == name), F.lit(1))["value"]


def captures(records: DataFrame) -> DataFrame:
    """Responses and revisits of http(s) URLs with what their headers say. Rows whose URL has no key are kept, with a null key."""
    has_http = F.col("http_headers").isNotNull()
    url = H.record_url(F.col("urlkey"), header("rec_headers", "warc-target-uri"))
    ct = H.content_type(header("http_headers", "content-type"), header("rec_headers", "content-type"), has_http)
    kept = records.where(F.col("rec_type").isin("response", "revisit"))
    named = kept.select(
        F.struct("file_rank", "rec_idx").alias("seq"), "file_path", "file_rank", "rec_idx", "rec_type", url.alias("url"),
        F.when(F.col("rec_type") == "response", H.status_code(F.col("http_status_line"))).alias("status"), has_http.alias("has_http"),
        ct.alias("content_type"), H.mime_type(ct).alias("mime"), declared_charset(ct).alias("charset"), header("rec_headers", "warc-resource-type").alias("resource_type"), "method",
        header("http_headers", "location").alias("location"), header("rec_headers", "warc-refers-to-target-uri").alias("refers_to"), H.warc_date(header("rec_headers", "warc-date")).alias("date"),
        "payload_length", "parse_error",
    ).where(is_http(F.col("url")))
    return named.withColumn("path", normalized("url"))


def first_wins(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """(key, columns): of each key the row that is least in order. Minima are combined before the shuffle, so hot keys don't gather."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("w"))
    return best.select(key, *[F.col("w")[c].alias(c) for c in columns])


def last_wins(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("w"))
    return best.select(key, *[F.col("w")[c].alias(c) for c in columns])


def redirects(caps: DataFrame) -> DataFrame:
    """(src, dst, seq): the first redirect of each key that has a location with a key of its own. The rest claim nothing."""
    r = caps.where((F.col("rec_type") == "response") & H.redirect(F.col("status")) & (F.coalesce(F.col("location"), F.lit("")) != ""))
    r = r.withColumn("dst", normalized(resolved("url", "location"))).where(F.col("dst").isNotNull() & F.col("path").isNotNull() & (F.col("dst") != F.col("path")))
    return first_wins(r.withColumnRenamed("path", "src"), "src", F.col("seq"), "dst", "seq")


def expected(caps: DataFrame) -> DataFrame:
    """Distinct keys of responses that give an entry; include-domains don't matter here."""
    return caps.where((F.col("rec_type") == "response") & H.processable(F.col("status")) & ~H.redirect(F.col("status")) & F.col("path").isNotNull()).select("path").distinct()


def items(caps: DataFrame, domains: list[str]) -> DataFrame:
    """The first capture of each key among responses that give an entry, in the domains."""
    rows = caps.where((F.col("rec_type") == "response") & H.processable(F.col("status")) & ~H.redirect(F.col("status")) & F.col("path").isNotNull() & in_domains(F.col("url"), domains))
    return first_wins(rows, "path", F.col("seq"), "seq", "url", "mime", "charset", "resource_type", "method", "file_path", "rec_idx")


def revisits(caps: DataFrame, domains: list[str]) -> DataFrame:
    """(src, dst): the first revisit of each key that refers to another URL. One that refers to none is an error, not an alias."""
    rows = caps.where((F.col("rec_type") == "revisit") & F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("url")) & in_domains(F.col("url"), domains))
    rows = rows.withColumn("dst", normalized("refers_to")).where("path IS NOT NULL AND dst IS NOT NULL").withColumnRenamed("path", "src")
    return first_wins(rows, "src", F.col("seq"), "dst")


def aliases(revisits: DataFrame, items: DataFrame, redirects: DataFrame) -> DataFrame:
    """Revisits whose key is no entry and no redirect, and whose target is an entry."""
    taken = items.select(F.col("path").alias("src")).union(redirects.select("src"))
    return revisits.join(taken, "src", "left_anti").join(items.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def adjacent_pairs(rows: DataFrame, group: str, order: str, first: Column, second: Column) -> DataFrame:
    """Pairs of neighbours in a group where first holds for the one and second for the next; a row is in one pair at most (greedy from the start).

    A group is a conversation or a file's record list: its rows are sorted in one task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("__a", first).withColumn("__b", second)
    marked = marked.withColumn("__hit", F.col("__a") & F.coalesce(F.lead("__b").over(w), F.lit(False)))
    # In a run of hits every second one stands: its place in the run is odd.
    marked = marked.withColumn("__n", F.row_number().over(w)).withColumn("__miss", F.max(F.when(~F.col("__hit"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.withColumn("__next", F.lead(order).over(w))
    return marked.where(F.col("__hit") & ((F.col("__n") - F.coalesce(F.col("__miss"), F.lit(0))) % 2 == 1)).drop("__a", "__b", "__hit", "__n", "__miss").withColumnRenamed("__next", f"next_{order}")
