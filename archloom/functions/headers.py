"""Columns of a record's headers: URL, status, content type, mode of rewriting, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = (200, 201, 202, 203, 301, 302, 307, 308)
REDIRECTS = (301, 302, 307, 308)
HTML_TYPES = ("text/html", "application/xhtml+xml")
_JS = ("application/javascript", "text/javascript", "application/x-javascript")


def record_url(urlkey: Column, target_uri: Column) -> Column:
    """The key of the request's body if there is one, else the target; the text None if the record has no target."""
    return F.coalesce(urlkey, target_uri, F.lit("None"))


def status_code(status_line: Column) -> Column:
    """The number of an HTTP status line (``HTTP/1.1 200 OK`` or ``200 OK``); null if it has none."""
    code = F.regexp_extract(status_line, r"^(?:[A-Za-z]+/[\d.]+\s+)?(\d{1,3})(?:\s|$)", 1)
    return F.when(code != "", code.cast("int"))


def content_type(http: Column, warc: Column, has_http: Column) -> Column:
    return F.coalesce(F.when(has_http, http).otherwise(warc), F.lit(""))


def mime_type(content_type: Column) -> Column:
    """Up to the first semicolon, neither trimmed nor lowered."""
    return F.split_part(content_type, F.lit(";"), F.lit(1))


def processable(status: Column) -> Column:
    """Statuses that give an entry; false for none and unknown ones."""
    return F.coalesce(status.isin(*STATUSES), F.lit(False))


def redirect(status: Column) -> Column:
    return F.coalesce(status.isin(*REDIRECTS), F.lit(False))


def is_front(mime: Column) -> Column:
    """Whether an entry shows up among the articles."""
    return mime.startswith("text/html") | mime.startswith("application/pdf")


def warc_date(date: Column) -> Column:
    """The day, whatever the session's time zone."""
    return F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.substring(date, 1, 10))


def content_dates(first: Column, last: Column) -> Column:
    """One day, or the first and the last."""
    a, b = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(","), b))


def rewrite_mode(resource_type: Column, mime: Column, method: Column, path: Column) -> Column:
    """html, css, javascript, json or none: by the resource type of the crawler if it gives one, else by the MIME type. Callbacks of JSONP are never recognised."""
    rt = F.lower(F.trim(F.coalesce(resource_type, F.lit(""))))
    js, dot_json = mime.isin(*_JS), path.endswith(".json")
    get = F.coalesce(method, F.lit("GET")) == "GET"
    by_type = (
        F.when(rt.isin("document", "xhr", "fetch") & (mime == "text/html"), F.when(get, "html").otherwise("none"))
        .when(rt == "stylesheet", "css")
        .when(rt.isin("script", "fetch", "other", "xhr", "manifest") & ((mime == "application/json") | dot_json), "json")
        .when(rt.isin("script", "other", "xhr") & js, "javascript")
        .otherwise("none")
    )
    by_mime = (
        F.when(mime == "text/html", F.when(F.coalesce(method, F.lit("GET")) == "POST", "none").otherwise("html"))
        .when(mime == "text/css", "css")
        .when(js, F.when(dot_json, "json").otherwise("javascript"))
        .when(mime == "application/json", "json")
        .otherwise("none")
    )
    return F.when(rt == "", by_mime).otherwise(by_type)


def digest(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(raw, 256))
