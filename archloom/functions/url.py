"""URLs to canonical keys.

A key is ``host/path?query``: without scheme, port, user and fragment, the host in Unicode, percent escapes
decoded, repeated slashes of the path collapsed, and site rules applied that map volatile addresses to stable ones.
"""

from __future__ import annotations

import re
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: (pattern, replacement) on the key, tried in order; the first that matches is applied.
FUZZY: tuple[tuple[re.Pattern, str], ...] = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"^(?:[^/]+\.)?(?:youtube(?:-nocookie)?\.com|googlevideo\.com)/(get_video_info)\?(?:.*&)?(video_id=[^&]+).*$", r"youtube.fuzzy.replayweb.page/\1?\2"),
        (r"^(?:[^/]+\.)?(?:youtube(?:-nocookie)?\.com|googlevideo\.com)/(youtubei/v1/player)\?(?:.*&)?(videoId=[^&]+).*$", r"youtube.fuzzy.replayweb.page/\1?\2"),
        (r"^(?:[^/]+\.)?(?:youtube(?:-nocookie)?\.com|googlevideo\.com)/(videoplayback)\?(?:.*&)?(id=[^&]+).*$", r"youtube.fuzzy.replayweb.page/\1?\2"),
        (r"^(?:[^/]+\.)?vimeo\.com/(?:.*/)?(video/[^/?]+)(?:\?.*)?$", r"vimeo.fuzzy.replayweb.page/\1"),
        (r"^(?:[^/]*vod[^/]*\.akamaized\.net|(?:[^/]+\.)?vimeocdn\.com)/(?:.*/)?(\d+/\d+/\d+/\d+/\d+\.\w+)(?:\?.*)?$", r"vimeo-cdn.fuzzy.replayweb.page/\1"),
        (r"^([^?]+)\?\d+$", r"\1"),
    )
)


def _unicode_host(host: str) -> str | None:
    if "xn--" not in host:
        return host
    labels = []
    for label in host.split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                return None
        labels.append(label)
    return ".".join(labels)


def normalize(url: str | None, fuzzy: tuple = FUZZY) -> str | None:
    """The key of an absolute http(s) URL; None for anything else."""
    if not url or not url.startswith(("http://", "https://")):
        return None
    try:
        parts = urlsplit(url)
        host = parts.hostname
        parts.port  # noqa: B018 - raises on a bad port
    except ValueError:
        return None
    if not host or re.search(r"[\s<>\"{}|\\^`]", host):
        return None
    host = _unicode_host(host)
    if host is None:
        return None
    path = re.sub(r"/{2,}", "/", unquote(parts.path)) or "/"
    key = host + path + (f"?{unquote(parts.query)}" if parts.query else "")
    for pattern, replacement in fuzzy:
        if m := pattern.match(key):
            return m.expand(replacement)
    return key


@F.arrow_udf(StringType())
def normalized(urls: pa.Array) -> pa.Array:
    """normalize() over a column."""
    return pa.array([normalize(u) for u in urls.to_pylist()], pa.string())


def resolve(base: str | None, target: str | None) -> str | None:
    """target as an absolute URL, seen from base (RFC 3986); None if it can't be read."""
    if base is None or not target:
        return None
    try:
        return urljoin(base, target)
    except ValueError:
        return None


@F.arrow_udf(StringType())
def resolved(bases: pa.Array, targets: pa.Array) -> pa.Array:
    return pa.array([resolve(b, t) for b, t in zip(bases.to_pylist(), targets.to_pylist())], pa.string())


# Column forms of what needs no decoding: they stay in generated code.

_URL = r"(?is)^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, which: str) -> Column:
    """scheme, netloc, path, query or fragment; empty if absent."""
    return F.coalesce(F.regexp_extract(url, _URL, ("scheme", "netloc", "path", "query", "fragment").index(which) + 1), F.lit(""))


def hostname(url: Column) -> Column:
    """The netloc without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, "netloc"), r"^.*@", ""), r":\d*$", ""))


def normalized_native(url: Column) -> Column:
    """The key without percent and punycode decoding and site rules; null unless http(s)."""
    path = F.regexp_replace(part(url, "path"), "/{2,}", "/")
    query = part(url, "query")
    key = F.concat(hostname(url), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(is_http(url) & (hostname(url) != ""), key)


def is_http(url: Column) -> Column:
    """http or https, in lower case only."""
    return url.startswith("http://") | url.startswith("https://")


def in_domains(url: Column, domains: list[str]) -> Column:
    """The raw netloc ends with one of the domains: ports count, labels don't. Without domains all pass."""
    out = F.lit(not domains)
    for d in domains:
        out = out | part(url, "netloc").endswith(d)
    return out
