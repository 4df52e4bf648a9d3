"""Bytes to text: declared, sniffed and tried charsets."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A charset declaration. The class of name characters has no x, y and z in lower case, and no blanks around the sign.
DECLARED = r"""(?:charset|encoding)=(?:"([a-wA-Z0-9_-]+)"?|'([a-wA-Z0-9_-]+)'?|([a-wA-Z0-9_-]+))"""
_DECLARED = re.compile(DECLARED)
#: Names found in the wild that codecs don't know.
ALIASES = {
    "iso-8559-1": "iso-8859-1", "iso8859_1": "iso-8859-1", "latin": "iso-8859-1", "utf8mb4": "utf-8", "utf_8": "utf-8", "unicode": "utf-8", "foo": "utf-8", "windows1252": "windows-1252", "win-1251": "windows-1251", "x-sjis": "shift_jis", "gb_2312-80": "gb2312",
}


def parse_aliases(option: str | None) -> dict[str, str]:
    """a=b,c=d with names stripped and lowered."""
    out = {}
    for pair in (option or "").split(","):
        if pair.strip():
            name, sign, value = pair.partition("=")
            if not sign:
                raise ValueError(f"no = in encoding alias {pair!r}")
            out[name.strip().lower()] = value.strip().lower()
    return out


def codec(name: str, aliases: dict[str, str] | None = None) -> str:
    name = name.strip().lower()
    return (ALIASES | (aliases or {})).get(name, name)


def declared(text: str) -> str | None:
    m = _DECLARED.search(text)
    return next((g for g in m.groups() if g), None) if m else None


def to_text(
    content: bytes | str | None,
    http_charset: str | None = None,
    *,
    tries: Iterable[str] = ("UTF-8", "ISO-8859-1"),
    sniff: bool = True,
    sniff_bytes: int = 1024,
    ignore_http: bool = False,
    aliases: dict[str, str] | None = None,
) -> str:
    """Decodes by the declaration in the content's first bytes (if sniff), else by the HTTP charset, else by the first of tries that decodes all.

    Declared charsets replace what they can't decode; an unknown declared charset raises LookupError; no try that fits raises ValueError.
    """
    if isinstance(content, str):
        return content
    if not content:
        return ""
    if sniff:
        head = content[:sniff_bytes]
        for guess in ("ascii", "utf-16", "utf-32"):
            if name := declared(head.decode(guess, "replace")):
                return content.decode(codec(name, aliases), "replace")
    if http_charset and not ignore_http:
        return content.decode(codec(http_charset, aliases), "replace")
    for name in tries:
        try:
            return content.decode(codec(name, aliases))
        except (ValueError, LookupError):
            continue
    raise ValueError("no charset decodes the content")


def decoder(**options):
    """A column function of (content binary, HTTP charset) -> struct(text, error)."""

    @F.arrow_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
    def decode(contents: pa.Array, charsets: pa.Array) -> pa.Array:
        rows = []
        for c, h in zip(contents.to_pylist(), charsets.to_pylist()):
            try:
                rows.append({"text": to_text(c, h, **options), "error": None})
            except (ValueError, LookupError) as e:
                rows.append({"text": None, "error": str(e)})
        return pa.array(rows, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return decode


def declared_charset(content_type: Column) -> Column:
    """declared() on a column; null if there is none."""
    groups = [F.regexp_extract(content_type, DECLARED, i) for i in (1, 2, 3)]
    found = F.concat(*groups)
    return F.when(found != "", found)
