"""What is read from a page: title, icons, language, links."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


_TAG = re.compile("<")


class Verbatim(HTMLParser):
    """Text comes as it is written. References aren't tokens of it, so none gets a semicolon that it hadn't, and no stray &# ends the reading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)

    def reset(self):
        super().reset()
        self.interesting = _TAG

    def set_cdata_mode(self, elem, **kw):  # later versions of the parser look for references in some elements
        super().set_cdata_mode(elem)

    def clear_cdata_mode(self):
        super().clear_cdata_mode()
        self.interesting = _TAG


class _Head(Verbatim):
    def __init__(self) -> None:
        super().__init__()
        self.title: list[str] | None = None
        self.inside = False
        self.icons: list[str] = []
        self.lang: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "title" and self.title is None:
            self.title, self.inside = [], True
        elif tag == "html" and a.get("lang"):
            self.lang.setdefault("html", a["lang"])
        elif tag == "meta" and a.get("content"):
            if a.get("http-equiv", "").lower() == "content-language":
                self.lang.setdefault("equiv", a["content"])
            elif a.get("name", "").lower() == "language":
                self.lang.setdefault("name", a["content"])
        elif tag == "link" and "icon" in a.get("rel", "").lower().split() and a.get("href"):
            self.icons.append(a["href"])

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "title":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


def _read(page: str | None) -> _Head:
    p = _Head()
    try:
        p.feed(page or "")
        p.close()
    except Exception:  # a page that no parser reads has no title
        pass
    return p


def _head_of(p: _Head) -> dict:
    lang = next((p.lang[k] for k in ("html", "equiv", "name") if k in p.lang), None)
    return {"title": "".join(map(unescape, p.title or [])), "icons": list(dict.fromkeys(p.icons)), "lang": lang}


def read_head(page: str | None) -> dict:
    """title ("" if none), icons (distinct hrefs of icon links, in order), lang (html lang, then the two metas; None if none)."""
    return _head_of(_read(page))


@F.arrow_udf(StructType([StructField("title", StringType()), StructField("icons", ArrayType(StringType())), StructField("lang", StringType()), StructField("title_source", StringType())]))
def head(pages: pa.Array) -> pa.Array:
    """What read_head gives, and the title as it is written, references and all."""
    read = map(_read, pages.to_pylist())
    return pa.array([_head_of(p) | {"title_source": "".join(p.title or [])} for p in read], pa.struct([("title", pa.string()), ("icons", pa.list_(pa.string())), ("lang", pa.string()), ("title_source", pa.string())]))


# Expressions for pages whose markup is plain; they stay in generated code.


def title_native(page: Column) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def lang_native(page: Column) -> Column:
    found = F.regexp_extract(page, r"""(?is)<html[^>]*\slang=["']([^"']+)["']""", 1)
    return F.when(found != "", found)


def links_native(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1))


def cut_title(title: Column, most: int = 30) -> Column:
    """Longer titles end in an ellipsis at that length; none is Untitled."""
    t = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def folder_list(page: Column) -> Column:
    """Names of parent folders that the text links to, distinct, sorted, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(page, F.lit(r"\.\./(.*?)/"), F.lit(1)))), "|")


_REFRESH = re.compile(r"^(\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?)(['\"]?)(.*?)\2\s*$", re.I | re.S)


def refresh_target(content: str) -> tuple[str, str] | None:
    """(text before the target, target) of a meta refresh; None if it has no target."""
    m = _REFRESH.match(content)
    return (m[1], m[3]) if m and "url" in m[1].lower() and m[3] else None
