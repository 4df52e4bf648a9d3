"""Rewriting of HTML, CSS and JavaScript for reading offline.

A link to a key of the archive becomes a relative path; any other becomes an absolute URL as it was. Attributes are
written in double quotes, unescaped first and then escaped once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import quote, urlsplit

from .html import Verbatim, refresh_target
from .url import normalize, resolve

STATIC = "_static/"
_LINKS = {
    "a": ("href",), "area": ("href",), "audio": ("src",), "base": ("href",), "blockquote": ("cite",), "body": ("background",), "embed": ("src",), "form": ("action",), "frame": ("src",), "iframe": ("src",), "image": ("href", "xlink:href"),
    "img": ("src",), "input": ("src", "formaction"), "button": ("formaction",), "link": ("href",), "object": ("data",), "script": ("src",), "source": ("src",), "track": ("src",), "use": ("href", "xlink:href"), "video": ("src", "poster"), "q": ("cite",), "ins": ("cite",), "del": ("cite",),
}
_SETS = {"img", "source", "link"}
_CSS_URL = re.compile(r"""(url\(\s*)(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s"'()]+))(\s*\))|(@import\s+)(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""", re.I)
_IMPORT = re.compile(r"""((?:^|[;}\n])\s*(?:import|export)\b(?:\s*["']|[^"';()]*?\bfrom\s*["']))([^"'\n]+)(["'])""")
_DYNAMIC = re.compile(r"(?<![\w$.])import\s*\(")


class Archive:
    """What the links of one document are seen against."""

    def __init__(self, url: str, has: Callable[[str], bool], base: str | None = None):
        self.url, self.has, self.base = url, has, base or url
        self.key = normalize(url) or ""

    def rewrite(self, link: str, always: bool = False) -> str:
        """A relative path if the archive has the target (or always), else the link as it is, made absolute when a base applies. Fragments stay."""
        raw = link.strip()
        if not raw or raw.startswith(("#", "data:", "javascript:", "mailto:", "blob:", "about:")):
            return link
        absolute = resolve(self.base, raw)
        key = normalize(absolute) if absolute else None
        if key is None or not (always or self.has(key)):
            return link if self.base == self.url or absolute is None else absolute
        fragment = urlsplit(absolute).fragment
        return relative(self.key, key) + (f"#{fragment}" if fragment else "")


def relative(here: str, there: str) -> str:
    """The path from one key to another, ? and = escaped."""
    a, b = here.split("/")[:-1], there.split("/")
    same = 0
    while same < min(len(a), len(b) - 1) and a[same] == b[same]:
        same += 1
    path = "../" * (len(a) - same) + quote("/".join(b[same:]), safe="/@:!$&'()*+,;~-._")
    return path if path and not re.match(r"[^/]*:", path) else "./" + path


def static_prefix(key: str) -> str:
    return "../" * key.count("/") + STATIC


def css(text: str, at: Archive) -> str:
    """URLs in url() and @import; all else, broken or not, stays."""

    def swap(m: re.Match) -> str:
        if m[6]:
            value = m[7] if m[7] is not None else m[8]
            return f'{m[6]}"{at.rewrite(value)}"'
        value = next((g for g in m.groups()[1:4] if g is not None), "")
        new = at.rewrite(re.sub(r"\\(.)", r"\1", value))
        return f'{m[1]}"{new.replace(chr(34), "%22")}"{m[5]}'

    return _CSS_URL.sub(swap, text)


HEAD = "var _____WB$wombat$assign$function_____=function(name){return (self._wb_wombat&&self._wb_wombat.local_init&&self._wb_wombat.local_init(name))||self[name];};if(!self.__WB_pmw){self.__WB_pmw=function(obj){this.__WB_source=obj;return this;}}{\n"
_GLOBALS = ("window", "self", "document", "location", "top", "parent", "frames", "opener")
_DECLARE = "".join(f'let {g}=_____WB$wombat$assign$function_____("{g}");\n' for g in _GLOBALS)
_NEEDS = re.compile(r"(?<![\w$])(?:window|self|document|location|top|parent|frames|opener|postMessage|this)(?![\w$])")


def javascript(text: str, at: Archive, module: bool = False, modules: set[str] | None = None) -> str:
    """Scripts run in a block where the page's globals are those of the archive; modules import them, and their static imports are rewritten and noted."""
    if not module:
        return HEAD + _DECLARE + text + "\n}" if _NEEDS.search(text) else text

    def swap(m: re.Match) -> str:
        target = m[2]
        if not re.match(r"\.{0,2}/|https?:", target):
            return m[0]
        absolute = resolve(at.url, target)
        key = normalize(absolute) if absolute else None
        if key and modules is not None:
            modules.add(key)
        return m[1] + at.rewrite(target) + m[3]

    body = _DYNAMIC.sub("____wb_rewrite_import__(import.meta.url,", _IMPORT.sub(swap, text))
    return f'import {{ {", ".join(_GLOBALS)} }} from "{static_prefix(at.key)}__wb_module_decl.js";\n' + body


def json_text(text: str) -> str:
    """Data stays as it is; callbacks aren't told from data."""
    return text


def srcset(value: str, at: Archive) -> str:
    out = []
    for m in re.finditer(r"\s*([^\s,]\S*[^\s,]|[^\s,])(\s+[^,]+)?\s*(?:,|$)", value):
        out.append(at.rewrite(m[1]) + (m[2].rstrip() if m[2] else ""))
    return ", ".join(out)


class _Html(Verbatim):
    def __init__(self, at: Archive, head_insert: str, head_end: str, modules: set[str]):
        super().__init__()
        self.at, self.head_insert, self.head_end, self.modules = at, head_insert, head_end, modules
        self.out: list[str] = []
        self.title: list[str] | None = None
        self.raw: tuple[str, bool] | None = None
        self.in_title = self.inserted = False

    def _tag(self, tag: str, attrs, close: str) -> None:
        a = dict(attrs)
        kind = (a.get("type") or "").strip().lower()
        rel = (a.get("rel") or "").lower().split()
        parts = [tag]
        for k, v in attrs:
            if k == "integrity" and tag in ("script", "link"):
                continue
            if v is None:
                parts.append(k)
                continue
            if k == "style":
                v = css(v, self.at)
            elif k.startswith("on") and len(k) > 2:
                v = javascript(v, self.at)
            elif (k == "srcset" and tag in _SETS) or (k == "imagesrcset" and tag == "link"):
                v = srcset(v, self.at)
            elif k in _LINKS.get(tag, ()):
                new = self.at.rewrite(v)
                if (tag == "script" and kind == "module") or (tag == "link" and "modulepreload" in rel):
                    if key := normalize(resolve(self.at.base, v.strip())):
                        self.modules.add(key)
                v = new
            elif k == "content" and tag == "meta":
                equiv = (a.get("http-equiv") or "").lower()
                if equiv == "refresh" and (t := refresh_target(v)):
                    v = t[0] + self.at.rewrite(t[1])
                elif equiv == "content-type":
                    v = re.sub(r"charset=[^;]*", "charset=UTF-8", v)
            elif k == "charset" and tag == "meta":
                v = "UTF-8"
            parts.append(f'{k}="{_escape(v)}"')
        if tag == "base" and "href" in a:
            parts = [p for p in parts if not p.startswith("href=")]
        self.out.append(f"<{' '.join(parts)}{close}>")
        if tag in ("head", "body") and not self.inserted and close == "":
            self._insert()

    def _insert(self) -> None:
        self.inserted = True
        self.out.append(self.head_insert)

    def handle_starttag(self, tag, attrs):
        if not self.inserted and tag not in ("html", "head", "body"):
            self._insert()
        self._tag(tag, attrs, "")
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag in ("script", "style"):
            self.raw = tag, (dict(attrs).get("type") or "").strip().lower()

    def handle_startendtag(self, tag, attrs):
        if not self.inserted and tag not in ("html", "head", "body"):
            self._insert()
        self._tag(tag, attrs, " /")

    def handle_endtag(self, tag):
        if tag == "head" and self.head_end:
            self.out.append(self.head_end)
        if tag == "title":
            self.in_title = False
        self.raw = None
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.raw and self.raw[0] == "style":
            data = css(data, self.at)
        elif self.raw and data.strip():
            if self.raw[1] == "module":
                data = javascript(data, self.at, True, self.modules)
            elif self.raw[1] in ("", "text/javascript", "application/javascript", "application/x-javascript"):
                data = javascript(data, self.at)
        if self.in_title:
            self.title.append(data)
        self.out.append(data)

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data):
        self.out.append(f"<?{data}>")

    def unknown_decl(self, data):
        self.out.append(f"<![{data}]>")


def _escape(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")


class _Base(HTMLParser):
    found = None

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "base" and href and self.found is None:
            self.found = href

    handle_startendtag = handle_starttag


def head_insert(key: str, url: str) -> str:
    prefix, parts = static_prefix(key), urlsplit(url)
    return f"""<!-- WB Insert -->
<script src="{prefix}wombat.js"></script>
<script src="{prefix}wombatSetup.js"></script>
<script>(function(){{var at=new URL(location.href);at.hash="";at=at.toString();var root=at.slice(0,at.length-{len(quote(key))});
if(self._WBWombatInit)self._WBWombatInit(wombatSetup.getWombatInfo(at,"{parts.netloc}","{parts.scheme}","{url.replace(chr(34), "%22")}",root));}})();</script>
<!-- End WB Insert -->"""


def html(text: str, url: str, has: Callable[[str], bool], custom_css: bool = False) -> tuple[str, str, set[str]]:
    """(title, page, keys of JavaScript modules it names). The first base with an href applies to the whole page."""
    finder = _Base(convert_charrefs=True)
    finder.feed(text)
    at = Archive(url, has, resolve(url, finder.found) if finder.found else None)
    modules: set[str] = set()
    end = f'<link type="text/css" href="{static_prefix(at.key)}custom.css" rel="stylesheet">' if custom_css else ""
    p = _Html(at, head_insert(at.key, url), end, modules)
    p.feed(text)
    p.close()
    return "".join(map(entities.unescape, p.title or [])).strip(), "".join(p.out), modules
