"""Main text of HTML pages by line-block distribution.

The markup is stripped into lines: the text of each block-level element, with what kind of element it
lies in. Lines of menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles have no
weight and are never part of the text. Of the others, lengths are summed over sliding windows; the text between the first surge (the
sum of the lines from there reaches its threshold) and the last dive (that of the lines up to there still does) is kept.
Short lines that are all link count as zero length. Two things correct what length alone gets wrong:

* the lines around the surge and the dive that lie in the same container (the same div, section, article, ...) are of the same block, however short;
* where a page marks its article (article, main, or role=main), marked lines weigh a threshold more than their length and unmarked ones nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import row_wise

_TOKEN = re.compile(r"""<!--(?:.*?-->|-?>|.*\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select".split()
)
_OUT = frozenset("nav aside footer form menu dialog button select option svg math canvas object video audio map head label fieldset search".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "select", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
_ALSO = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|side-?bars?|footers?|cookies?(?:bar)?|consent|gdpr|notices?|banners?|adverts?|advertisements?|advertising|ads?|adsense|adbox|sponsor(?:ed|s)?|promos?|promoted|promotions?"
    r"|comments?|commentlist|disqus|replies|respond|discussion|share|sharing|social|related|recommend(?:ed|ations)?|newsletters?|subscribe|subscription|sign-?up|log-?in|breadcrumbs?|pop-?ups?|modals?|overlay|toolbar|pagination|pager|widgets?|search(?:box|bar)?|skip-?links?|masthead|copyright|alert|toc|teasers?|top-?bar|ad-?(?:slot|unit|block|container|box|wrapper)s?|feedback|paywall|notifications?|disclaimers?|outbrain|taboola)(?=[\s_-]|$)",
    re.I,
)
# Names that say how the page around is laid out, and those that make even an article a part of something else.
_LAYOUT = re.compile(r"(?:has|no|with|without|is|show|hide|layout)[-_]|.*[-_](?:layout|wrapper|container|page|enabled|disabled)$", re.I)
_PARTS = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|teaser|promo|sponsored|adverts?|ads?|widget)(?=[\s_-]|$)", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?=[\s_-]|$)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert note".split())
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"\s+")


_CONTAINERS = frozenset("html body div section article main center td form details".split())


class Line:
    __slots__ = ("box", "link", "out", "own", "text")

    def __init__(self, text: str, link: int, out: bool, own: bool, box: int):
        self.text, self.link, self.out, self.own, self.box = text, link, out, own, box


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is to be left out, and whether it marks the article."""
    if tag in _OUT:
        return True, False
    if tag == "header" and not in_article:
        return True, False
    own = tag in ("article", "main")
    if attrs and "=" in attrs or "hidden" in attrs:
        a = {}
        for m in _ATTR.finditer(attrs):
            a.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        role = a.get("role", "").lower()
        own = own or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
        if role in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
            return True, False
        names = " ".join(x for x in (a.get("class", "") + " " + a.get("id", "")).split() if not _LAYOUT.match(x))
        if tag not in ("html", "body") and not in_article and not own and _HEADER.search(names):
            return True, False
        if tag not in ("html", "body") and (_PARTS if own and not in_article else _NAMES).search(names):
            return True, False
    return False, own


def lines(page: str) -> list[Line]:
    """The page's lines in order. Text outside of any block element makes lines of its own."""
    done: list[Line] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, in the article, number of the container; each with what holds around it
    opened: Counter[str] = Counter()  # tags on the stack: nothing is looked for that isn't there
    state = (False, False, 0)
    boxes = 0

    anchors = linked = 0  # open links; characters in links of this line

    def flush() -> None:
        nonlocal linked
        if part:
            text = _SPACE.sub(" ", entities.unescape("".join(part))).strip()
            part.clear()
            if text:
                done.append(Line(text, linked, *state))
        linked = 0

    def pop(to: int) -> None:
        nonlocal state
        for x in stack[to:]:
            opened[x[0]] -= 1
        del stack[to:]
        state = stack[-1][1:] if stack else (False, False, 0)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            part.append(page[at:])
            break
        if lt > at:
            part.append(page[at:lt])
            if anchors:
                linked += lt - at
        m = _TOKEN.match(page, lt)
        if not m:  # a < that starts no tag
            part.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _BLOCK:
            flush()
            if tag != "br":
                anchors = 0
        if tag == "a":
            anchors = 0 if closing else 1
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    if stack[i][1:] != state or tag in _BLOCK:
                        flush()
                    pop(i)
                    break
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else n
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
            continue
        if tag in _CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in ("button", "td", "th", "table", "object", "div", "section", "article", "li", "body"):
                    break
        if tag in _ALSO:
            shut, until = _ALSO[tag]
            shut = shut.split()
            for i in range(len(stack) - 1, -1, -1) if any(opened[x] for x in shut) else ():
                if stack[i][0] in until:
                    break
                if stack[i][0] in shut:
                    pop(i)
                    break
        if tag in _VOID:
            continue
        out, own = _judge(tag, m[3], state[1])
        boxes += tag in _CONTAINERS
        new = (state[0] or out, state[1] or own, boxes if tag in _CONTAINERS else state[2])
        if new != state:
            flush()
        stack.append((tag, *new))
        opened[tag] += 1
        state = new
    flush()
    return done


def _weights(of: list[Line], surge: int) -> list[int]:
    """What each line brings into a window."""
    marked = any(x.own for x in of)
    out = []
    for x in of:
        n = 0 if x.link > 0.8 * len(x.text) and len(x.text) < surge else len(x.text)
        out.append(n if not marked else len(x.text) + surge if x.own else 0)
    return out


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The lines between the first surge and the last dive, joined by spaces. window: lines summed; surge: characters that make one. A page without any is short: all of it is kept."""
    if not page:
        return ""
    kept = [x for x in lines(page) if not x.out]
    size = _weights(kept, surge)
    n, total = len(size), [0]
    for s in size:
        total.append(total[-1] + s)
    surges = (i for i in range(n) if size[i] and total[min(n, i + window)] - total[i] >= surge)
    dives = (i for i in range(n - 1, -1, -1) if size[i] and total[i + 1] - total[max(0, i + 1 - window)] >= surge)
    first, last = next(surges, 0), next(dives, n - 1)
    while first > 0 and kept[first - 1].box == kept[first].box and (size[first - 1] or not kept[first - 1].link):
        first -= 1
    while last < n - 1 and kept[last + 1].box == kept[last].box and (size[last + 1] or not kept[last + 1].link):
        last += 1
    marked = any(x.own for x in kept)
    return " ".join(x.text for x in kept[first : last + 1] if x.own or not marked)


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, window: int = 3, surge: int = 80) -> DataFrame:
    """The columns ``keep`` of every row (default: all but the html), with text and n_chars (code points).

    Null, empty and textless pages give the empty text. Broken markup is read as far as it goes: unclosed
    elements end with the element around them. Repeated rows are read one by one. A kept column called text or n_chars gives way.
    """

    def read(pages: pa.Array) -> list[pa.Array]:
        texts = [main_text(x, window, surge) for x in pages.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return row_wise(pages, html, keep, "text string, n_chars long", read)
