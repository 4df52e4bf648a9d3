import base64
import tempfile

import pytest

from archloom.functions import charset, html, icons, lang, postquery, rewrite
from archloom.functions import url as U
from archloom.operators.metadata import validate
from archloom.plans.tools import rewrite_document


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://site.test", "site.test/"), ("https://site.test/", "site.test/"), ("http://me:pw@site.test:8080/a", "site.test/a"), ("http://site.test/a#part", "site.test/a"), ("http://site.test/a?x=1&y=2", "site.test/a?x=1&y=2"), ("http://site.test/a?", "site.test/a"),
        ("http://site.test/a%20b?q=%C3%A9+c", "site.test/a b?q=é+c"), ("http://xn--bcher-kva.test/", "bücher.test/"), ("http://SITE.test//a///b?u=http://x//y", "site.test/a/b?u=http://x//y"), ("http://site.test/p.txt?1604500000", "site.test/p.txt"),
        ("https://www.youtube.com/get_video_info?a=b&video_id=XyZ&c=d", "youtube.fuzzy.replayweb.page/get_video_info?video_id=XyZ"), ("https://r1---sn.googlevideo.com/videoplayback?expire=1&id=o-A&x=y", "youtube.fuzzy.replayweb.page/videoplayback?id=o-A"),
        ("https://www.youtube.com/youtubei/v1/player?key=k&videoId=Q1&__wb_method=POST", "youtube.fuzzy.replayweb.page/youtubei/v1/player?videoId=Q1"), ("https://player.vimeo.com/video/12345?h=1", "vimeo.fuzzy.replayweb.page/video/12345"),
        ("https://vod.akamaized.net/exp=1~hmac=2/vimeo/01/4423/13/99/1398.mp4", "vimeo-cdn.fuzzy.replayweb.page/01/4423/13/99/1398.mp4"),
        ("ftp://site.test/", None), ("HTTP://site.test/", None), ("http:///a", None), ("http://site.test:port/", None), ("intent://x", None), (None, None), ("", None), ("http://[bad/", None),
    ],
)
def test_keys(url, key):
    assert U.normalize(url) == key


def test_resolve():
    assert U.resolve("http://a.test/b/c", "../d") == "http://a.test/d" and U.resolve("http://a.test/", None) is None and U.resolve("http://a.test/", "http://[x") is None


TEXTS = ["plain words", "été à Noël", "你好，世界"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("name", ["ascii", "utf-8", "utf-16", "utf-32", "latin-1", "iso-8859-2", "gb2312", "gbk"])
def test_decoding(text, name):
    try:
        raw = text.encode(name)
    except UnicodeEncodeError:
        pytest.skip("not in this charset")
    assert charset.to_text(raw, name, sniff=False) == text
    assert charset.to_text(raw, None, tries=[name], sniff=False) == text
    page = f'<html><meta charset="{name}">{text}'.encode(name)
    assert text in charset.to_text(page, "utf-8" if name == "latin-1" else None)


def test_decoding_edges():
    assert charset.to_text(None) == charset.to_text(b"") == "" and charset.to_text("as is") == "as is"
    assert charset.to_text("é".encode("latin-1")) == "é"
    with pytest.raises(ValueError):
        charset.to_text(b"\xff", tries=["utf-8"])
    with pytest.raises(LookupError):
        charset.to_text(b"a", "no-such-charset")
    assert charset.to_text(b"a", "no-such", aliases={"no-such": "ascii"}) == "a" and charset.to_text(b"a", "no-such", ignore_http=True) == "a"
    assert charset.declared("text/html; charset=hz-gb-2312") == "h" and charset.declared("charset=x-sjis") is None and charset.declared("charset = utf-8") is None
    assert charset.parse_aliases(" A=B , c=D") == {"a": "b", "c": "d"}


KEY = "http://h.test/p"


@pytest.mark.parametrize(
    ("mime", "body", "query"),
    [
        ("application/x-www-form-urlencoded", b"q=a%2Fb+c&z=1", "q=a/b c&z=1"), ("application/json", b'{"u": 1, "v": {"u": "two", "w": [true, null, {"u": 3}]}}', "u=1&u.2_=two&w=True&w.2_=None&u.3_=3"), ("application/json", b"[1, 2]", ""),
        ("application/json", b"{bad", ""), ("application/json", b'{"a": 1}\n{"a": 2}', "a=1&a.2_=2"), ("text/plain", b'{"t": "x y"}', "t=x+y"), ("text/plain", b"no json", "__wb_post_data=" + base64.b64encode(b"no json").decode()),
        ("application/octet-stream", b"\x00\x01", "__wb_post_data=AAE="), (None, b"z", "__wb_post_data=eg=="), ("application/x-www-form-urlencoded", b"\xff\xfe", "__wb_post_data=//4="), ("multipart/form-data", b"x", "__wb_post_data=eA=="),
        ("multipart/form-data; boundary=XX", b'--XX\r\nContent-Disposition: form-data; name="k"\r\n\r\nv 1\r\n--XX\r\nContent-Disposition: form-data; name="k"\r\n\r\nv2\r\n--XX--\r\n', "k=v+1&k=v2"),
    ],
)
def test_bodies(mime, body, query):
    q, key = postquery.url_key("POST", mime, len(body), body, KEY)
    assert q == query and key == KEY + "?__wb_method=POST" + (f"&{query}" if query else "")


def test_body_lengths():
    assert postquery.query_of("text/x", "no", b"a") is None and postquery.query_of("text/x", 2, b"abc") == "__wb_post_data=YWI=" and len(postquery.query_of("application/x-www-form-urlencoded", None, b"a" * 9000)) == 4096
    assert len(postquery.query_of("application/x-www-form-urlencoded", 9000, b"a" * 9000)) == 4096
    assert postquery.url_key("GET", None, 0, b"", KEY + "?a")[1] == KEY + "?a&__wb_method=GET"


@pytest.mark.parametrize(("names", "codes"), [("de", "deu"), ("Spanish", "spa"), ("sPAnish", "spa"), ("pt-br", "por"), ("nothing", "eng"), ("zzz, ita", "ita"), (" jpn ,kor ", "jpn,kor"), ("fr,French,fra", "fra"), ("deu;ita", "eng"), ("", "eng")])
def test_languages(names, codes, spark):
    from pyspark.sql import functions as F

    assert lang.parse_language(names) == codes
    assert spark.range(1).select(lang.language_codes(F.lit(names))).first()[0] == codes


def test_head():
    page = '<HTML lang=de><title>A &amp; B</title><link rel="shortcut icon" href=/i.ico><link rel=icon href=/j.png><link rel=icon href="/i.ico"><link rel=apple-touch-icon href=no><link rel=icon><svg><title>no</title></svg>'
    assert html.read_head(page) == {"title": "A & B", "icons": ["/i.ico", "/j.png"], "lang": "de"}
    assert html.read_head('<meta http-equiv=Content-Language content="fr"><meta name=language content=it>')["lang"] == "fr"
    assert html.read_head(None) == {"title": "", "icons": [], "lang": None}


def test_title_as_written(spark):
    """Titles cut within a reference: HTML reads &quot without its semicolon too, the query's SQL doesn't."""
    import duckdb

    from archloom.plans.catalogue import ORACLES, QUERIES, table

    titles = ["a &quot", "&quot;b&quot; &am", "c&amp", "d &#", "&#x27;e; &lt;", "AT&T; f", "&#1", ""]
    rows = [(i, "http://s.test/", f'<html lang="de"><title>{t}</title><p>&# ;</p>') for i, t in enumerate(titles)]
    read = ['a "', '"b" &am', "c&", "d &#", "'e; <", "AT&T; f", "", ""]
    assert [html.read_head(r[2])["title"] for r in rows] == read
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        assert [r[0] for r in table(spark, d, "pages").orderBy("page_id").select(html.head("html")["title"]).collect()] == read
        got = sorted(map(tuple, QUERIES["html_head"](spark, d).collect()))
        assert got == sorted(duckdb.sql(f"WITH pages AS (SELECT * FROM '{d}/pages.parquet/*.parquet') {ORACLES['html_head']}").fetchall())


def test_icons():
    sizes = [(16, 16), (192, 192), (48, 96), (96, 48), (48, 48), (47, 500), (64, 64)]
    got = icons.ordered([icons.Icon(str(s), *s, b"", "PNG") for s in sizes])
    assert [(i.width, i.height) for i in got] == [(48, 96), (96, 48), (48, 48), (192, 192), (64, 64), (47, 500), (16, 16)]
    assert icons.probe(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (32).to_bytes(4, "big") + (20).to_bytes(4, "big")) == ("PNG", 32, 20)
    assert icons.probe(b"<?xml version='1.0'?><svg xmlns=x>") == ("SVG", 48, 48) and icons.probe(b"junk") is None and icons.probe(b"GIF89a\x05\0\x06\0") == ("GIF", 5, 6)


def links(page, url="http://s.test/dir/page.html", keys=("s.test/img.png?a=b", "s.test/dir/", "s.test/x.js", "other.test/")):
    return rewrite.html(page, url, set(keys).__contains__)


def test_html_links():
    _, out, _ = links("<a href='/img.png?a=b'>x</a><a href=\"http://gone.test/?a&b\">y</a><a href='#f'>z</a><a href='./'>d</a><a href='//other.test/#q'>o</a><img srcset='/img.png?a=b 2x, /no.png'>")
    assert 'href="../img.png%3Fa%3Db"' in out and 'href="http://gone.test/?a&amp;b"' in out and 'href="#f"' in out and 'href="./"' in out and 'href="../../other.test/#q"' in out and 'srcset="../img.png%3Fa%3Db 2x, /no.png"' in out


def test_html_details():
    title, out, modules = links(
        "<!DOCTYPE html><html><head><meta charset=latin1><title>T &lt;</title><script integrity=abc src=/x.js type=module></script><meta http-equiv=refresh content='3; url=/x.js'></head><body onload='go(location)' style=\"background:url('/img.png?a=b')\"><p title=\"a&quot;b'\">&copy;</p></body></html>"
    )
    assert title == "T <" and modules == {"s.test/x.js"} and "integrity" not in out and 'charset="UTF-8"' in out and "WB Insert" in out and "url(&quot;../img.png%3Fa%3Db&quot;)" in out
    assert 'content="3; url=../x.js"' in out and "title=\"a&quot;b&#x27;\"" in out and "&copy;" in out and out.index("WB Insert") < out.index("<title>")
    _, out, _ = rewrite.html("<head></head>", "http://s.test/", lambda k: False, True)
    assert '<link type="text/css" href="../_static/custom.css" rel="stylesheet"></head>' in out


def test_text_stays(spark):
    """References cut short, bare ampersands and a stray &# stay as they were, and links after them are rewritten."""
    import duckdb

    from archloom.plans.catalogue import ORACLES, QUERIES

    title, out, _ = links('<title>a &am</title><p>AT&T R&D &copy 1 &#64 &#x41 &# ; &#x; &b</p><a href="/x.js">x</a>&# ;<a href="/x.js">y</a>&# &e')
    assert title == "a &am" and "<title>a &am</title><p>AT&T R&D &copy 1 &#64 &#x41 &# ; &#x; &b</p>" in out and out.count('href="../x.js"') == 2 and out.endswith("</a>&# &e")
    titles = ["a &am", " &quot;b&quot; &quot", "&#x27;c; &lt;", "AT&T d&amp", "&# ;", ""]
    rows = [(i, f"http://s.test/d/{i}", f'<html lang="de"><title>{t}</title><p>e &# ; &f</p><a href="/the">g</a><a href="/h">i</a>') for i, t in enumerate(titles)]
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        got = sorted(map(tuple, QUERIES["rewrite_html"](spark, d).collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
        assert got == sorted(con.execute(ORACLES["rewrite_html"]).fetchall())


def test_base():
    _, out, _ = links("<link rel=icon href='x.js'><base target=_top><base href='http://s.test/'><base href='http://no.test/'><a href='gone.html'>g</a>")
    assert 'href="../x.js"' in out and 'href="http://s.test/gone.html"' in out and "<base target=" in out


def test_css_and_scripts():
    at = rewrite.Archive("http://s.test/a/b.css", {"s.test/i.png", "s.test/m.js"}.__contains__)
    assert rewrite.css("@import '/i.png'; a{b:url(/i.png) url( \"/no\" ) url(data:x)} }}broken url(", at) == '@import "../i.png"; a{b:url("../i.png") url( "/no" ) url("data:x")} }}broken url('
    assert rewrite.javascript("var a = 1", at) == "var a = 1" and "wombat" in rewrite.javascript("window.x = 1", at)
    found = set()
    out = rewrite.javascript('import a from "/m.js";\nexport {b} from "./n.js";\nimport x from "bare";import("/m.js")', at, True, found)
    assert found == {"s.test/m.js", "s.test/a/n.js"} and 'from "../m.js"' in out and '"bare"' in out and "__wb_module_decl.js" in out and "____wb_rewrite_import__(" in out


def test_single_documents():
    assert rewrite_document("<title>t</title><a href='/b'>", "http://s.test/")[0] == "t"
    assert rewrite_document("a{}", "http://s.test/", "css") == ("", "a{}")


def test_limits():
    validate("t" * 30, "d" * 80, "l" * 4000, ["a"], "eng,fra")
    for bad in ({"title": "t" * 31}, {"description": "d" * 81}, {"long_description": "l" * 4001}, {"tags": ["a;b"]}, {"languages": "english"}):
        with pytest.raises(ValueError):
            validate(**bad)
