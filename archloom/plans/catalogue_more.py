"""More queries of the archive operators: keys, request bodies, charsets, rewriting and captures made of the pages' rows, with the same in SQL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from archloom.functions import headers as H
from archloom.functions import url as U
from archloom.functions.charset import decoder
from archloom.functions.postquery import url_keys
from archloom.operators import captures as C
from archloom.plans.catalogue import _HOST, _KEY, _MIME, _STATUS, query, table

# Keys: each query makes URLs that differ in one respect


def _keys(spark, d, made: str):
    return table(spark, d, "pages").select("page_id", U.normalized(F.expr(made)).alias("key"))


@query(f"SELECT page_id, {_KEY} AS key FROM pages")
def url_userinfo_port(spark, d):
    return _keys(spark, d, r"regexp_replace(url, '^(https?://)([^/?#]*)', '$1some.one:pa%40ss@$2:8443')")


@query(f"SELECT page_id, {_HOST} || '/p/' || page_id AS key FROM pages")
def url_bare_query(spark, d):
    return _keys(spark, d, "concat('https://', lower(regexp_extract(url, '://([^/?#]*)', 1)), '/p/', page_id, '?')")


@query(f"SELECT page_id, {_HOST} || '/p' || page_id || '/café x+y?q=é+1&r=a/b' AS key FROM pages")
def url_percent_decoded(spark, d):
    return _keys(spark, d, "concat('http://', regexp_extract(url, '://([^/?#]*)', 1), '/p', page_id, '/caf%C3%A9%20x+y?q=%C3%A9+1&r=a%2Fb#x')")


@query("SELECT page_id, 'bücher' || page_id % 7 || '.bücher.example/' || page_id AS key FROM pages")
def url_punycode(spark, d):
    names = "element_at(array('xn--bcher0-3ya', 'xn--bcher1-3ya', 'xn--bcher2-3ya', 'xn--bcher3-3ya', 'xn--bcher4-3ya', 'xn--bcher5-3ya', 'xn--bcher6-3ya'), cast(page_id % 7 + 1 AS int))"
    return _keys(spark, d, f"concat('http://', {names}, '.xn--bcher-kva.example/', page_id)")


@query(f"SELECT page_id, {_HOST} || '/a/b/' || page_id || '/?u=//x' AS key FROM pages")
def url_slashes(spark, d):
    return _keys(spark, d, "concat('http://', regexp_extract(url, '://([^/?#]*)', 1), '//a///b/', page_id, '//?u=//x')")


@query(f"SELECT page_id, {_HOST} || '/' AS key FROM pages")
def url_empty_path(spark, d):
    return _keys(spark, d, "concat('http://', regexp_extract(url, '://([^/?#]*)', 1))")


@query("SELECT page_id, NULL::VARCHAR AS key FROM pages")
def url_invalid(spark, d):
    return _keys(spark, d, "element_at(array('http://', 'mailto:a@b', 'http://h:port/', 'HTTP://upper.example/', '/relative', 'intent://x'), cast(page_id % 6 + 1 AS int))")


@query(f"SELECT page_id, {_HOST} || '/img.png' AS key FROM pages")
def url_timestamp(spark, d):
    return _keys(spark, d, "concat('http://', regexp_extract(url, '://([^/?#]*)', 1), '/img.png?', 1600000000 + page_id)")


@query("SELECT page_id, 'youtube.fuzzy.replayweb.page/' || CASE page_id % 3 WHEN 0 THEN 'get_video_info?video_id=' WHEN 1 THEN 'youtubei/v1/player?videoId=' ELSE 'videoplayback?id=' END || page_id AS key FROM pages")
def url_youtube(spark, d):
    return _keys(spark, d, "CASE page_id % 3 WHEN 0 THEN concat('https://www.youtube.com/get_video_info?el=x&video_id=', page_id, '&hl=en') WHEN 1 THEN concat('https://www.youtube-nocookie.com/youtubei/v1/player?key=k&videoId=', page_id) ELSE concat('https://r1.googlevideo.com/videoplayback?expire=9&id=', page_id, '&itag=18') END")


@query("SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'vimeo.fuzzy.replayweb.page/video/' || page_id ELSE 'vimeo-cdn.fuzzy.replayweb.page/01/2/3/4/' || page_id || '.mp4' END AS key FROM pages")
def url_vimeo(spark, d):
    return _keys(spark, d, "CASE page_id % 2 WHEN 0 THEN concat('https://player.vimeo.com/video/', page_id, '?autoplay=1') ELSE concat('https://vod-progressive.akamaized.net/exp=1~hmac=2/01/2/3/4/', page_id, '.mp4?t=9') END")


# Request bodies


def _posted(spark, d, kind: str, body: str):
    b = F.expr(body)
    key = url_keys(F.lit("POST"), F.lit(kind), F.octet_length(b).cast("string"), b.cast("binary"), F.lit("http://h/"))
    return table(spark, d, "events").select("event_id", key.alias("key"))


@query("SELECT event_id, 'http://h/?__wb_method=POST&id=' || event_id || '&name=Jürgen Ü&x=1=2' AS key FROM events")
def post_form(spark, d):
    return _posted(spark, d, "application/x-www-form-urlencoded", "concat('id=', event_id, '&name=J%C3%BCrgen+%C3%9C&x=1%3D2')")


@query("SELECT event_id, 'http://h/?__wb_method=POST&id=' || event_id || '&id=a+b&kind=' || event_type AS key FROM events")
def post_multipart(spark, d):
    """The values of a name stand together, where the first of them stood."""
    part = lambda n, v: f"'--XX\\r\\nContent-Disposition: form-data; name=\"{n}\"\\r\\n\\r\\n', {v}, '\\r\\n'"
    return _posted(spark, d, "multipart/form-data; boundary=XX", f"concat({part('id', 'event_id')}, {part('kind', 'event_type')}, {part('id', chr(39) + 'a b' + chr(39))}, '--XX--')")


@query("SELECT event_id, 'http://h/?__wb_method=POST&id=' || event_id || '&tags=a&tags.2_=b&tags.3_=' || event_type || '&ok=True&none=None&id.2_=7' AS key FROM events")
def post_json_nested(spark, d):
    return _posted(spark, d, "application/json", """concat('{"id": ', event_id, ', "tags": ["a", ["b", "', event_type, '"]], "in": {"ok": true, "none": null, "id": 7}}')""")


@query("SELECT event_id, 'http://h/?__wb_method=POST&' || CASE event_id % 2 WHEN 0 THEN 'a=' || event_id || '&b=x+y&a.2_=2' ELSE '__wb_post_data=' || base64(encode('no json ' || event_id)) END AS key FROM events")
def post_text_plain(spark, d):
    return _posted(spark, d, "text/plain;charset=UTF-8", """CASE event_id % 2 WHEN 0 THEN concat('{"a": ', event_id, ', "b": "x y"}\\n{"a": 2}') ELSE concat('no json ', event_id) END""")


# Charsets


@query("SELECT doc_id, '<meta charset=\"utf-8\"> ' || text AS text FROM documents")
def decode_sniffed(spark, d):
    """What the content declares goes before what the header does."""
    t = table(spark, d, "documents").select("doc_id", F.encode(F.concat(F.lit('<meta charset="utf-8"> '), "text"), "UTF-8").alias("b"), F.lit("iso-8859-1").alias("c"))
    return t.select("doc_id", decoder()("b", "c")["text"].alias("text"))


@query("SELECT page_id, 'é ' || url AS text, NULL::VARCHAR AS error FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, NULL, 'unknown encoding: no-such-set' FROM pages WHERE page_id % 3 = 0")
def decode_aliases(spark, d):
    """Names found in the wild stand for codecs; a name that no codec has is an error."""
    t = table(spark, d, "pages").select("page_id", F.encode(F.concat(F.lit("é "), "url"), "ISO-8859-1").alias("b"), F.expr("CASE page_id % 3 WHEN 0 THEN 'no-such-set' WHEN 1 THEN 'iso-8559-1' ELSE 'LATIN' END").alias("c"))
    return t.select("page_id", decoder(sniff=False)("b", "c").alias("r")).select("page_id", "r.text", "r.error")


# Rewriting of styles, scripts and what stays as it is


def _rewritten(spark, d, name: str, mode: str, content: str):
    from archloom.plans.conversion import rewrite_pages

    host = U.hostname(F.col("url"))
    p = table(spark, d, "pages").select("page_id", host.alias("host"), F.concat(F.lit("http://"), host, F.lit("/css/"), F.col("page_id").cast("string"), F.lit(name)).alias("url"))
    has = p.select(F.concat("host", F.lit("/p"), F.col("page_id").cast("string")).alias("path"))
    rows = p.select(F.col("page_id").alias("seq"), "url", U.normalized("url").alias("path"), F.expr(content).cast("binary").alias("content"), F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("charset"))
    return rewrite_pages(rows, has).select(F.col("seq").alias("page_id"), "title", F.decode("content", "UTF-8").alias("content"))


@query("""SELECT page_id, '' AS title, 'a{background:url("../p' || page_id || '")} b{x:url("/missing.png")} @import "../p' || page_id || '"; c{' AS content FROM pages""")
def rewrite_css(spark, d):
    return _rewritten(spark, d, ".css", "css", """concat('a{background:url("/p', page_id, '")} b{x:url("/missing.png")} @import "../p', page_id, '"; c{')""")


@query("""SELECT page_id, '' AS title, '{"u": "/p' || page_id || '"}' AS content FROM pages""")
def rewrite_json(spark, d):
    """JSON is decoded, and stays as it is."""
    return _rewritten(spark, d, ".json", "json", """concat('{"u": "/p', page_id, '"}')""")


@query("SELECT page_id, '' AS title, 'raw ' || page_id AS content FROM pages")
def rewrite_passthrough(spark, d):
    return _rewritten(spark, d, ".bin", "none", "concat('raw ', page_id)")


# Captures: a record a page, with headers derived from its id

_TYPE = "CASE WHEN page_id % 17 = 0 THEN 'request' WHEN page_id % 6 = 5 THEN 'revisit' ELSE 'response' END"
_DATE = "'2021-0' || (1 + page_id % 9) || '-1' || page_id % 10 || 'T01:02:03Z'"
_CT = f"{_MIME} || CASE page_id % 3 WHEN 0 THEN '; charset=utf-8' ELSE '' END"
_TO = "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN url ELSE '/to/' || page_id % 11 END"


def _records(spark, d):
    header = lambda n, v: f"named_struct('name', '{n}', 'value', {v})"
    warc = f"filter(array({header('WARC-Target-URI', 'url')}, {header('WARC-Date', _DATE)}, {header('Content-Type', chr(39) + 'application/http' + chr(39))}, {header('WARC-Refers-To-Target-URI', 'refers')}), h -> h.value IS NOT NULL)"
    http = f"array({header('content-type', _CT)}, {header('Location', _TO)})"
    p = table(spark, d, "pages").withColumn("refers", F.expr("CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url ELSE concat('http://', lower(regexp_extract(url, '://([^/?#]*)', 1)), '/to/', page_id % 11) END"))
    return p.selectExpr(
        "'f' AS file_path", "0 AS file_rank", "cast(page_id AS int) AS rec_idx", f"{_TYPE} AS rec_type", f"{warc} AS rec_headers", f"concat('HTTP/1.1 ', {_STATUS}, ' X') AS http_status_line", f"{http} AS http_headers",
        "cast(NULL AS string) AS method", "cast(NULL AS string) AS urlkey", "octet_length(html) AS payload_length", "cast(NULL AS string) AS parse_error",
    )


_CAPS = f"(SELECT *, {_TYPE} AS rec_type, {_KEY} AS path, {_STATUS} AS status, {_TO} AS location, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url ELSE 'http://' || {_HOST} || '/to/' || page_id % 11 END AS refers, {_HOST} AS host FROM pages WHERE {_TYPE} <> 'request')"


@query(f"SELECT page_id, rec_type, path, CASE rec_type WHEN 'response' THEN status END AS status, {_MIME} AS mime, CASE page_id % 3 WHEN 0 THEN 'utf-8' END AS charset, {_CT} AS content_type, ({_DATE})[:10] AS day FROM {_CAPS}")
def captured(spark, d):
    c = C.captures(_records(spark, d))
    return c.select(F.col("rec_idx").cast("long").alias("page_id"), "rec_type", "path", "status", "mime", "charset", "content_type", F.col("date").cast("string").alias("day"))


@query(f"SELECT DISTINCT path FROM {_CAPS} WHERE rec_type = 'response' AND status IN (200, 201)")
def captured_expected(spark, d):
    return C.expected(C.captures(_records(spark, d)))


@query(f"SELECT path AS src, arg_min(host || location, page_id) AS dst FROM {_CAPS} WHERE rec_type = 'response' AND status IN (301, 302) AND starts_with(location, '/') AND host || location <> path GROUP BY path")
def captured_redirects(spark, d):
    """Empty locations and those that lead to the same key are none."""
    return C.redirects(C.captures(_records(spark, d))).select("src", "dst")


@query(f"SELECT path, arg_min(page_id, page_id) AS page_id, arg_min({_MIME}, page_id) AS mime FROM {_CAPS} WHERE rec_type = 'response' AND status IN (200, 201) AND suffix(regexp_extract(url, '://([^/?#]*)', 1), '.com') GROUP BY path")
def captured_items(spark, d):
    return C.items(C.captures(_records(spark, d)), [".com"]).select("path", F.col("rec_idx").cast("long").alias("page_id"), "mime")


@query(f"SELECT path AS src, arg_min(host || regexp_extract(refers, '://[^/]*(/.*)$', 1), page_id) AS dst FROM {_CAPS} WHERE rec_type = 'revisit' AND refers IS NOT NULL AND refers <> url GROUP BY path")
def captured_revisits(spark, d):
    return C.revisits(C.captures(_records(spark, d)), []).select("src", "dst")


@query(f"""WITH r AS (SELECT path AS src, arg_min(host || regexp_extract(refers, '://[^/]*(/.*)$', 1), page_id) AS dst FROM {_CAPS} WHERE rec_type = 'revisit' AND refers IS NOT NULL AND refers <> url GROUP BY path),
i AS (SELECT host || '/to/' || page_id % 11 AS path FROM {_CAPS} WHERE page_id % 2 = 0), e AS (SELECT path AS src FROM {_CAPS} WHERE page_id % 8 = 3)
SELECT src, dst FROM r WHERE src NOT IN (SELECT path FROM i UNION ALL SELECT src FROM e) AND dst IN (SELECT path FROM i)""")
def captured_aliases(spark, d):
    """Every other capture's /to/n stands for an entry, and every eighth key for a redirect, in both engines."""
    c = C.captures(_records(spark, d))
    entries = c.where("rec_idx % 2 = 0").select(F.concat(U.hostname(F.col("url")), F.lit("/to/"), (F.col("rec_idx") % 11).cast("string")).alias("path"))
    return C.aliases(C.revisits(c, []), entries, c.where("rec_idx % 8 = 3").select(F.col("path").alias("src")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 48 ELSE p_size END AS width, CASE WHEN p_size % 3 = 0 THEN 48 ELSE (p_partkey % 60 + 1)::INT END AS height, CASE WHEN p_size % 3 = 0 THEN 'svg' ELSE 'png' END AS kind FROM part")
def icon_probe(spark, d):
    """Sizes read back from the heads of images."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from archloom.functions.icons import probe

    @F.arrow_udf(StructType([StructField("kind", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
    def read(sizes: pa.Array, keys: pa.Array) -> pa.Array:
        rows = []
        for w, k in zip(sizes.to_pylist(), keys.to_pylist()):
            png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, k % 60 + 1) + b"\x08\x06\0\0\0"
            rows.append(dict(zip(("kind", "width", "height"), probe(b"<svg xmlns='http://www.w3.org/2000/svg'/>" if w % 3 == 0 else png))))
        return pa.array(rows, pa.struct([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))

    out = table(spark, d, "part").select("p_partkey", read("p_size", "p_partkey").alias("r"))
    return out.select("p_partkey", "r.width", "r.height", F.lower("r.kind").alias("kind"))


@query(f"SELECT page_id, url, 'response' AS rec_type, CASE WHEN page_id % 2 = 0 THEN {_STATUS} ELSE 200 END AS status, strlen(html)::BIGINT AS payload_length, sha256(html) AS payload_sha, CASE WHEN page_id % 5 = 0 THEN 'POST' END AS method FROM pages")
def archive_round_trip(spark, d):
    """Archives of gzip members written from the pages, requests beside every fifth response, read back by the WARC source."""
    from archloom.operators.staging import new_folder
    from archloom.sources.warc import read_warc, write_archives

    p = table(spark, d, "pages").select("page_id", "url", "html", F.expr(f"CASE WHEN page_id % 2 = 0 THEN {_STATUS} ELSE 200 END").alias("status"), F.expr("CASE WHEN page_id % 5 = 0 THEN concat('id=', page_id) END").alias("posted"))
    folder = new_folder(spark, "archives")
    n = write_archives(p, folder, "page_id", "url", "html", "status", "posted")
    assert n == p.count()
    r = read_warc(spark, [folder], types="response")
    uri = C.header("rec_headers", "warc-target-uri")
    page = F.substring_index(F.regexp_replace(C.header("rec_headers", "warc-record-id"), ">$", ""), ":", -1).cast("long")
    return r.select(page.alias("page_id"), uri.alias("url"), "rec_type", H.status_code(F.col("http_status_line")).alias("status"), "payload_length", F.sha2("payload", 256).alias("payload_sha"), "method")
