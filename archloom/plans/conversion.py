"""From archives to entries: the whole conversion as one plan."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.functions import rewrite as R
from archloom.functions.charset import to_text
from archloom.functions.url import normalize, resolve
from archloom.operators.graph import closure
from archloom.operators.staging import cut_lineage


def page_links(url: str, text: str, mode: str) -> set[str]:
    """Keys that a document links to: what is looked up in the archive."""
    found: set[str] = set()

    def has(key: str) -> bool:
        found.add(key)
        return False

    _rewritten(url, text, mode, has, False, False)
    return found


def _rewritten(url: str, text: str, mode: str, has, module: bool, custom_css: bool) -> tuple[str, str, set[str]]:
    modules: set[str] = set()
    if mode == "html":
        return R.html(text, url, has, custom_css)
    if mode == "css":
        return "", R.css(text, R.Archive(url, has)), modules
    if mode == "javascript":
        return "", R.javascript(text, R.Archive(url, has), module, modules), modules
    return "", text, modules


def links_of(rows: DataFrame, **decoding) -> DataFrame:
    """rows (path, url, content, mode, charset) -> (path, target): distinct keys each document links to; documents that can't be decoded have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, t = [], []
            for path, url, content, mode, charset in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    links = page_links(url, to_text(content, charset, sniff=mode == "html", **decoding), mode)
                except (ValueError, LookupError):
                    continue
                a += [path] * len(links)
                t += sorted(links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(t, pa.string())], ["path", "target"])

    return rows.where(F.col("mode").isin("html", "css", "javascript")).select("path", "url", "content", "mode", "charset").mapInArrow(run, "path string, target string")


def rewrite_pages(rows: DataFrame, has: DataFrame, modules: DataFrame | None = None, custom_css: bool = False, **decoding) -> DataFrame:
    """rows (seq, url, path, content, mode, charset), has (path) -> (seq, path, title, content, error).

    Links are exploded and joined with the archive's keys, and each document gets the list of those that it has: the
    keys are never broadcast as a whole. What can't be decoded comes back with an error and no content.
    """
    links = links_of(rows, **decoding)
    known = links.join(has.select(F.col("path").alias("target")).distinct(), "target", "left_semi").groupBy("path").agg(F.collect_set("target").alias("known"))  # of one document: bounded by its length
    joined = rows.join(known.withColumnRenamed("path", "__p"), F.col("path") == F.col("__p"), "left").drop("__p")
    if modules is not None:
        joined = joined.join(modules.select(F.col("path").alias("__m")).distinct(), F.col("path") == F.col("__m"), "left").withColumn("module", F.col("__m").isNotNull()).drop("__m")
    else:
        joined = joined.withColumn("module", F.lit(False))
    source = joined.select("seq", "path", "url", "content", "mode", "charset", "known", "module")
    kind = source.schema["seq"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, contents, errors = [], [], []
            for path, url, content, mode, charset, known, module in zip(*(c.to_pylist() for c in b.columns[1:])):
                title, out, error = "", content, None
                if mode != "none":
                    try:
                        text = to_text(content, charset, sniff=mode == "html", **decoding)
                        title, text, _ = _rewritten(url, text, mode, set(known or ()).__contains__, module, custom_css)
                        out = text.encode("utf-8", "surrogatepass")
                    except (ValueError, LookupError) as e:
                        out, error = None, str(e)
                titles.append(title)
                contents.append(out)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(titles, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["seq", "path", "title", "content", "error"])

    return source.mapInArrow(run, f"seq {kind}, path string, title string, content binary, error string")


def modules_of(rows: DataFrame, **decoding) -> DataFrame:
    """Keys of JavaScript modules: those that pages name, and all that modules import, found in rounds until none is new."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[str] = set()
            for url, content, charset in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    out |= R.html(to_text(content, charset, **decoding), url, lambda k: False)[2]
                except (ValueError, LookupError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["path"])

    def imports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs: list[tuple[str, str]] = []
            for path, url, content, charset in zip(*(c.to_pylist() for c in b.columns)):
                found: set[str] = set()
                try:
                    R.javascript(to_text(content, charset, sniff=False, **decoding), R.Archive(url, lambda k: False), True, found)
                except (ValueError, LookupError):
                    continue
                pairs += [(path, f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["src", "dst"])

    now = rows.where("mode = 'html'").select("url", "content", "charset").mapInArrow(named, "path string").distinct()
    edges = rows.where("mode = 'javascript'").select("path", "url", "content", "charset").mapInArrow(imports, "src string, dst string").distinct()
    now, edges, n = cut_lineage(now), cut_lineage(edges), -1
    while (size := now.count()) != n:
        n = size
        now = cut_lineage(now.union(edges.join(now, edges.src == now.path, "left_semi").select("dst")).distinct())
    return now


def main_page(candidates: list[dict], wanted: str | None) -> tuple[str, dict] | None:
    """Follows the order of capture to the main page: (key, its row), None if there is none; ValueError if the wanted one can't be used.

    candidates: rows in order, with path, url, rec_type, status, ok, location, mime, payload_length. Redirects are followed forward only; a 308 counts as a page.
    """
    main = wanted
    for c in candidates:
        if not c["ok"]:
            if c["rec_type"] == "response" and main is not None and c["path"] == main:
                raise ValueError(f"the main page {main} has status {c['status']}")
            continue
        if c["rec_type"] == "revisit":
            continue
        if main is None and c["mime"] == "text/html" and c["payload_length"] and c["status"] in (200, None):
            main = c["path"]
        if main is None or c["path"] != main:
            continue
        if c["status"] in (301, 302, 307):
            main = normalize(resolve(c["url"], c["location"])) or main
            continue
        return main, c
    return None


class Unprocessable(Exception):
    """The input has no main page, or nothing to show: exit code 4."""


def convert(spark, config) -> dict[str, DataFrame]:
    """Reads config.inputs and returns the tables items, edges, metadata and errors. Nothing is written but staged intermediate tables.

    With config.verbose also missing: keys that links lead to and the archive hasn't.

    items: path, title, mimetype, content, is_front, kind, seq; edges: path, target, kind (redirect, alias); metadata: key, value; errors: seq, url, stage, message.
    """
    from archloom.functions import headers as H
    from archloom.functions.html import cut_title, read_head
    from archloom.functions.icons import Icon, ordered, probe
    from archloom.functions.lang import parse_language
    from archloom.operators import captures as C
    from archloom.operators.metadata import DEFAULT_TAGS
    from archloom.sources.warc import read_warc

    records = read_warc(spark, config.inputs, payload="false")
    caps = cut_lineage(C.captures(records))  # headers alone: read often, so kept
    has, edges = C.expected(caps), cut_lineage(C.redirects(caps))
    bad = caps.where("path IS NULL").select("seq", "url", F.lit("url").alias("stage"), F.lit("the URL has no key").alias("message"))
    lost = caps.where("rec_type = 'revisit' AND refers_to IS NULL").select("seq", "url", F.lit("revisit").alias("stage"), F.lit("it refers to nothing").alias("message"))
    broken = records.where("parse_error IS NOT NULL").select(F.struct("file_rank", "rec_idx").alias("seq"), F.col("file_path").alias("url"), F.lit("read").alias("stage"), F.col("parse_error").alias("message"))
    if has.isEmpty():
        raise Unprocessable("no entry")
    kept = closure(edges.select("src", "dst"), has).where("reason IN ('ok', 'already_expected')")
    redirect = edges.join(kept.select("src"), "src", "left_semi").select("src", "dst")

    # The main page: candidates stream in order to the driver, which stops at the page; only one is held at a time.
    wanted = normalize(config.url if config.url and config.url.count("/") > 2 else f"{config.url}/") if config.url else None
    chosen = caps.where("path IS NOT NULL").select("seq", "path", "url", "rec_type", "status", "location", "mime", "payload_length", "charset", "has_http", (H.processable(F.col("status")) | ((F.col("rec_type") == "response") & ~F.col("has_http"))).alias("ok"))
    if wanted is None:
        relevant = chosen.where("ok AND rec_type = 'response' AND mime = 'text/html' AND payload_length > 0 AND (status = 200 OR status IS NULL)").orderBy("seq").limit(1)
    else:
        relevant = chosen.where(F.col("path").isin(_reach(caps, wanted)))
    try:
        found = main_page((r.asDict() for r in relevant.orderBy("seq").toLocalIterator()), wanted)
    except ValueError as e:
        raise Unprocessable(str(e)) from e
    if not found:
        raise Unprocessable("no main page")
    main, row = found

    full = read_warc(spark, config.inputs, types="response").select("file_rank", "rec_idx", "payload")
    # Payloads meet their winners by place, after all that decides who wins.
    decoding, among, body, done, failed = config.decoding(), caps, None, None, None
    targets = has.union(redirect.select("src"))
    while True:
        winners = C.items(among, config.include_domains).withColumn("mode", H.rewrite_mode(F.col("resource_type"), F.col("mime"), F.col("method"), F.col("path")))
        placed = winners.drop("rec_idx").withColumn("file_rank", F.col("seq.file_rank")).withColumn("rec_idx", F.col("seq.rec_idx"))
        new = cut_lineage(placed.join(full, ["file_rank", "rec_idx"]).select("seq", "url", "path", F.col("payload").alias("content"), "mode", "charset", "mime"))
        body = new if body is None else body.union(new)
        made = rewrite_pages(new, targets, modules_of(body, **decoding), bool(config.custom_css), **decoding)
        made = cut_lineage(made.join(new.select("path", "mime", "url"), "path"))
        lost_now = made.where("error IS NOT NULL")
        done = made if done is None else done.union(made)
        failed = lost_now.select("seq", "url", F.lit("rewrite").alias("stage"), F.col("error").alias("message")) if failed is None else failed.union(lost_now.select("seq", "url", F.lit("rewrite"), "error"))
        if lost_now.isEmpty():
            break
        if not config.continue_on_error:
            first = lost_now.orderBy("seq").first()
            raise ValueError(f"{first.url}: {first.error}")
        # A capture that fails doesn't claim its key: the next one of the key has its turn.
        among = cut_lineage(among.join(lost_now.select("path").distinct(), "path", "left_semi").join(lost_now.select("seq"), "seq", "left_anti"))
    mime = F.when(F.col("mime") == "", "application/octet-stream").otherwise(F.col("mime"))
    item = done.where("error IS NULL AND length(content) > 0").select("path", "title", mime.alias("mimetype"), "content", H.is_front(F.col("mime")).alias("is_front"), F.lit("payload").alias("kind"), "seq")
    statics = [(f"_static/{n}", "", "text/javascript", b"// provided by the reader\n", False, "static", None) for n in ("wombat.js", "wombatSetup.js", "__wb_module_decl.js")]
    if config.custom_css:
        statics.append(("_static/custom.css", "", "text/css", _read(config.custom_css), False, "static", None))
    item = item.unionByName(spark.createDataFrame(statics, item.schema))
    claimed = done.where("error IS NULL").select("path")  # an empty entry isn't written, but its key is taken
    alias = C.aliases(C.revisits(caps, config.include_domains), claimed, redirect)
    taken = redirect.join(claimed.withColumnRenamed("path", "src"), "src", "left_anti")
    edge = taken.select(F.col("src").alias("path"), F.col("dst").alias("target"), F.lit("redirect").alias("kind")).union(alias.select("src", "dst", F.lit("alias")))

    page, head = body.where(F.col("path") == main).select("content", "charset").first(), {"title": "", "icons": [], "lang": None}
    if page is not None and row["mime"] in H.HTML_TYPES:
        head = read_head(to_text(page.content, page.charset, **decoding))
    icons = [normalize(resolve(row["url"], i)) for i in ([config.favicon] if config.favicon else head["icons"] or ["/favicon.ico"])]
    images = []
    for r in last_bodies(caps, full, [i for i in icons if i], row["seq"]):
        if shape := probe(bytes(r.payload)):
            images.append(Icon(r.path, shape[1], shape[2], bytes(r.payload), shape[0]))
    images = sorted(images, key=lambda i: icons.index(i.url))
    day = H.warc_date(C.header("rec_headers", "warc-date"))  # of all responses and revisits, whatever their URL
    dates = records.where(F.col("rec_type").isin("response", "revisit")).agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("a"), F.date_format(F.max(day), "yyyy-MM-dd").alias("b")).first()
    soft = records.where("rec_type = 'warcinfo'").select(F.struct("file_rank", "rec_idx").alias("seq"), "file_path", "rec_idx").agg(F.min("seq")).first()[0]
    software = _software(config.inputs, soft)
    title = spark.range(1).select(cut_title(F.lit(config.title or head["title"]))).first()[0]
    values = {
        "Name": config.name, "Title": title, "Language": parse_language(config.lang or head["lang"] or ""), "Description": config.description, "LongDescription": config.long_description, "Creator": config.creator, "Publisher": config.publisher,
        "Source": config.source, "Tags": ";".join(dict.fromkeys([*DEFAULT_TAGS, *[t.strip() for t in config.tags.split(";") if t.strip()]])), "Scraper": ", ".join(x for x in ("archloom", software, config.scraper_suffix.strip()) if x),
        "X-ContentDate": None if dates.a is None else dates.a if dates.a == dates.b else f"{dates.a},{dates.b}", "MainPath": main,
    }
    rows = [(k, v.encode()) for k, v in values.items() if v]
    if best := next(iter(ordered(images)), None):
        rows.append(("Illustration", best.content))
    out = {"items": item, "edges": edge, "metadata": spark.createDataFrame(rows, "key string, value binary"), "errors": bad.union(lost).union(broken).union(failed)}
    if config.verbose:
        out["missing"] = links_of(body, **decoding).select(F.col("target").alias("path")).join(targets, "path", "left_anti").distinct()
    return out


def _read(place: str) -> bytes:
    """A local file, or what an http(s) URL gives within ten seconds."""
    if place.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(place, timeout=10) as r:
            return r.read()
    with open(os.path.expanduser(place), "rb") as f:
        return f.read()


def _reach(caps: DataFrame, start: str) -> list[str]:
    """The keys that any capture of one key, or of those it redirects to, leads to: a lookup by key each step."""
    moves = caps.where(F.col("status").isin(301, 302, 307) & F.col("location").isNotNull()).select("path", "url", "location")
    seen, front = {start}, [start]
    while front:
        rows = moves.where(F.col("path").isin(front)).distinct().collect()  # the redirects of a few keys
        front = sorted({k for r in rows if (k := normalize(resolve(r.url, r.location)))} - seen)
        seen |= set(front)
    return sorted(seen)


def last_bodies(caps: DataFrame, full: DataFrame, paths: list[str], after) -> list:
    """(path, payload) of the last capture of each of some paths, after a place in the order."""
    if not paths:
        return []
    rows = caps.where(F.col("path").isin(paths) & (F.col("rec_type") == "response") & (F.col("status") == 200) & (F.col("seq") > F.struct(F.lit(after[0]), F.lit(after[1]))))
    last = rows.groupBy("path").agg(F.max("seq").alias("seq")).select("path", F.col("seq.file_rank").alias("file_rank"), F.col("seq.rec_idx").alias("rec_idx"))
    return last.join(full, ["file_rank", "rec_idx"]).select("path", "payload").collect()  # a handful of icons


def _software(inputs: list[str], seq) -> str | None:
    """The software line of the first warcinfo."""
    from archloom.sources.warc import files_of, ordered, records

    if seq is None:
        return None
    for i, r in enumerate(records(ordered(files_of(inputs))[seq[0]])):
        if i == seq[1]:
            for line in r.payload.decode("utf-8", "replace").splitlines():
                name, _, value = line.partition(":")
                if name.strip() == "software":
                    return value.strip()
            return None
    return None
