import gzip
import json

import pytest
from pyspark.sql import functions as F

from archloom.cli import run
from archloom.config import Config, from_args
from archloom.operators import captures as C
from archloom.operators.graph import closure
from archloom.plans.conversion import Unprocessable, convert, main_page
from archloom.sources.warc import files_of, ordered, paired, read_warc, records, write_record

from .warcs import Archive, http

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (48).to_bytes(4, "big") * 2 + b"rest"
SVG = b"<svg xmlns='x'></svg>"


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    """A small site: redirects of all kinds, revisits, duplicates, a POST, modules, icons, other hosts."""
    d = tmp_path_factory.mktemp("site")
    a = Archive(str(d / "b-second.warc.gz"))
    a.add("warcinfo", block=b"software: Crawler 1.0\r\nformat: WARC\r\n", ctype="application/warc-fields")
    a.page("http://s.test/", "<html lang=fr><head><title>Main</title><link rel=icon href=/i.png><link rel=icon href=/i.svg></head><a href=/two?x=1>t</a><a href=/gone>g</a><script type=module src=/m.js></script>")
    a.page("https://s.test:443/two?x=1", "<title>Two</title>")
    a.page("http://s.test/two?x=1", "later, ignored")
    a.page("http://s.test/404", "no", status=404)
    a.page("http://s.test/306", "no", status=306)
    a.page("http://s.test/201", "yes", status=201)
    a.add("response", "http://s.test/r1", http(301, Location="/r2"))
    a.add("response", "http://s.test/r2", http(308, Location="/two?x=1"))
    a.add("response", "http://s.test/l1", http(302, Location="/l2"))
    a.add("response", "http://s.test/l2", http(302, Location="/l1"))
    a.add("response", "http://s.test/lost", http(302, Location="http://away.test/"))
    a.add("response", "http://s.test/self", http(302, Location="https://s.test/self#x"))
    a.add("response", "http://s.test/bad", http(302, Location="intent://x"))
    a.add("response", "http://s.test/void", http(302))
    a.add("revisit", "http://s.test/copy", http(), WARC_Refers_To_Target_URI="http://s.test/two?x=1")
    a.add("revisit", "http://s.test/two?x=1", http(), WARC_Refers_To_Target_URI="http://s.test/")
    a.add("revisit", "http://s.test/odd", http(), WARC_Refers_To_Target_URI="http://s.test/404")
    a.add("revisit", "http://s.test/nowhere", http())
    a.page("http://s.test/empty", "")
    a.page("http://s.test/empty", "too late")
    a.page("http://s.test/m.js", "import './n.js'; window.q = 1", mime="text/javascript")
    a.page("http://s.test/n.js", "export let n = 1", mime="text/javascript")
    a.page("http://s.test/i.png", PNG, mime="image/png")
    a.page("http://s.test/i.svg", SVG, mime="image/svg+xml")
    a.page("http://nots.test/", "<title>other host</title>")
    q = a.add("request", "http://s.test/api", b"POST /api HTTP/1.1\r\nContent-Type: application/json\r\nContent-Length: 7\r\n\r\n" + b'{"k":1}')
    a.add("response", "http://s.test/api", http(mime="text/html", body=b"<a href=/two?x=1>raw</a>"), WARC_Concurrent_To=q, date=5)
    a.page("http://s.test/latin", "café".encode("latin-1"), mime="text/html; charset=iso-8559-1")
    a.add("resource", "http://s.test/res", b"no", ctype="text/plain")
    return d


def table(t, *columns):
    return sorted(tuple(r) for r in t.select(*columns).collect())


def test_conversion(spark, site):
    out = convert(spark, Config(inputs=[str(site)], name="n", tags="a; b;;a", scraper_suffix=" x "))
    items = {r.path: r for r in out["items"].collect()}
    assert set(items) - {"_static/wombat.js", "_static/wombatSetup.js", "_static/__wb_module_decl.js"} == {
        "s.test/", "s.test/two?x=1", "s.test/201", "s.test/m.js", "s.test/n.js", "s.test/i.png", "s.test/i.svg", "nots.test/", "s.test/api?__wb_method=POST&k=1", "s.test/latin",
    }
    assert items["s.test/two?x=1"].title == "Two" and b"later" not in bytes(items["s.test/two?x=1"].content)
    main = bytes(items["s.test/"].content).decode()
    assert 'href="./two%3Fx%3D1"' in main or 'href="two%3Fx%3D1"' in main
    assert 'href="/gone"' in main and items["s.test/"].title == "Main" and items["s.test/"].is_front and not items["s.test/m.js"].is_front
    assert b"__wb_module_decl" in bytes(items["s.test/m.js"].content) and b"__wb_module_decl" in bytes(items["s.test/n.js"].content)
    assert bytes(items["s.test/api?__wb_method=POST&k=1"].content) == b"<a href=/two?x=1>raw</a>" and bytes(items["s.test/i.png"].content) == PNG
    assert "café" in bytes(items["s.test/latin"].content).decode()
    assert table(out["edges"], "path", "target", "kind") == [("s.test/copy", "s.test/two?x=1", "alias"), ("s.test/r1", "s.test/r2", "redirect"), ("s.test/r2", "s.test/two?x=1", "redirect")]
    meta = {k: bytes(v) for k, v in out["metadata"].collect()}
    assert meta["Title"] == b"Main" and meta["Language"] == b"fra" and meta["Scraper"] == b"archloom, Crawler 1.0, x" and meta["X-ContentDate"] == b"2021-03-01,2021-03-05" and meta["Tags"] == b"_ftindex:yes;_category:other;a;b" and meta["Illustration"] == PNG
    assert [r.stage for r in out["errors"].collect()] == ["revisit"]


def test_domains_and_main_page(spark, site):
    out = convert(spark, Config(inputs=[str(site)], name="n", include_domains=["://no", "x.s.test", "nots.test"], url="http://s.test/r1", lang="it", favicon="http://s.test/i.svg"))
    assert {r.path for r in out["items"].where("kind = 'payload'").collect()} == {"nots.test/"}
    assert {r.path for r in out["edges"].collect()} == {"s.test/r1", "s.test/r2"}
    meta = {k: bytes(v) for k, v in out["metadata"].collect()}
    assert meta["MainPath"] == b"s.test/r2" and meta["Language"] == b"ita" and meta["Illustration"] == SVG
    for bad in ("http://s.test/404", "http://none.test"):
        with pytest.raises(Unprocessable):
            convert(spark, Config(inputs=[str(site)], name="n", url=bad))


def test_failed_captures_give_way(spark, tmp_path):
    a = Archive(str(tmp_path / "f.warc"))
    a.page("http://s.test/", "<head></head><a href=/gone>x</a>")
    a.page("http://s.test/a", "one", mime="text/html; charset=no-such")
    a.page("http://s.test/a", "two")
    a.page("http://s.test/b", "three", mime="text/html; charset=no-such")
    css = tmp_path / "c.css"
    css.write_text("a{}")
    with pytest.raises(ValueError):
        convert(spark, Config(inputs=[a.path], name="n"))
    out = convert(spark, Config(inputs=[a.path], name="n", continue_on_error=True, custom_css=str(css), verbose=True))
    items = {r.path: bytes(r.content) for r in out["items"].collect()}
    assert b"two" in items["s.test/a"] and "s.test/b" not in items and items["_static/custom.css"] == b"a{}" and b"_static/custom.css" in items["s.test/"]
    assert sorted(r.url for r in out["errors"].collect()) == ["http://s.test/a", "http://s.test/b"] and [r.path for r in out["missing"].collect()] == ["s.test/gone"]


def test_digests(spark, tmp_path):
    import hashlib

    from archloom.sources.warc import digest_of

    a = Archive(str(tmp_path / "d.warc"))
    a.page("http://s/", "x")
    raw = open(a.path, "rb").read()
    want = "sha256:" + hashlib.sha256(raw).hexdigest()
    assert read_warc(spark, [a.path], digest="true").first().digest == want
    with pytest.raises(ValueError):
        digest_of(a.path, 0, len(raw) + 1)


def test_main_page_states():
    row = {"rec_type": "response", "status": 200, "ok": True, "mime": "text/html", "payload_length": 9, "location": None}
    at = lambda path, **more: row | {"path": path, "url": f"http://{path}"} | more
    assert main_page([at("s/css", mime="text/css"), at("s/e", payload_length=0), at("s/a"), at("s/b")], None)[0] == "s/a"
    moved = at("s/a", status=302, location="/b")
    assert main_page([moved, at("s/b")], "s/a")[0] == "s/b" and main_page([at("s/b"), moved], "s/a") is None
    assert main_page([at("s/a", status=308, location="/b"), at("s/b")], "s/a")[0] == "s/a"
    assert main_page([at("s/a", rec_type="revisit"), at("s/a", mime="image/png")], "s/a")[1]["mime"] == "image/png"
    with pytest.raises(ValueError):
        main_page([at("s/a", status=403, ok=False)], "s/a")


def test_command_line(spark, site, tmp_path):
    c = from_args(["--name", "n", "-i", "a", "-i", "b", "--charsets-to-try", "utf-8, gbk", "--encoding-aliases", "X=Y", str(site)])
    assert c.include_domains == ["a", "b"] and c.charsets_to_try == ["utf-8", "gbk"] and c.encoding_aliases == {"x": "y"} and c.inputs == [str(site)]
    assert run(Config(name="n"), spark) == 100 and run(Config(inputs=["x"], name="n", output="/no/such"), spark) == 1
    assert run(Config(inputs=["x"], name="n", output=str(tmp_path), file_name="no/such/folder"), spark) == 3
    with pytest.raises(ValueError):
        run(Config(name="n", title="t" * 31), spark)
    done = Config(inputs=[str(site)], name="n", output=str(tmp_path), file_name="out", progress_file=str(tmp_path / "p.json"))
    assert run(done, spark) == 0 and run(done, spark) == 2
    n = spark.read.parquet(f"{tmp_path}/out/items").count()
    assert json.loads((tmp_path / "p.json").read_text()) == {"written": n, "total": n}
    a = Archive(str(tmp_path / "e.warc"), False)
    a.page("http://s.test/", "x", status=403)
    assert run(Config(inputs=[a.path], name="n", output=str(tmp_path), file_name="e"), spark) == 4


def test_order_of_files(tmp_path):
    for p in ("z/a.warc", "a/b.arc.gz", "b/a.warc", "c/x.WARC", "c/t.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    assert [f[len(str(tmp_path)) + 1 :] for f in ordered(files_of([str(tmp_path)]))] == ["b/a.warc", "z/a.warc", "a/b.arc.gz"]
    assert files_of(["nowhere.bin"]) == ["nowhere.bin"]


def test_parser(tmp_path):
    body = b"hello " * 100
    chunked = b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    for compress in (True, False):
        a = Archive(str(tmp_path / f"{compress}.warc"), compress)
        a.page("http://s/", gzip.compress(body), Content_Encoding="gzip")
        a.add("response", "http://s/c", http(body=chunked, Transfer_Encoding="chunked"))
        a.add("response", "http://s/b", http(body=b"??", Content_Encoding="br"))
        a.add("response", "http://s/x", http(status="abc", mime=None))
        rs = list(records(a.path))
        assert [r.payload for r in rs] == [body, body, b"??", b""] and "br" in rs[2].error and rs[3].status_line == "HTTP/1.1 abc X"
        raw = open(a.path, "rb").read()
        assert all(raw[r.offset : r.offset + r.length] for r in rs) and rs[1].offset > rs[0].offset == 0
        open(a.path, "wb").write(raw[:-30])
        cut = list(records(a.path))
        assert len(cut) == 4 and cut[3].error or cut[2].error
    arc = b"filedesc://x 0.0.0.0 20200101000000 text/plain 5\n1 0 x\n\nhttp://s/ 1.2.3.4 20200102030405 text/html 38\nHTTP/1.0 200 OK\nContent-Type: a/b\n\nhey\n\n"
    (tmp_path / "x.arc").write_bytes(arc)
    rs = list(records(str(tmp_path / "x.arc")))
    assert rs[1].payload.startswith(b"hey") and rs[1].get("warc-date") == "2020-01-02T03:04:05Z" and rs[1].http_get("content-type") == "a/b"
    (tmp_path / "junk.warc").write_bytes(b"junk\n")
    assert [r.error is not None for r in records(str(tmp_path / "junk.warc"))] == [True]


def test_pairs_are_greedy(tmp_path):
    a = Archive(str(tmp_path / "p.warc"))
    post = b"POST / HTTP/1.1\r\nContent-Type: application/x-www-form-urlencoded\r\nContent-Length: 3\r\n\r\nn=1"
    for order in ("request response", "response request", "response request response"):
        last = None
        for kind in order.split():
            last = a.add(kind, "http://s/" + order.replace(" ", ""), post if kind == "request" else http(body=b"x"), **({"WARC_Concurrent_To": last} if last else {}))
    keys = [r.urlkey is not None for r in paired(records(a.path)) if r.rec_type == "response"]
    assert keys == [True, True, True, False]


def test_source_options(spark, site):
    r = read_warc(spark, [str(site)], payload="false", types="response,revisit")
    assert {x.rec_type for x in r.select("rec_type").distinct().collect()} == {"response", "revisit"} and r.where("payload IS NOT NULL").count() == 0
    caps = C.captures(read_warc(spark, [str(site)]).repartition(5))
    assert table(C.redirects(caps), "src", "dst")[0] == ("s.test/l1", "s.test/l2") and caps.where("status = 306").count() == 1


def test_closure(spark):
    import random

    rng = random.Random(1)
    for _ in range(3):
        edges = {i: rng.randrange(60) for i in rng.sample(range(60), 45)} | {i: i + 1 for i in range(100, 160)}
        edges = {a: b for a, b in edges.items() if a != b}
        has = set(rng.sample(range(60), 8)) | {160}

        def walk(s):
            if s in has:
                return "already_expected"
            seen, at = set(), s
            while at in edges and at not in has:
                if at in seen:
                    return "loop"
                seen.add(at)
                at = edges[at]
            return "ok" if at in has else "missing_target"

        got = closure(spark.createDataFrame(list(edges.items()), "src long, dst long"), spark.createDataFrame([(h,) for h in has], "path long"))
        assert {r.src: r.reason for r in got.collect()} == {s: walk(s) for s in edges}


def test_adjacent_pairs(spark):
    rows = [("c", i, r) for i, r in enumerate("aabbabab")] + [("d", 0, "b"), ("d", 1, "a")] + [("e", i, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, n int, r string")
    assert table(C.adjacent_pairs(df, "g", "n", F.col("r") == "a", F.col("r") == "b"), "g", "n", "next_n") == [("c", 1, 2), ("c", 4, 5), ("c", 6, 7)]
    any_two = C.adjacent_pairs(df.where("g = 'e'"), "g", "n", F.lit(True), F.lit(True))
    assert table(any_two, "n", "next_n") == [(0, 1), (2, 3)]


def test_streams(spark, tmp_path):
    from archloom.streaming.ingest import first_in_window, status_counts

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 200), ("a", "2024-01-01 00:05:00", 404), ("b", "2024-01-01 02:00:00", 200)], "k string, ts string, status int").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    for f, n in ((lambda s: first_in_window(s, "k", "ts"), 2), (lambda s: status_counts(s, "ts", "status"), 2)):
        stream = spark.readStream.schema("k string, ts timestamp, status int").parquet(src)
        q = f(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{n}{id(f)}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table("out").count() <= 3


def test_write_record_is_read_back(tmp_path):
    p = tmp_path / "w.warc"
    p.write_bytes(write_record("metadata", {"WARC-Target-URI": "http://x/"}, b"m", False))
    assert [(r.rec_type, r.payload) for r in records(str(p))] == [("metadata", b"m")]
