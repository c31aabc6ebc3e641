import random
import time

import pytest
from pyspark.sql import functions as F

from headrow.functions.checks import encode_metrics
from headrow.sources import archive_tables as tables
from headrow.sources import candidates as cand
from headrow.sources import payloads as pay

RSS = """<?xml version="1.0"?><!-- c --><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>
<item><title> One &amp; two </title><link>https://e/1</link><guid isPermaLink="false">g1</guid><pubDate>Thu, 17 Sep 2026 08:00:00 GMT</pubDate></item>
<item><title>Two</title><link>https://e/2</link><dc:date>2026-09-17T09:00:00Z</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title type="text">T</title><updated>2026-09-17T09:00:00Z</updated>
<link rel="self" href="https://e/self"/><link href="https://e/a1"/></entry></feed>"""


def feeds(spark, texts):
    rows = [(i, bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)]
    return pay.classify_feed(spark.createDataFrame(rows, "run_id int, content binary"))


def test_feeds(spark):
    texts = [RSS, ATOM, "<!DOCTYPE x><rss/>", "<rss><channel><item>", "<html></html>", "plain", "<rss version='2'></rss>", b"<rss>\xff</rss>"]
    df = feeds(spark, texts)
    status = [r.status for r in df.orderBy("run_id").collect()]
    assert status == ["ok", "ok", "declaration", "malformed", "unsupported_root", "malformed", "no_channel", "bad_encoding"]
    rss = pay.extract_rss(df, ["run_id"]).orderBy("position").collect()
    assert [(r.title, r.url, r.external_id, r.position, r.published_at is not None) for r in rss] == [("One & two", "https://e/1", "g1", 1, True), ("Two", "https://e/2", None, 2, True)]
    atom = pay.extract_atom(df, ["run_id"]).collect()
    assert [(r.title, r.url, r.external_id, r.metrics) for r in atom] == [("T", "https://e/a1", "a1", '{"updated_at":"2026-09-17T09:00:00Z"}')]


def test_transform_hook(spark):
    out = pay.extract_rss(feeds(spark, [RSS]), ["run_id"], lambda d: d.withColumn("title", F.upper("title")))
    assert {r.title for r in out.collect()} == {"ONE & TWO", "TWO"}


def test_decode(spark):
    rows = [("中文".encode("gb18030"), "gb18030"), (b"\xff\xff", "utf-8"), ("é".encode(), "utf-8"), (b"\x81", "gb2312"), (None, "utf-8"), (b"x", "nope")]
    df = spark.createDataFrame([(i, None if a is None else bytearray(a), b) for i, (a, b) in enumerate(rows)], "i int, c binary, n string")
    assert [r[0] for r in df.orderBy("i").select(pay.decode_payload(F.col("c"), F.col("n"))).collect()] == ["中文", None, "é", None, None, None]


def test_json_listing_types(spark):
    text = '{"ok":1,"d":[{"id":7,"t":" A ","n":true},{"id":true,"t":"B"},3,{"id":"x","t":null,"b":"C"},{"id":"y","t":"Ad","ad":1}]}'
    spec = pay.JsonSpec(entries="$.d", title=("$.t", "$.b"), id="$.id", url_template="https://e/{id}", exclude=(("$.ad", ("1",)),), metrics=(("n", "$.n"),))
    entries, status = pay.extract_json_listing(spark.createDataFrame([(1, text), (2, "{"), (3, "{}")], "run_id int, text string"), spec, ["run_id"])
    assert [(r.title, r.external_id, r.usable, r.excluded) for r in entries.orderBy("entry_pos").collect()] == [
        ("A", "7", True, False), ("B", None, False, False), ("", None, False, False), ("C", "x", True, False), ("Ad", "y", True, True),
    ]
    assert {r.run_id: r.status for r in status.collect()} == {1: "ok", 2: "malformed", 3: "no_list"}


def test_html_listing(spark):
    html = """<div id="m"><div class="row hot"><h3><a href="/a/1.html">One</a></h3><time data-t="20260917080000">x</time></div>
    <div class="row"><a href="/a/1.html">Again</a></div><div class="row"><a>No href</a></div><p class="row"><a href="https://o/2">Two <b>x</b></a></p></div><div class="row"><a href="/out">Out</a></div>"""
    spec = pay.HtmlSpec(row="#m > .row, p.row", link="a[href]", time="time[data-t^='2026']", time_attr="data-t", base_url="https://e/", id_pattern=r"/a/(\d+)")
    rows = pay.extract_html_listing(spark.createDataFrame([(1, html), (2, None)], "run_id int, text string"), spec, ["run_id"]).orderBy("entry_pos").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "One", "https://e/a/1.html", "1", "20260917080000"), (1, "Two x", "https://o/2", None, None)]


def test_json_metrics_keep_their_types(spark):
    text = '{"d":[{"id":1,"t":"A","n":7,"f":1.5,"s":" x ","b":true,"a":["Infinity",{"c":null}],"z":null},{"id":2,"t":"B","n":1e999,"s":" "}]}'
    names = ("n", "f", "s", "b", "a", "z", "none")
    spec = pay.JsonSpec(entries="$.d", title=("$.t",), id="$.id", url_template="https://e/{id}", metrics=tuple((n, f"$.{n}") for n in names))
    rows = pay.extract_json_listing(spark.createDataFrame([(1, text), (2, text.replace('"Infinity",', ""))], "run_id int, text string"), spec, ["run_id"])[0]
    got = {(r.run_id, r.external_id): (r.metrics, r.ok) for r in rows.withColumn("ok", encode_metrics(F.col("metrics")).isNotNull()).collect()}
    assert got[1, "1"] == ('{"n":7,"f":1.5,"s":"x","b":true,"a":["Infinity",{"c":null}]}', True)
    assert got[2, "2"] == ('{"n":Infinity}', False)


def test_payload_status_fails_the_run(spark):
    spec = pay.JsonSpec(entries="$.d", title=("$.t",), id="$.id", url_template="https://e/{id}", envelope=("$.ok", "1"), exclude=(("$.ad", ("1",)),))
    texts = ['{"ok":1,"d":[{"id":1,"t":"A"}]}', "{broken", '{"ok":0,"d":[]}', '{"ok":1,"d":[]}', '{"ok":1,"d":[{"id":1}]}', '{"ok":1,"d":[{"id":1,"t":"Ad","ad":1}]}', '{"ok":1}']
    entries, status = pay.extract_json_listing(spark.createDataFrame(list(enumerate(texts)), "run_id int, text string"), spec, ["run_id"])
    two = status.unionByName(spark.createDataFrame([(0, "ok"), (7, "ok"), (7, "malformed")], "run_id int, status string"))
    got = {r.run_id: r.status for r in cand.extraction_status(entries, cand.eligible(entries), two).collect()}
    assert got == {0: "ok", 1: "failed", 2: "failed", 3: "ok", 4: "failed", 5: "ok", 6: "failed", 7: "failed"}


def test_unusable_entries_take_no_key_and_no_place(spark):
    rows = [(1, 0, 0, "2", "", False, False, 9), (1, 0, 1, "2", "B", True, False, 3), (1, 1, 2, "3", "Ad", True, True, 8), (1, 1, 3, "2", "C", True, False, 7), (1, 1, 4, "", "D", True, False, 6)]
    df = spark.createDataFrame(rows, "run_id int, payload_no int, entry_pos int, external_id string, title string, usable boolean, excluded boolean, published_at int").withColumn("url", F.lit(""))
    assert [r.title for r in cand.dedupe_in_payload(df, F.nullif(F.col("external_id"), F.lit(""))).orderBy("entry_pos").collect()] == ["B", "D"]
    assert [(r.position, r.title) for r in cand.merge_feeds_by_recency(df, 2).orderBy("position").collect()] == [(1, "C"), (2, "D")]
    assert [(r.position, r.title) for r in cand.merge_feeds_dedupe(df, 9).orderBy("position").collect()] == [(1, "B")]


def test_html_listing_is_linear(spark):
    html = "<ul>" + "<li><a href='/x'>t</a></b>" * 20_000 + "</ul>"
    spec = pay.HtmlSpec(row="ul > li", link="a[href]", base_url="https://e/")
    assert pay.extract_html_listing(spark.createDataFrame([(1, html)], "run_id int, text string"), spec, ["run_id"]).count() == 1


def test_archive_commits(spark, tmp_path):
    df = spark.createDataFrame([("s", "news")], "source_id string, surface string")
    root = f"{tmp_path}/a"
    with pytest.raises(ValueError, match="missing"):
        tables.read_archive(spark, root, ["source_surfaces"])
    tables.write_archive({"source_surfaces": df}, root)
    with pytest.raises(ValueError, match="surface"):  # checked before anything is written
        tables.write_archive({"source_surfaces": df.select("source_id")}, root)
    assert tables.read_archive(spark, root, ["source_surfaces"])["source_surfaces"].count() == 1


def test_run_outputs_are_all_or_none(spark, tmp_path):
    """A retry that fails half way leaves the committed attempt readable; one that ends replaces it."""
    one = spark.createDataFrame([("s", "news")], "source_id string, surface string")
    bad = one.withColumn("surface", F.raise_error(F.lit("lost")).cast("string"))
    root = f"{tmp_path}/runs"
    assert tables.read_committed(spark, root, "source_surfaces") is None
    with pytest.raises(Exception, match="lost"):
        tables.write_run_outputs(spark, root, "b1", {"source_surfaces": one, "sources": bad})
    assert tables.read_committed(spark, root, "source_surfaces") is None
    tables.write_run_outputs(spark, root, "b1", {"source_surfaces": one})
    reader = tables.read_committed(spark, root, "source_surfaces")
    with pytest.raises(Exception, match="lost"):
        tables.write_run_outputs(spark, root, "b1", {"source_surfaces": one.unionByName(one), "sources": bad})
    assert tables.read_committed(spark, root, "source_surfaces").count() == reader.count() == 1
    tables.write_run_outputs(spark, root, "b1", {"source_surfaces": one.unionByName(one)})
    tables.write_run_outputs(spark, root, "b2", {"source_surfaces": one})
    assert tables.read_committed(spark, root, "source_surfaces").count() == 3 and reader.count() == 1


@pytest.mark.parametrize("selector", ["b .a .a .a", "b > .a .a, .a > .a > .a .a > b", ".a .a .a .a .a .a a[href]"])
def test_selectors_are_linear_in_depth(selector):
    """Ten thousand nested tags, of which none or all match."""
    for page in ("<div class=a>" * 10_000, "<b>" + "<div class=a>" * 10_000 + "<a href=x>y</a>"):
        began = time.process_time()
        parsed = pay._Page(page)
        assert len(pay._places(parsed, pay._compile(selector))) in range(10_002)
        assert time.process_time() - began < 3


def test_selectors_equal_backtracking():
    """Against the plain meaning: a step's tag lies in one of the step before it, or is its child."""
    rnd = random.Random(3)

    def matches(tag, steps):
        how, tests = steps[-1]
        if not all(t(tag) for t in tests):
            return False
        if len(steps) == 1:
            return True
        up = tag.parent
        while up.parent is not None:
            if matches(up, steps[:-1]):
                return True
            if how == ">":
                return False
            up = up.parent
        return False

    for _ in range(150):
        html = "".join(rnd.choice(["<p class='a'>", "<i class='b a'>", "<b id=x>", "</p>", "</i>", "</b>", "t"]) for _ in range(40))
        selector = ", ".join(" ".join(rnd.choice(["p", "i", ".a", ".b", "#x", "b", "*", "> i", "> .a"]) for _ in range(rnd.randrange(1, 5))) for _ in range(2))
        page, compiled = pay._Page(html), pay._compile(selector)
        assert pay._places(page, compiled) == [t.at for t in page.order if any(matches(t, alt) for alt in compiled)], (html, selector)


def test_declarations_in_comments_and_cdata_are_text(spark):
    item = "<item><title>{}</title><link>https://e/1</link></item>"
    feed = lambda title, before="", after="": f"{before}<rss><channel><title>t</title>{item.format(title)}</channel></rss>{after}"
    cases = {
        "cdata": (feed("<![CDATA[Why <!DOCTYPE html> matters]]>"), "ok"), "comment": (feed("a <!-- <!ENTITY --> b"), "ok"), "prolog": (feed("a", '<?xml version="1.0"?><!-- <!DOCTYPE x> -->'), "ok"),
        "many": (feed("a", "<!-- c -->" * 20_000), "ok"), "pi": (feed("a", "<?x <!DOCTYPE ?>"), "ok"), "doctype": (feed("a", '<?xml version="1.0"?>\n<!DOCTYPE rss>'), "declaration"),
        "entity": (feed("a", "<!DOCTYPE rss [<!ENTITY x 'y'>]>"), "declaration"), "behind": (feed("a", "", "<!ENTITY x 'y'>"), "declaration"), "after": (feed("a", "<!-- x --><!DOCTYPE rss>"), "declaration"),
    }
    df = spark.createDataFrame([(k, bytearray(v[0].encode())) for k, v in cases.items()], "k string, content binary")
    classified = pay.classify_feed(df)
    assert {r.k: r.status for r in classified.collect()} == {k: v[1] for k, v in cases.items()}
    titles = {r.k: r.title for r in pay.extract_rss(classified, ["k"]).collect()}
    assert titles["cdata"] == "Why <!DOCTYPE html> matters" and titles.keys() == {k for k, v in cases.items() if v[1] == "ok"}
