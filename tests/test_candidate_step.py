"""The step that all queries on the archive share: candidates are judged once, and by patterns where that is enough."""

import re

from pyspark.sql import functions as F

from headrow.functions import text, urls
from headrow.operators import archive as arc, browse
from headrow.plans import registry

SF = "/root/testdata/sf0.001"
USUAL = [
    "HTTPS://News.Example:443/7?utm_source=feed&id=7", "http://user@news.example:8080/7?UTM_Campaign=z#top", "http://a:b@H.example:80", "https://h.example:80/a?b#c?d", "https://H.example/日本?x=é&&fbclid",
    "http://h.example/@b:80/?&utm_term=1", "https://h.example/a?x=%41&utm_source=1", "https://h.example/?utm_sourcex=1&gclid=2&a?utm_source=3",
]


def test_usual_urls_are_told_by_a_pattern_and_come_out_as_others_do(spark):
    for url in USUAL:
        assert re.match(urls._SOUND.replace(r"\z", r"\Z"), url) and re.match(urls._USUAL.replace(r"\z", r"\Z"), url), url
    said, u = spark.createDataFrame([(x,) for x in USUAL], "url string"), F.col("url")
    spaced = F.concat(F.lit(" "), u)  # is taken apart
    same = lambda f: f(u).eqNullSafe(f(spaced))
    assert said.where(~(same(urls.normalize_url_for_identity) & same(urls.canonicalize_url)) | ~urls.is_http_url(u)).count() == 0
    got = {r[0]: r[1:] for r in said.select(u, urls.normalize_url_for_identity(u), urls.canonicalize_url(u)).collect()}
    assert got[USUAL[0]] == ("https://news.example/7?utm_source=feed&id=7", "https://news.example/7?id=7")
    assert got[USUAL[1]] == ("http://news.example:8080/7?UTM_Campaign=z", "http://news.example:8080/7")
    assert got[USUAL[2]] == ("http://h.example", "http://h.example")
    assert got[USUAL[7]] == ("https://h.example/?utm_sourcex=1&gclid=2&a?utm_source=3", "https://h.example/?utm_sourcex=1&a?utm_source=3")


def test_titles_outside_ascii_alone_are_hashed_by_python(spark):
    rows = spark.createDataFrame([(t,) for t in (" Story  1 ", "a\x1cb", "Ｓtory　1", "", None)], "title string")
    hashed = text.with_odd_title_hash(rows)
    assert {r["title"] for r in hashed.where("odd_hash is not null").collect()} == {"Ｓtory　1"}
    wrong = hashed.where(~text.title_hash_of(F.col("title"), F.col("odd_hash")).eqNullSafe(text.title_hash(F.col("title"))))
    assert hashed.count() == 5 and wrong.count() == 0
    stripped = spark.createDataFrame([(t,) for t in ("a", " a\n b　", "a \n", "\n", "", None, " b")], "t string")
    assert stripped.where(~text.strip_column(F.col("t")).eqNullSafe(text.strip(F.col("t")))).count() == 0


def test_an_archive_judges_its_candidates_once(spark, monkeypatch):
    calls, judged = [], registry._validated
    monkeypatch.setattr(registry, "_validated", lambda *a: calls.append(a) or judged(*a))
    archive = registry._archive(spark, SF)
    assert archive["snapshots"].count() > 0 and archive["snapshot_entries"].count() > 0
    assert len(calls) == 1


def test_candidates_of_one_row_group_are_judged_by_several_tasks(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    many = events.crossJoin(spark.range(400).withColumnRenamed("id", "copy")).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy")).drop("copy")
    many.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    judged = registry._validated(spark, str(tmp_path)).select("obs_seq", "u", "reason", F.spark_partition_id().alias("task"))
    tasks = {r["task"]: r["count"] for r in judged.groupBy("task").count().collect()}
    assert sum(tasks.values()) == many.count() and max(tasks.values()) < 0.9 * many.count()


def test_latest_headlines_are_built_of_the_listed_items_rows(spark):
    archive = registry._archive(spark, SF)
    listed = arc.listed_archive(archive, browse.latest_snapshots(archive["snapshots"]))
    assert 0 < listed["resolved"].count() < archive["resolved"].count()
    sources = registry._sources(spark, SF)
    of = lambda a: sorted(browse.latest_snapshot_headlines(a, sources).collect(), key=str)
    assert of(listed) == of(archive) != []
    assert registry._latest_archive(spark, SF)["resolved"].count() == listed["resolved"].count()


def test_keys_of_resolution_are_computed_once(spark, monkeypatch):
    """The windows over URLs are written, and rows without id come from them with their run: no join by obs_seq adds it."""
    written, cut = [], arc.cut
    monkeypatch.setattr(arc, "cut", lambda df, *a: written.append(df) or cut(df, *a))
    arc.resolve_items(registry._accepted(cut(registry._validated(spark, SF))), written=True)
    keys = [df for df in written if df.columns == ["obs_seq", "run_id", "token", "known"]]
    assert len(keys) == 1
    assert keys[0]._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # of the first rows of ids


def test_named_tables_are_built_of_their_own_columns(spark):
    whole = registry._archive(spark, SF)
    of = lambda t: sorted(t.collect(), key=str)
    for names, left_out in ((["observations"], {"title", "title_hash", "url", "metrics", "u", "p"}), (["item_versions"], {"url", "metrics", "position"}), (["items", "observations", "item_versions", "change_log"], {"metrics", "run_kind"})):
        some = registry._archive(spark, SF, *names)
        assert {*some} == {"resolved", *names} and not left_out & {*some["resolved"].columns}
        for n in names:
            assert some[n].columns == whole[n].columns and of(some[n]) == of(whole[n]) != []


def test_committed_tables_are_built_once(spark, monkeypatch):
    """They are written in parts and again: as a table, not as the aggregates over all rows that they come from."""
    written, write = [], registry.tables.write_archive
    monkeypatch.setattr(registry.tables, "write_archive", lambda t, root: written.extend(t.values()) or write(t, root))
    assert registry.QUERIES["a1_a10_archive_commits"](spark, SF).count()
    assert len(written) == 4 and not any("Aggregate" in t._jdf.queryExecution().optimizedPlan().toString() for t in written)


def test_url_patterns_list_ascii_characters_one_by_one():
    for pattern in (urls._NORMAL, urls._CANONICAL, urls._USUAL, urls._SOUND):
        assert not re.search(r"[^\\]-", re.sub(r"\[1-9\]\[0-9\]|\[0-9\]\{", "", pattern.replace(urls._HIGH, "")))
    char = lambda c: {x for x in map(chr, range(0x10000)) if re.match(c, x)}
    assert char(urls._PATH) == char(r"""[!"$->@-~¡-ᙿ、-￿]""") and char(urls._TAIL) == char(r"[!#-;=?-\[\]_a-z~¡-ᙿ、-￿]")


def test_texts_with_plain_ends_need_no_stripping(spark):
    said = spark.createDataFrame([(t,) for t in ("a", "a b", "a\nb", "a\n", " a", "", " ", "é", "é ", "　", None)], "t string")
    assert said.where(~text.none_if_blank(F.col("t")).eqNullSafe(F.nullif(text.strip(F.col("t")), F.lit("")))).count() == 0


def test_windows_over_urls_sort_by_a_hash_first(spark, monkeypatch):
    written, cut = [], arc.cut
    monkeypatch.setattr(arc, "cut", lambda df, *a: written.append(df) or cut(df, *a))
    rows = registry._accepted(cut(registry._validated(spark, SF)))
    got = arc.resolve_items(rows, block_bits=6, written=True)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    windows = [line for p in plans for line in p.splitlines() if "Window [" in line and "windowspecdefinition(u" in line]
    assert windows and all("windowspecdefinition(uh" in w for w in windows)
    pick = lambda t: sorted(map(tuple, t.select("obs_seq", "token", "item_id", "rep").collect()))
    assert pick(got) == pick(arc.resolve_items(rows, written=True))
