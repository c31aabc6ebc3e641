"""Extraction of captured payloads: feeds, JSON listings, JSON inside scripts, HTML listings.

Payloads: run_id, content (binary) and what else should stay with the entries.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from headrow.functions.checks import scalar_text_of, text_of
from headrow.functions.text import none_if_blank, strip
from headrow.functions.times import parse_timestamp


@F.pandas_udf(StringType())
def _decode_named(content: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            return None if raw is None else bytes(raw).decode(name)
        except (UnicodeDecodeError, LookupError):
            return None

    return pd.Series([one(a, b) for a, b in zip(content, charset)], dtype=object)


def decode_payload(content: Column, charset: Column | None = None) -> Column:
    """Strict text of bytes; null if they aren't valid. UTF-8 stays in the JVM, other charsets (gb18030, ...) go through Python."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    if charset is None:
        return utf8
    plain = F.lower(charset).isin("utf-8", "utf8")
    return F.when(plain, utf8).otherwise(_decode_named(F.when(~plain, content), charset))


# ---- feeds

_TEXT = "struct<_VALUE:string>"
_ITEM = f"title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,date:string"
_RSS = f"channel struct<title:string,item:array<struct<{_ITEM}>>>"
_LINK = "struct<_VALUE:string,_rel:string,_href:string>"
_ATOM = f"entry array<struct<id:string,title:struct<_VALUE:string,_type:string>,published:string,updated:string,link:array<{_LINK}>>>"
_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _markup(text: Column) -> Column:
    """XML without comments, CDATA sections and processing instructions, in which a declaration's letters mean nothing."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "")


def classify_feed(payloads: DataFrame) -> DataFrame:
    """Add text, kind (rss, atom or null) and status: ok, bad_encoding, declaration, malformed, unsupported_root or no_channel.

    A declaration is one that stands in the markup: in a comment, a CDATA section or a processing instruction it is text.
    """
    df = payloads.withColumn("text", decode_payload(F.col("content")))
    bare = F.explode(F.array(F.struct(_markup(F.col("text")).alias("bare"))))
    df = df.select("*", bare.alias("__m")).select(*df.columns, F.col("__m.bare").alias("__bare"))
    root = F.regexp_extract("__bare", r"^[\s\uFEFF]*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1)
    said = F.col("__bare").rlike("<!(DOCTYPE|ENTITY)")
    rss = F.from_xml("text", _RSS + ", _corrupt string", _XML)
    atom = F.from_xml("text", _ATOM + ", _corrupt string", _XML)
    # a generator is computed once a row, whatever refers to it and whichever filter stands above
    parsed = F.struct(root.alias("root"), said.alias("said"), F.when(root == "rss", rss).alias("rss"), F.when(root == "feed", atom).alias("atom"))
    df = df.select("*", F.explode(F.array(parsed)).alias("__x")).select(*df.columns, F.col("__x.rss").alias("__rss"), F.col("__x.atom").alias("__atom"), F.col("__x.root").alias("__root"), F.col("__x.said").alias("__said"))
    root = F.col("__root")
    closed = F.col("text").rlike(r"(?s)</(?:[\w.-]+:)?(rss|feed)>\s*(<!--.*?-->\s*)*$")
    bad = F.coalesce("__rss._corrupt", "__atom._corrupt").isNotNull() | ~closed
    status = (
        F.when(F.col("text").isNull(), "bad_encoding")
        .when(F.col("__said"), "declaration")
        .when(~root.isin("rss", "feed"), F.when(root == "", "malformed").otherwise("unsupported_root"))
        .when(bad, "malformed")
        .when((root == "rss") & ~F.col("text").rlike(r"<(?:[\w.-]+:)?channel[\s>/]"), "no_channel")
        .otherwise("ok")
    )
    kind = F.when(root == "rss", "rss").when(root == "feed", "atom")
    return df.withColumn("status", status).withColumn("kind", kind).drop("__root", "__said", "__bare")


def _candidate(title: Column, url: Column, external_id: Column, raw: Column, metrics: Column, position: Column) -> list[Column]:
    raw = none_if_blank(raw)
    return [
        F.coalesce(strip(title), F.lit("")).alias("title"), F.coalesce(strip(url), F.lit("")).alias("url"), none_if_blank(external_id).alias("external_id"),
        parse_timestamp(raw).alias("published_at"), raw.alias("raw_published_at"), (position + 1).cast("long").alias("position"), metrics.alias("metrics"),
    ]


def extract_rss(classified: DataFrame, keep: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates of RSS payloads whose status is ok, in document order; transform may repair columns of the result."""
    items = classified.where("status = 'ok' and kind = 'rss'").select(*keep, F.posexplode("__rss.channel.item").alias("__pos", "__i"))
    raw = F.coalesce(none_if_blank(F.col("__i.pubDate")), F.col("__i.date"))
    out = items.select(*keep, *_candidate(F.col("__i.title"), F.col("__i.link"), F.col("__i.guid._VALUE"), raw, F.lit("{}"), F.col("__pos")))
    return transform(out) if transform else out


def extract_atom(classified: DataFrame, keep: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates of Atom payloads: published else updated, the first alternate link, updated as a metric."""
    items = classified.where("status = 'ok' and kind = 'atom'").select(*keep, F.posexplode("__atom.entry").alias("__pos", "__i"))
    fits = lambda x: F.coalesce(x["_rel"], F.lit("alternate")).isin("alternate", "") & (F.coalesce(strip(x["_href"]), F.lit("")) != "")
    link = F.get(F.filter("__i.link", fits), F.lit(0))["_href"]
    raw = F.coalesce(none_if_blank(F.col("__i.published")), F.col("__i.updated"))
    updated = none_if_blank(F.col("__i.updated"))
    metrics = F.when(updated.isNull(), "{}").otherwise(F.to_json(F.struct(updated.alias("updated_at"))))
    out = items.select(*keep, *_candidate(F.col("__i.title._VALUE"), link, F.col("__i.id"), raw, metrics, F.col("__pos")))
    return transform(out) if transform else out


# ---- JSON


@dataclass(frozen=True)
class JsonSpec:
    """Where a JSON listing keeps its candidates. Paths are variant paths such as $.data.items."""

    entries: str
    title: tuple[str, ...]
    id: str | None = None
    url: str | None = None
    url_template: str | None = None  # with {id}
    time: str | None = None
    naive_offset: str | None = None
    envelope: tuple[str, str] | None = None  # a path and the text it must have
    exclude: tuple[tuple[str, tuple[str, ...]], ...] = ()  # a path and the texts that leave an entry out
    metrics: tuple[tuple[str, str], ...] = field(default=())


def unwrap_embedded_json(text: Column, pattern: str) -> Column:
    """The JSON text that the first group of a Java pattern finds inside a script or page; null if it isn't there."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def extract_json_listing(payloads: DataFrame, spec: JsonSpec, keep: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entries, status) of JSON payloads by a spec. status: ok, malformed, bad_envelope or no_list for each payload.

    Entries have entry_pos, usable (an object with a title and URL) and excluded beside the candidate's fields.
    """
    parsed = payloads.withColumn("__v", F.try_parse_json(text_col))
    listed = F.try_variant_get("__v", spec.entries, "array<variant>")
    right = F.lit(True)
    if spec.envelope:
        right = F.coalesce(F.try_variant_get("__v", spec.envelope[0], "string") == spec.envelope[1], F.lit(False))
    status = F.when(F.col("__v").isNull(), "malformed").when(~right, "bad_envelope").when(F.col("__list").isNull(), "no_list").otherwise("ok")
    checked = parsed.withColumn("__list", listed).withColumn("status", status)
    each = checked.where("status = 'ok'").select(*keep, F.col(text_col).alias("__text"), F.posexplode("__list").alias("entry_pos", "__e"))

    def at(path: str) -> Column:
        return F.try_variant_get("__e", path, "variant")

    title = F.coalesce(*(none_if_blank(text_of(at(p))) for p in spec.title))
    ident = none_if_blank(scalar_text_of(at(spec.id))) if spec.id else F.lit(None).cast("string")
    if spec.url:
        url = none_if_blank(text_of(at(spec.url)))
    else:
        before, _, after = (spec.url_template or "").partition("{id}")
        url = F.concat(F.lit(before), ident, F.lit(after))
    raw = none_if_blank(scalar_text_of(at(spec.time))) if spec.time else F.lit(None).cast("string")
    excluded = F.lit(False)
    for path, values in spec.exclude:
        excluded = excluded | F.coalesce(F.try_variant_get("__e", path, "string").isin(*values), F.lit(False))
    metrics = _metrics([(n, at(p)) for n, p in spec.metrics], F.col("__text"))
    entries = each.select(
        *keep, "entry_pos", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url"), ident.alias("external_id"),
        parse_timestamp(raw, spec.naive_offset).alias("published_at"), raw.alias("raw_published_at"), excluded.alias("excluded"), metrics.alias("metrics"),
    )
    return entries.withColumn("usable", (F.col("title") != "") & (F.col("url") != "")), checked.select(*keep, "status")


def _metrics(named: list[tuple[str, Column]], text: Column) -> Column:
    """JSON text of the metrics that are there: numbers, booleans, arrays and objects as they are, texts stripped, blank ones left out.

    A number beyond the doubles becomes the bare word Infinity, which encode_metrics() refuses.
    """
    parts = []
    for name, v in named:
        kind = F.schema_of_variant(v)
        said = F.when(kind == "STRING", F.to_json(F.nullif(strip(F.try_variant_get(v, "$", "string")), F.lit("")).cast("variant"))).otherwise(F.to_json(v))
        huge = (kind != "STRING") & ~text.contains('Infinity"')
        said = F.when(huge, F.regexp_replace(said, '"(-?Infinity)"', "$1")).otherwise(said)
        parts.append(F.when((kind != "VOID") & (said != "null"), F.concat(F.lit(json.dumps(name) + ":"), said)))
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")) if parts else F.lit("{}")


def resolve_json_refs(payloads: DataFrame, ids_path: str, nodes_path: str, keep: list[str], pinned_path: str = "$.pinned", text_col: str = "text") -> DataFrame:
    """(keep, entry_pos, node): the nodes that a list of ids names, in its order, without pinned or missing ones."""
    parsed = payloads.withColumn("__v", F.try_parse_json(text_col))
    parsed = parsed.withColumn("__nodes", F.try_variant_get("__v", nodes_path, "map<string,variant>"))
    ids = parsed.select(*keep, "__nodes", F.posexplode(F.try_variant_get("__v", ids_path, "array<string>")).alias("entry_pos", "__id"))
    nodes = ids.select(*keep, "entry_pos", F.col("__nodes")[F.col("__id")].alias("node")).where("node is not null")
    return nodes.where(~F.coalesce(F.try_variant_get("node", pinned_path, "boolean"), F.lit(False)))


# ---- HTML listings


class _Tag:
    __slots__ = ("name", "attrs", "parent", "kids", "at", "end")

    def __init__(self, name, attrs, parent, at=-1):
        self.name, self.attrs, self.parent, self.kids, self.at, self.end = name, attrs, parent, [], at, -1

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.kids)
        return " ".join("".join(out).split())


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__()
        self.root = self.at = _Tag("", {}, None)
        self.order: list[_Tag] = []
        self.open: Counter = Counter()
        self.feed(html)
        self.close()
        for tag in reversed(self.order):  # the tags inside one stand behind it, up to end
            tag.end = max(tag.end, tag.at + 1)
            tag.parent.end = max(tag.parent.end, tag.end)

    def handle_starttag(self, tag, attrs):
        node = _Tag(tag, {k: v or "" for k, v in attrs}, self.at, len(self.order))
        self.at.kids.append(node)
        self.order.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag):
        while self.open[tag]:  # none is open: a stray end tag
            self.open[self.at.name] -= 1
            closed, self.at = self.at, self.at.parent
            if closed.name == tag:
                break

    def handle_data(self, data):
        self.at.kids.append(data)


_STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
_TEST = re.compile(r"[.#][\w-]+|\[[^\]]+\]")


def _test(part: str) -> Callable[[_Tag], bool]:
    if part[0] == ".":
        return lambda t: part[1:] in t.attrs.get("class", "").split()
    if part[0] == "#":
        return lambda t: t.attrs.get("id") == part[1:]
    name, op, value = re.fullmatch(r"\[\s*([\w:-]+)\s*(?:([*^$]?=)\s*[\"']?(.*?)[\"']?\s*)?\]", part).groups()
    how = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}
    return lambda t: name in t.attrs and (op is None or how[op](t.attrs[name], value))


Steps = list[tuple[str, list[Callable[[_Tag], bool]]]]


def _compile(selector: str) -> list[Steps]:
    """Alternatives of steps from left to right: (combinator to the left, tests)."""
    out = []
    for alternative in selector.split(","):
        steps, combinator = [], " "
        for word in re.findall(r">|[^\s>]+", alternative):
            if word == ">":
                combinator = ">"
                continue
            name, rest = _STEP.fullmatch(word).groups()
            tests = [_test(x) for x in _TEST.findall(rest)]
            if name and name != "*":
                tests.insert(0, lambda t, n=name: t.name == n)
            steps.append((combinator, tests))
            combinator = " "
        out.append(steps)
    return out


def _places(page: _Page, compiled: list[Steps]) -> list[int]:
    """Places of the tags that a selector matches, ascending: one pass, in which each tag is tested once for each step that can be reached there.

    ends has a bit for each step at which a tag ends the steps so far, above the bits of all tags around it. A step can be reached at a tag if the
    step before it ends at a tag around it, or (>) at its parent.
    """
    found = set()
    for steps in compiled:
        child = sum(1 << k for k, (how, _) in enumerate(steps) if k and how == ">")
        inner = sum(1 << k for k, (how, _) in enumerate(steps) if k and how != ">")
        ends, above = [0] * (len(page.order) + 1), [0] * (len(page.order) + 1)  # the last is the page, place -1
        for at, tag in enumerate(page.order):
            up = tag.parent.at
            above[at] = above[up] | ends[up]
            can = 1 | (above[at] << 1 & inner) | (ends[up] << 1 & child)
            ends[at] = sum(1 << k for k, (_, tests) in enumerate(steps) if can >> k & 1 and all(t(tag) for t in tests))
            if ends[at] >> len(steps) - 1 & 1:
                found.add(at)
    return sorted(found)


def _first(page: _Page, inside: _Tag, places: list[int]) -> _Tag | None:
    """The first of the places that lies inside a tag."""
    i = bisect.bisect_right(places, inside.at)
    return page.order[places[i]] if i < len(places) and places[i] < inside.end else None


@dataclass(frozen=True)
class HtmlSpec:
    """Selectors of an HTML listing: rows, and in a row its link, title and time (text, or an attribute if named)."""

    row: str
    link: str = "a[href]"
    title: str | None = None
    time: str | None = None
    time_attr: str | None = None
    base_url: str = ""
    id_pattern: str | None = None


def extract_html_listing(payloads: DataFrame, spec: HtmlSpec, keep: list[str], text_col: str = "text") -> DataFrame:
    """Entries of HTML listings: rows without a link or title are skipped, the first of each link stays, URLs are absolute.

    Returns keep, entry_pos, title, url, external_id, raw_published_at. A null text has no entries.
    """
    source = payloads.select(*keep, F.col(text_col).alias("__text"))
    new = [StructField("entry_pos", LongType()), *(StructField(c, StringType()) for c in ("title", "url", "external_id", "raw_published_at"))]
    schema = StructType([*source.schema.fields[:-1], *new])

    def listing(html: str, rows, links, titles, times):
        page = _Page(html)
        seen: set[str] = set()
        blank: set[int] = set()  # tags without text
        row_at, link_at, title_at, time_at = (_places(page, s) if s else [] for s in (rows, links, titles, times))
        are_links = {*link_at}
        for row in (page.order[i] for i in row_at):
            link = row if row.at in are_links else _first(page, row, link_at)
            href = link.attrs.get("href", "").strip() if link else ""
            if not href or href in seen:
                continue
            named = _first(page, row, title_at) if titles else link
            title = named.text() if named and named.at not in blank else ""
            if not title:
                blank.update([named.at] if named else [])
                continue
            seen.add(href)
            url = urljoin(spec.base_url, href)
            when = _first(page, row, time_at) if times else None
            raw = (when.attrs.get(spec.time_attr, "") if spec.time_attr else when.text()).strip() if when else ""
            ident = re.search(spec.id_pattern, url) if spec.id_pattern else None
            yield len(seen) - 1, title, url, (ident[1] or None) if ident else None, raw or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        selectors = [_compile(s) if s else None for s in (spec.row, spec.link, spec.title, spec.time)]
        for batch in batches:
            out = [(*own, *entry) for *own, html in batch.itertuples(index=False) if isinstance(html, str) for entry in listing(html, *selectors)]
            yield pd.DataFrame(out, columns=schema.names)

    return source.mapInPandas(run, schema)
