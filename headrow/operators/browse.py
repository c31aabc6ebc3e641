"""Reads over the archive: latest snapshots, titles, representatives, browse pages, runs and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headrow.functions.text import source_label, title_search
from headrow.operators.search import TitleIndex
from headrow.plans.lineage import cut


def source_names(sources: DataFrame) -> DataFrame:
    return sources.withColumn("source_name", source_label(F.col("provider_name"), F.col("channel_label")))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each source (observed_at, then id)."""
    best = F.max_by(F.struct("snapshot_id", "fetch_run_id", "observed_at"), F.struct("observed_at", "snapshot_id"))
    return snapshots.groupBy("source_id").agg(best.alias("__best")).select("source_id", "__best.*")


def latest_snapshot_headlines(
    archive: dict[str, DataFrame], sources: DataFrame, limit_per_source: int | None = None, source_id: str | None = None, enabled_only: bool = True
) -> DataFrame:
    """Headlines of each source's latest snapshot, ranked in the source by position (nulls last) and version."""
    chosen = source_names(sources)
    if enabled_only:
        chosen = chosen.where("enabled")
    if source_id is not None:
        chosen = chosen.where(F.col("source_id") == source_id)
    chosen = chosen.select("source_id", "source_name", "stream_kind")
    latest = latest_snapshots(archive["snapshots"]).select("source_id", "snapshot_id").join(chosen, "source_id")
    entries = archive["snapshot_entries"].join(latest, "snapshot_id")
    versions = archive["item_versions"].select(F.col("version_id").alias("item_version_id"), "title")
    items = archive["items"].select("item_id", "item_kind", "entity_kind", "item_variant", "published_at", "first_seen_at")
    rows = entries.join(versions, "item_version_id").join(items, "item_id")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("position").asc_nulls_last(), "item_version_id"))
    rows = rows.withColumn("rank", rank)
    if limit_per_source is not None:
        rows = rows.where(F.col("rank") <= limit_per_source)
    return rows.select(
        "source_id", "source_name", "rank", "item_id", "stream_kind", "item_kind", "entity_kind", "item_variant", "position", "title",
        F.col("original_url").alias("url"), "canonical_url", "published_at", "first_seen_at",
    )


def snapshot_sections(headlines: DataFrame) -> DataFrame:
    """Headlines grouped by source, in rank order; two sources of one name stay apart."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "title", "url")))
    return headlines.groupBy("source_id", "source_name").agg(rows.alias("headlines"))


def latest_title(versions: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("title", "version_id"), F.struct("last_seen_at", "version_id"))
    return versions.groupBy("item_id").agg(best.alias("__best")).select("item_id", "__best.*")


def eligible_observations(observations: DataFrame, sources: DataFrame, surfaces: DataFrame, view: str = "all", source_id: str | None = None) -> DataFrame:
    """Observations of enabled sources, of one surface unless view is all, and of one source if given."""
    chosen = sources.where("enabled").select("source_id")
    if source_id is not None:
        chosen = chosen.where(F.col("source_id") == source_id)
    if view != "all":
        chosen = chosen.join(surfaces.where(F.col("surface") == view).select("source_id"), "source_id", "left_semi")
    return observations.join(chosen, "source_id", "left_semi")


def representative_source(eligible: DataFrame) -> DataFrame:
    """One observation an item: the last seen, then the smallest source id."""
    last = F.unix_micros(F.col("last_seen_at").cast("timestamp"))
    best = F.min_by(F.struct("source_id", "position", "last_seen_at"), F.struct(-last, F.col("source_id")))
    return eligible.groupBy("item_id").agg(best.alias("__best")).select("item_id", "__best.*")


def _window(items: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    for edge, op in ((since, ">="), (until, "<=")):
        if edge is not None:
            items = items.where(F.col("first_seen_at") >= edge if op == ">=" else F.col("first_seen_at") <= edge)
    return items


def browse_headlines(
    archive: dict[str, DataFrame], sources: DataFrame, surfaces: DataFrame, view: str = "all", since: Column | None = None, until: Column | None = None,
    query: str | None = None, source_id: str | None = None, limit: int | None = 100, offset: int = 0, index: TitleIndex | None = None,
) -> DataFrame:
    """Items first seen in [since, until] with their current title and representative source, newest first.

    index: of the current titles; a query then begins with the items that it finds.
    """
    items = _window(archive["items"], since, until)
    if query is not None and index:
        items = items.join(index.search(query).select("item_id"), "item_id", "left_semi")
    seen = eligible_observations(archive["observations"], sources, surfaces, view, source_id)
    rep = representative_source(seen.join(items.select("item_id"), "item_id", "left_semi"))
    titles = latest_title(archive["item_versions"].join(items.select("item_id"), "item_id", "left_semi")).select("item_id", "title")
    names = source_names(sources).select("source_id", "source_name", "stream_kind")
    rows = items.join(rep.select("item_id", "source_id", "position"), "item_id").join(titles, "item_id").join(names, "source_id")
    if query is not None:
        rows = rows.where(title_search(F.col("title"), query))
    rows = rows.select(
        "source_id", "source_name", "item_id", "stream_kind", "item_kind", "entity_kind", "item_variant", "position", "title",
        F.col("original_url").alias("url"), "canonical_url", "published_at", "first_seen_at",
    )
    if limit is None:
        return rows
    return rows.orderBy(F.desc("first_seen_at"), F.desc("item_id")).offset(offset).limit(limit)


def _browsed(
    archive: dict[str, DataFrame], sources: DataFrame, surfaces: DataFrame, view: str = "all", since: Column | None = None, until: Column | None = None,
    query: str | None = None, source_id: str | None = None, index: TitleIndex | None = None,
) -> DataFrame:
    """(item_id, first_seen_at) of the items that browse_headlines() has."""
    items = _window(archive["items"], since, until).select("item_id", "first_seen_at")
    if query is not None and index:
        items = items.join(index.search(query).select("item_id"), "item_id", "left_semi")
    items = items.join(eligible_observations(archive["observations"], sources, surfaces, view, source_id), "item_id", "left_semi")
    if query is not None:
        items = items.join(latest_title(archive["item_versions"]).where(title_search(F.col("title"), query)), "item_id", "left_semi")
    return items


def count_browse_headlines(archive: dict[str, DataFrame], sources: DataFrame, surfaces: DataFrame, **filters) -> DataFrame:
    """How many items browse_headlines() has in all, with its filters: one row (n)."""
    return _browsed(archive, sources, surfaces, **filters).agg(F.count(F.lit(1)).alias("n"))


def page_of(keys: DataFrame, n: int, offset: int, size: int, cells: int = 1024, small: int = 10_000) -> DataFrame:
    """(item_id) of the size rows behind the first offset ones of n, newest first; keys: (item_id, first_seen_at).

    The place is found by counting: the times, and where one time has too many rows the item ids, are cut in at most cells ranges, whose counts reach
    the driver, and so is the range that holds the offset, until it has at most small rows. Only that many rows and a page are sorted.
    """
    rows = keys.select("item_id", F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("us"))
    if offset >= n:
        return rows.limit(0).select("item_id")
    inside, skip, behind = rows, offset, F.lit(True)
    for column in ("us", "item_id"):
        low, high = inside.agg(F.min(column), F.max(column)).first() if n > small else (None, None)
        if low is None:
            break
        while low < high and n > small:
            width = -(-(high - low + 1) // cells)
            cell = F.expr(f"({column} - {low}) div {width}").alias("cell")
            counts = {r["cell"]: r["count"] for r in inside.where(F.col(column).between(low, high)).groupBy(cell).count().collect()}
            for at in sorted(counts, reverse=True):
                n = counts[at]
                if skip < n:
                    break
                skip -= n
            low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        inside = inside.where(F.col(column).between(low, high))
        behind = F.col("us") <= high if column == "us" else (F.col("us") < top) | ((F.col("us") == top) & (F.col("item_id") <= high))
        top = high
    return rows.where(behind).orderBy(F.desc("us"), F.desc("item_id")).offset(skip).limit(size).select("item_id")


def browse_page(archive, sources, surfaces, page: int, page_size: int = 100, small: int = 10_000, **filters) -> tuple[DataFrame, int, int]:
    """Rows of a page, the page as clamped to what there is, and the number of pages (at least one).

    The page's items are found by page_of(), and only they are joined.
    """
    keys = cut(_browsed(archive, sources, surfaces, **filters).select("item_id", "first_seen_at"))
    n = keys.count()
    pages = max(1, -(-n // page_size))
    page = min(max(1, page), pages)
    chosen = page_of(keys, n, (page - 1) * page_size, page_size, small=small)
    filters.pop("query", None), filters.pop("index", None)
    return browse_headlines({**archive, "items": archive["items"].join(chosen, "item_id", "left_semi")}, sources, surfaces, limit=page_size, **filters), page, pages


def browse_after(rows: DataFrame, first_seen_at: Column, item_id: Column, page_size: int = 100) -> DataFrame:
    """The page behind a given last row, for a reader that goes on from page to page."""
    behind = (F.col("first_seen_at") < first_seen_at) | ((F.col("first_seen_at") == first_seen_at) & (F.col("item_id") < item_id))
    return rows.where(behind).orderBy(F.desc("first_seen_at"), F.desc("item_id")).limit(page_size)


def recent_fetch_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(limit)


def latest_fetch_runs(runs: DataFrame, sources: DataFrame, enabled_only: bool = True) -> DataFrame:
    """The newest run of each source."""
    chosen = sources.where("enabled") if enabled_only else sources
    rest = [c for c in runs.columns if c != "source_id"]
    best = runs.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.col("run_id")).alias("__best")).select("source_id", "__best.*")
    return best.join(chosen.select("source_id"), "source_id", "left_semi")


def stream_states(states: DataFrame, sources: DataFrame, enabled_only: bool = True) -> DataFrame:
    """A state for each source; the state of a new source where none is stored."""
    chosen = sources.where("enabled") if enabled_only else sources
    return chosen.select("source_id").join(states, "source_id", "left").fillna(0, ["consecutive_failures"])


def last_content_change(change_log: DataFrame) -> DataFrame:
    return change_log.groupBy("source_id").agg(F.max("created_at").alias("last_change_at"))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("source_id")


def source_filter_options(sources: DataFrame) -> DataFrame:
    """Enabled sources with their labels, by provider and channel."""
    named = source_names(sources.where("enabled"))
    return named.orderBy("provider_name", "channel_label", "source_id").select("source_id", F.col("source_name").alias("label"))
