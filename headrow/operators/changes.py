"""Change feed: events after a checkpoint, hydrated and checked, and monotone checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headrow.functions.checks import ENTITY_KINDS, ITEM_KINDS, ITEM_VARIANTS, STREAM_KINDS


def changes_after(change_log: DataFrame, seq: int | Column = 0, limit: int | None = 100) -> DataFrame:
    """Events with a greater seq, in order; the first limit of them."""
    rows = change_log.where(F.col("seq") > seq)
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def hydrate(events: DataFrame, archive: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """Events with their item, exact version, observation and source by left joins; nothing is dropped here."""
    versions = archive["item_versions"].select(F.col("version_id").alias("item_version_id"), "item_id", "title")
    items = archive["items"].select(
        "item_id", "item_kind", "entity_kind", "item_variant", "original_url", "canonical_url", "published_at", "first_seen_at"
    )
    seen = archive["observations"].select("source_id", "item_id", F.lit(True).alias("observed"))
    chosen = sources.select("source_id", F.col("language").alias("source_language"), F.col("enabled").alias("source_enabled"), "stream_kind")
    return (
        events.join(items, "item_id", "left").join(versions, ["item_version_id", "item_id"], "left")
        .join(seen, ["source_id", "item_id"], "left").join(chosen, "source_id", "left")
    )


def analysis_violations(hydrated: DataFrame) -> DataFrame:
    """Add violation: the first broken rule of a hydrated event, else null."""
    known = lambda c, of: F.coalesce(F.col(c), F.lit("")).isin(*of)
    optional = lambda c, of: F.col(c).isNull() | F.col(c).isin(*of)
    reason = (
        F.when(F.col("observed").isNull(), "missing_observation")
        .when(F.col("item_version_id").isNull() | F.col("title").isNull(), "missing_version")
        .when(F.col("source_language").isNull(), "missing_source")
        .when(~known("stream_kind", STREAM_KINDS), "unsupported_stream_kind")
        .when(~known("item_kind", ITEM_KINDS), "unsupported_item_kind")
        .when(~optional("entity_kind", ENTITY_KINDS), "unsupported_entity_kind")
        .when(~optional("item_variant", ITEM_VARIANTS), "unsupported_item_variant")
        .when(F.col("first_seen_at").isNull(), "missing_first_seen_at")
    )
    return hydrated.withColumn("violation", reason)


_ANALYSIS = [
    "change_seq", "event_type", "item_id", "item_version_id", "title", "source_id", "source_language", "source_enabled", "stream_kind",
    "item_kind", "entity_kind", "item_variant", "original_url", "canonical_url", "published_at", "first_seen_at",
]


def analysis_items_after(
    archive: dict[str, DataFrame], sources: DataFrame, checkpoint: int = 0, limit: int | None = 100, strict: bool = True
) -> DataFrame:
    """Hydrated events after a checkpoint. strict: any violation fails the read, so that nothing is skipped; else they are returned with their violation."""
    checked = analysis_violations(hydrate(changes_after(archive["change_log"], checkpoint, limit), archive, sources))
    named = checked.withColumnRenamed("seq", "change_seq")
    if not strict:
        return named.select(*_ANALYSIS, "violation")
    guard = F.when(F.col("violation").isNotNull(), F.raise_error(F.concat(F.lit("change event "), F.col("change_seq").cast("string"), F.lit(": "), F.col("violation"))))
    return named.withColumn("change_seq", F.coalesce(guard.cast("long"), F.col("change_seq"))).select(*_ANALYSIS)


def get_checkpoint(checkpoints: DataFrame, consumer: str) -> int:
    """The consumer's sequence number, 0 if it has none."""
    row = checkpoints.where(F.col("consumer_name") == consumer).agg(F.max("last_seq").alias("s")).first()
    return row["s"] or 0


def advance_checkpoint(checkpoints: DataFrame, consumer: str, seq: int, now: Column) -> DataFrame:
    """Checkpoints with the consumer's raised to seq; it never goes back. A negative seq is refused."""
    if seq < 0:
        raise ValueError("a checkpoint can't be negative")
    new = checkpoints.sparkSession.range(1).select(F.lit(consumer).alias("consumer_name"), F.lit(seq).cast("long").alias("last_seq"), now.alias("updated_at"))
    both = checkpoints.select("consumer_name", "last_seq", "updated_at").unionByName(new)
    return both.groupBy("consumer_name").agg(F.max("last_seq").alias("last_seq"), F.max_by("updated_at", F.struct("last_seq", "updated_at")).alias("updated_at"))


def pending(archive: dict[str, DataFrame], sources: DataFrame, checkpoints: DataFrame, consumer: str, limit: int | None = 100) -> DataFrame:
    """Hydrated events that the consumer hasn't passed; reading doesn't move its checkpoint."""
    return analysis_items_after(archive, sources, get_checkpoint(checkpoints, consumer), limit)
