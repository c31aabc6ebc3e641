"""Shaping of extracted entries to ranked candidates.

Entries: run_id, entry_pos (order in the payload), usable (false for what can't be a candidate), excluded (left out on purpose),
and the candidate's fields; merged runs have payload_no too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exclude_entries(entries: DataFrame, where: Column) -> DataFrame:
    """Mark entries that are left out on purpose; they aren't rejects."""
    return entries.withColumn("excluded", F.coalesce(where, F.lit(False)))


def eligible(entries: DataFrame) -> DataFrame:
    """Entries that can become candidates: usable and not excluded (where the columns exist)."""
    for column, wanted in (("usable", True), ("excluded", False)):
        if column in entries.columns:
            entries = entries.where(F.col(column) == wanted)
    return entries


def dedupe_in_payload(entries: DataFrame, key: Column) -> DataFrame:
    """The first eligible entry of each key in its run; entries without a key stay."""
    rows = eligible(entries).withColumn("__key", F.coalesce(key, F.concat(F.lit("\x00"), F.col("entry_pos").cast("string"))))
    nth = F.row_number().over(Window.partitionBy("run_id", "__key").orderBy("entry_pos"))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n", "__key")


def rank_and_cap(entries: DataFrame, max_items: Column | int) -> DataFrame:
    """Eligible entries with contiguous positions from 1, at most max_items a run."""
    position = F.row_number().over(Window.partitionBy("run_id").orderBy("entry_pos"))
    return eligible(entries).withColumn("position", position.cast("long")).where(F.col("position") <= max_items)


def extraction_status(entries: DataFrame, candidates: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per run: entries, exclusions, candidates and status.

    payloads: (run_id, status) of every payload, as extraction left it. A run fails if one of its payloads isn't ok, or if it
    has entries beyond exclusions but no candidate; an empty container is legal.
    """
    n = entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if("excluded").alias("excluded"))
    c = candidates.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"))
    read = payloads.groupBy("run_id").agg(F.bool_or(F.col("status") != "ok").alias("bad"))
    out = read.join(n, "run_id", "left").join(c, "run_id", "left").fillna(0, ["entries", "excluded", "candidates"])
    failed = F.col("bad") | ((F.col("entries") > F.col("excluded")) & (F.col("candidates") == 0))
    return out.withColumn("status", F.when(failed, "failed").otherwise("ok")).drop("bad")


def merge_feeds_by_recency(entries: DataFrame, max_items: Column | int, time: Column | None = None) -> DataFrame:
    """Eligible entries of several payloads of a run, newest first (undated last, else in order), ranked and capped."""
    when = time if time is not None else F.col("published_at")
    order = Window.partitionBy("run_id").orderBy(when.desc_nulls_last(), "payload_no", "entry_pos")
    return eligible(entries).withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= max_items)


def merge_feeds_dedupe(entries: DataFrame, max_items: Column | int) -> DataFrame:
    """As merge_feeds_by_recency(), after the first entry of each external id or URL across the payloads, in their order; one with neither goes."""
    rows = eligible(entries).withColumn("__key", F.coalesce(F.nullif(F.col("external_id"), F.lit("")), F.nullif(F.col("url"), F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("run_id", "__key").orderBy("payload_no", "entry_pos"))
    return merge_feeds_by_recency(rows.where("__key is not null").withColumn("__n", nth).where("__n = 1").drop("__n", "__key"), max_items)


def combined_observed_at(payloads: DataFrame) -> DataFrame:
    """Observation time of a run with several responses: the last of them."""
    return payloads.groupBy("run_id").agg(F.max("observed_at").alias("observed_at"))
