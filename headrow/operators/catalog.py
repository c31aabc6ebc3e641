"""Source catalog: data-quality findings and reconciliation of a stored catalog with an incoming one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headrow.functions.checks import CHANNEL_ROLES, PROVIDER_KINDS, STREAM_KINDS, SURFACES, classification_problem, valid_language, valid_market, valid_slug, valid_topic


def catalog_violations(sources: DataFrame) -> DataFrame:
    """Findings (rule, subject): repeated ids, inconsistent providers, bad fields. Sources have topics and surfaces as arrays."""

    def found(rule: str, where: Column, subject: str = "source_id") -> DataFrame:
        return sources.where(F.coalesce(where, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(subject).alias("subject")).distinct()

    ids = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_source_id").alias("rule"), F.col("source_id").alias("subject"))
    meta = F.count_distinct(F.struct("provider_name", "provider_kind"))
    providers = sources.groupBy("provider_id").agg(meta.alias("n")).where("n > 1").select(F.lit("inconsistent_provider").alias("rule"), F.col("provider_id").alias("subject"))
    problem = classification_problem(F.col("item_kind"), F.col("entity_kind"), F.col("item_variant"))
    kinds = sources.withColumn("rule", problem).where("rule is not null").select("rule", F.col("source_id").alias("subject")).distinct()
    out = ids.unionByName(providers).unionByName(kinds)
    for rule, where in (
        ("bad_source_id", ~valid_slug(F.col("source_id"))),
        ("bad_provider_id", ~valid_slug(F.col("provider_id"))),
        ("bad_provider_kind", ~F.col("provider_kind").isin(*PROVIDER_KINDS)),
        ("bad_channel_role", ~F.col("channel_role").isin(*CHANNEL_ROLES)),
        ("bad_stream_kind", ~F.col("stream_kind").isin(*STREAM_KINDS)),
        ("bad_language", ~valid_language(F.col("language"))),
        ("bad_market", ~valid_market(F.col("market"))),
        ("bad_topic", F.exists("topics", lambda t: ~valid_topic(t))),
        ("bad_surface", F.exists("surfaces", lambda s: ~s.isin(*SURFACES))),
        ("no_surface", F.size("surfaces") == 0),
        ("interval_too_short", F.col("interval_seconds") < 30),
        ("max_items_too_small", F.col("max_items") < 1),
    ):
        out = out.unionByName(found(rule, where))
    return out


def catalog_reconcile(
    current: DataFrame, incoming: DataFrame, current_surfaces: DataFrame, states: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, source_surfaces, new stream states) after a sync.

    Incoming sources replace stored ones; stored ones that are absent stay but are disabled; surfaces are replaced for
    incoming sources only; a source without a state gets an empty one. incoming has the columns of current and surfaces.
    """
    fields = [c for c in current.columns if c != "updated_at"]
    fresh = incoming.select(*fields).withColumn("updated_at", now)
    absent = current.join(incoming.select("source_id"), "source_id", "left_anti")
    stamped = F.when(F.col("enabled"), now).otherwise(F.col("updated_at"))
    kept = absent.withColumn("updated_at", stamped).withColumn("enabled", F.lit(False)).select(*fields, "updated_at")
    sources = fresh.unionByName(kept)
    bridge = incoming.select("source_id", F.explode("surfaces").alias("surface")).distinct()
    surfaces = bridge.unionByName(current_surfaces.join(incoming.select("source_id"), "source_id", "left_anti").select("source_id", "surface"))
    new_states = incoming.select("source_id").join(states.select("source_id"), "source_id", "left_anti").select("source_id", F.lit(0).alias("consecutive_failures"))
    return sources, surfaces, new_states
