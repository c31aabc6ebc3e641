"""Source health and schedules, folded from the run log.

Runs: run_id (order), run_kind, source_id, started_at, finished_at, status (running, success, not_modified, failed), http_status,
response_etag, response_last_modified, request_identity, error_type, error_message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headrow.functions.times import later
from headrow.functions.urls import safe_headers, upstream_host

BASE_DELAY, MAX_DELAY = 30, 1800
DONE = ("success", "not_modified")


def retry_delay(failures_before: Column, base: int = BASE_DELAY, most: int = MAX_DELAY) -> Column:
    """Seconds to wait after a failure: doubled for each failure before it, up to most."""
    return F.least(F.lit(most), base * F.pow(F.lit(2), F.least(F.lit(20), failures_before))).cast("long")


def recover_abandoned(runs: DataFrame, now: Column) -> DataFrame:
    """Runs still running become failed with error AbandonedRun."""
    gone = F.col("status") == "running"
    return (
        runs.withColumn("error_type", F.when(gone, "AbandonedRun").otherwise(F.col("error_type")))
        .withColumn("finished_at", F.when(gone, now).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(gone, "failed").otherwise(F.col("status")))
    )


def fold_stream_state(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """State of each source with live runs: last attempt and success, failures since then, next run.

    Two aggregates, no window over a source's log: the last success by run, then failures behind it. The newest finished run decides
    when the next is due: a failed source is tried again after retry_delay(), one whose last run was abandoned at once, others after
    their interval. A run that is still running only counts as an attempt.
    """
    live = runs.where("run_kind = 'live'")
    done, finished = F.col("status").isin(*DONE), F.col("status").isin(*DONE, "failed")
    last = live.groupBy("source_id").agg(
        F.max("started_at").alias("last_attempt_at"),
        F.max_by("finished_at", F.when(done, F.col("run_id"))).alias("last_success_at"),
        F.coalesce(F.max(F.when(done, F.col("run_id"))), F.lit(-1)).alias("ok_run"),
        F.max_by(F.struct("status", "finished_at", "error_type"), F.when(finished, F.col("run_id"))).alias("newest"),
    )
    after = live.join(last.select("source_id", "ok_run"), "source_id").where("run_id > ok_run")
    failures = after.groupBy("source_id").agg(F.count_if(F.col("status") == "failed").alias("consecutive_failures"))
    state = last.join(failures, "source_id", "left").fillna(0, ["consecutive_failures"]).join(sources.select("source_id", "interval_seconds"), "source_id", "left")
    newest = F.col("newest")
    next_run = (
        F.when(newest["error_type"] == "AbandonedRun", newest["finished_at"])
        .when(newest["status"] == "failed", later(newest["finished_at"], retry_delay(F.col("consecutive_failures") - 1)))
        .otherwise(later(newest["finished_at"], F.col("interval_seconds")))
    )
    return state.select("source_id", next_run.alias("next_run_at"), "last_attempt_at", "last_success_at", "consecutive_failures")


def due_sources(sources: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Enabled sources that have no next run, or one that isn't after now."""
    known = states.select("source_id", "next_run_at")
    return sources.where("enabled").join(known, "source_id", "left").where(F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)).select("source_id", "next_run_at")


def validator_state(runs: DataFrame, block_bits: int = 12) -> DataFrame:
    """Per live success: etag, last_modified and request_identity as stored after it, and identity_error.

    A full response replaces the stored values, with null too; one that wasn't modified keeps those it leaves out. A
    not-modified run whose identity isn't the stored one is an error. No window holds the whole log of a source: windows run inside blocks of
    2 ** block_bits run ids, and what a block has to know of those before it comes from windows over one row a block.
    """
    ok = runs.where("run_kind = 'live' and status in ('success', 'not_modified')").withColumn("block", F.shiftright("run_id", block_bits))
    kept = {"etag": "response_etag", "last_modified": "response_last_modified"}
    full = F.col("status") == "success"
    order = Window.partitionBy("source_id", "block").orderBy("run_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ok.withColumn("seg", F.count_if(full).over(upto)).withColumn("nth", F.row_number().over(order)).withColumn("before", F.lag("request_identity").over(order))
    rows = rows.withColumn("n_full", F.count_if(full).over(Window.partitionBy("source_id", "block")))
    piece = Window.partitionBy("source_id", "block", "seg").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    for name, column in kept.items():
        rows = rows.withColumn("l_" + name, F.last(column, ignorenulls=True).over(piece))

    open_ = F.col("seg") == F.col("n_full")  # behind the block's last full response
    ends = rows.groupBy("source_id", "block").agg(
        F.max("n_full").alias("n_full"), F.max_by("request_identity", "run_id").alias("identity"), *(F.max_by("l_" + n, F.when(open_, F.col("run_id"))).alias(n) for n in kept)
    )
    blocks = Window.partitionBy("source_id").orderBy("block")
    ends = ends.withColumn("era", F.count_if(F.col("n_full") > 0).over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    era = Window.partitionBy("source_id", "era").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    for name in kept:
        ends = ends.withColumn(name, F.last(name, ignorenulls=True).over(era))
    carried = ends.select("source_id", "block", *(F.lag(n).over(blocks).alias("c_" + n) for n in ("identity", *kept)))

    rows = rows.join(carried, ["source_id", "block"])
    stored = F.when(F.col("nth") > 1, F.col("before")).otherwise(F.col("c_identity"))
    error = (F.col("status") == "not_modified") & ~stored.eqNullSafe(F.col("request_identity"))
    now = [F.coalesce("l_" + n, F.when(F.col("seg") == 0, F.col("c_" + n))).alias(n) for n in kept]
    return rows.select("run_id", "source_id", "status", *now, "request_identity", error.alias("identity_error"))


def classify_response(http_status: Column, network_error: Column, parsed_ok: Column, candidates: Column, accepted: Column, allow_empty: Column, configured: Column) -> Column:
    """healthy, quiet, rate-limited, access-blocked, upstream-error, schema-broken, network-failing or configuration-broken."""
    return (
        F.when(~configured, "configuration-broken")
        .when(network_error, "network-failing")
        .when(http_status == 304, "quiet")
        .when(http_status == 429, "rate-limited")
        .when(http_status.isin(401, 403), "access-blocked")
        .when(http_status >= 400, "upstream-error")
        .when(~parsed_ok, "schema-broken")
        .when(accepted > 0, "healthy")
        .when((candidates > 0) | ~allow_empty, "schema-broken")
        .otherwise("quiet")
    )


def response_evidence(responses: DataFrame) -> DataFrame:
    """A row for each response of a source, with its number: status, content type, bytes, safe headers and the host that answered."""
    return responses.select(
        "source_id", "response_no", "status_code", F.element_at("headers", "content-type").alias("content_type"),
        F.octet_length("content").cast("long").alias("byte_count"), safe_headers(F.col("headers")).alias("headers"), upstream_host(F.col("url")).alias("upstream_host"),
    )


def diagnose(sources: DataFrame, captured: DataFrame, outcome: DataFrame, states: DataFrame, last_change: DataFrame) -> DataFrame:
    """One diagnostic a source from its last captured response, the outcome of its batch, its state and last change.

    captured: (source_id, run_id, http_status, network_error, parsed_ok, configured, allow_empty).
    """
    rows = sources.select("source_id").join(captured, "source_id").join(outcome.select("run_id", "accepted", "rejected"), "run_id", "left")
    rows = rows.fillna(0, ["accepted", "rejected"])
    kind = classify_response(
        F.col("http_status"), F.col("network_error"), F.col("parsed_ok"), F.col("accepted") + F.col("rejected"), F.col("accepted"), F.col("allow_empty"), F.col("configured")
    )
    rows = rows.withColumn("classification", kind).join(states.select("source_id", "consecutive_failures"), "source_id", "left")
    rows = rows.join(last_change, "source_id", "left").fillna(0, ["consecutive_failures"])
    return rows.select("source_id", "classification", "http_status", "accepted", "rejected", "consecutive_failures", "last_change_at")


def fetch_result_rows(summaries: DataFrame, failures: DataFrame) -> DataFrame:
    """Summaries and then failures in one table; failures have null counts and the status failed."""
    bad = failures.select("run_id", "source_id", F.lit("failed").alias("status"), "error_type", "error_message")
    return summaries.unionByName(bad, allowMissingColumns=True)
