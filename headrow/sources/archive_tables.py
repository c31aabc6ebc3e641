"""Archive tables on storage: checked reads, and writes that appear as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from headrow.sources.commit_log import CommitLog, Conflict, File

# The least columns of each archive table.
REQUIRED = {
    "sources": ("source_id", "provider_id", "provider_name", "channel_label", "stream_kind", "item_kind", "language", "market", "enabled", "interval_seconds"),
    "source_surfaces": ("source_id", "surface"),
    "stream_state": ("source_id", "next_run_at", "last_attempt_at", "last_success_at", "consecutive_failures"),
    "fetch_runs": ("run_id", "run_kind", "source_id", "started_at", "finished_at", "status"),
    "items": ("item_id", "identity_key", "external_id", "original_url", "canonical_url", "item_kind", "first_seen_at", "last_seen_at"),
    "item_url_identities": ("item_id", "identity_key"),
    "observations": ("source_id", "item_id", "upstream_id", "first_seen_at", "last_seen_at", "position"),
    "item_versions": ("version_id", "item_id", "title_hash", "title", "first_seen_at", "last_seen_at"),
    "snapshots": ("snapshot_id", "fetch_run_id", "source_id", "observed_at"),
    "snapshot_entries": ("snapshot_id", "item_id", "position", "item_version_id", "original_url", "canonical_url", "metrics"),
    "change_log": ("seq", "event_type", "source_id", "item_id", "item_version_id", "created_at"),
    "consumer_checkpoints": ("consumer_name", "last_seq", "updated_at"),
}


def check_layout(name: str, df: DataFrame) -> DataFrame:
    missing = sorted({*REQUIRED.get(name, ())} - {*df.columns})
    if missing:
        raise ValueError(f"archive table {name} lacks the columns {', '.join(missing)}")
    return df


def _commit(spark: SparkSession, root: str, batch: str, outputs: dict[str, DataFrame], partition_by: dict[str, list[str]]) -> None:
    """Write outputs to folders of a new attempt, and then commit them in place of the batch's earlier ones: the only step that readers see."""
    attempt = uuid.uuid4().hex
    made = [File(name, f"{root}/{name}/attempt={attempt}", batch) for name in sorted(outputs)]
    for f in made:
        outputs[f.table].write.mode("error").partitionBy(*partition_by.get(f.table, [])).parquet(f.path)
    log = CommitLog(spark, root)
    while True:
        seen = log.snapshot()
        old = [p for p, f in seen.files.items() if f.batch == batch]
        if batch in seen.closed:
            raise ValueError(f"batch {batch} below {root} has been compacted")
        try:
            log.commit(seen, batch, made, old, [f"batch:{batch}"])
            return
        except Conflict:  # the batch was committed by another writer meanwhile: this one is later
            continue


def write_archive(tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Write the tables of an archive as one commit: a reader sees all of them, or those of the commit before."""
    checked = {name: check_layout(name, df) for name, df in tables.items()}
    if checked:
        _commit(next(iter(checked.values())).sparkSession, root, "archive", checked, partition_by or {})


def read_archive(spark: SparkSession, root: str, names: list[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of the last commit below root, or of a version of its log; a missing table, or one that lacks a required column, fails the read."""
    out, seen = {}, CommitLog(spark, root).snapshot(version)
    for name in names or REQUIRED:
        paths = seen.paths(name)
        if not paths:
            raise ValueError(f"archive table {name} is missing")
        out[name] = check_layout(name, spark.read.parquet(*paths))
    return out


def write_run_outputs(spark: SparkSession, root: str, batch_id: str, outputs: dict[str, DataFrame]) -> None:
    """Append the outputs of a batch of runs, all or none: any tables, the run log's rows among them.

    Each attempt writes to folders of its own; readers see them once their log entry is there, last of all. Writing a batch again, after a
    failure or after its commit, leaves what readers see as it was until the new attempt is committed, and then one copy. Writers of different
    batches don't hinder each other; of two writers of one batch the later commit counts.
    """
    _commit(spark, root, batch_id, outputs, {})


def read_committed(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """Rows of the committed batches, each in its last committed attempt, now or at a version of the log; None if there is none."""
    paths = CommitLog(spark, root).snapshot(version).paths(name)
    return spark.read.parquet(*paths) if paths else None


def compact_committed(spark: SparkSession, root: str, name: str) -> None:
    """Write a table's committed batches to one folder of files of Spark's advised size, and put it in their place in one commit.

    A batch that is compacted can't be written again, that raises an error. Readers of earlier versions keep their folders. Does nothing if another writer replaced one of the batches meanwhile.
    """
    log = CommitLog(spark, root)
    seen = log.snapshot()
    old = seen.of(name)
    if len(old) < 2:
        return
    made = File(name, f"{root}/{name}/attempt={uuid.uuid4().hex}", "compacted", max(f.level for f in old) + 1)
    spark.read.parquet(*(f.path for f in old)).hint("rebalance").write.mode("error").parquet(made.path)
    try:
        batches = {f.batch for f in old}
        log.commit(seen, None, [made], [f.path for f in old], {f"batch:{b}" for b in batches}, batches)
    except Conflict:
        return
