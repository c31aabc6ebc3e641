"""Continuous archive builds and running source states."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headrow.operators.changes import analysis_items_after
from headrow.operators.health import BASE_DELAY, DONE, MAX_DELAY
from headrow.operators.increments import BUCKETS, FANOUT, IncrementalArchive
from headrow.plans.lineage import collecting, cut, discard
from headrow.sources.commit_log import CommitLog, Conflict, File


def stream_archive(accepted: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Add accepted candidates to the IncrementalArchive below root as they arrive, one commit a batch.

    A batch reads the states of its own keys' buckets, in a number of folders that compaction bounds, and appends; a retried batch that was committed is left alone.
    No row is too late: folds go by commit order and seen_at.
    """
    spark = accepted.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        IncrementalArchive(spark, root, buckets).apply(batch, number)

    return accepted.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The resolved rows of all committed batches, with the ids that their items got later; None if there is none."""
    return IncrementalArchive(spark, root).read().get("resolved")


class ChangeConsumer:
    """A named reader of an IncrementalArchive's change events, hydrated, each exactly once.

    What work makes of a set of events and the consumer's checkpoint are one commit below root: a failure at any point leaves both as they were, and the same
    events come again. Consumers may share a root; each has its own checkpoint, and two processes of one consumer don't both commit the same events.
    A first start begins with the oldest event. An event that breaks a rule of analysis_violations() fails the set, nothing is skipped.

    When fanout folders of output have one level they are merged to one of the next, so there are at most fanout - 1 a level and as many levels as the logarithm
    of the number of sets. If work gives other columns later on, earlier rows have null there.
    """

    def __init__(
        self, archive: IncrementalArchive, sources: DataFrame, root: str, name: str, work: Callable[[DataFrame], DataFrame] = lambda events: events, fanout: int = FANOUT
    ):
        self.archive, self.sources, self.root, self.name, self.work, self.fanout = archive, sources, root.rstrip("/"), name, work, fanout
        self.spark = archive.spark
        self.log = CommitLog(self.spark, self.root)

    def _mine(self, table: str, version: int | None = None) -> list[str]:
        return [f.path for f in self.log.snapshot(version).of(table) if f.batch == self.name]

    def checkpoint(self, version: int | None = None) -> int:
        """The last seq that is done, -1 before the first."""
        paths = self._mine("consumer_checkpoints", version)
        return self.spark.read.parquet(*paths).first()["last_seq"] if paths else -1

    def output(self) -> DataFrame | None:
        """What work made of all events up to the checkpoint; None before the first."""
        paths = self._mine("output")
        return self._output(paths) if paths else None

    def _output(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def advance(self, version: int | None = None) -> None:
        """Work on the events behind the checkpoint, up to a version of the archive. Hydration reads the buckets of their items, not the whole archive."""
        version = self.archive.log.snapshot(version).version
        while not self._try(version):
            pass
        self.compact()

    def compact(self) -> None:
        """Merge the output folders of each level that has fanout of them, until none has; each merged folder takes their place in one commit."""
        while True:
            seen = self.log.snapshot()
            levels: dict[int, list[str]] = {}
            for f in seen.of("output"):
                if f.batch == self.name:
                    levels.setdefault(f.level, []).append(f.path)
            full = [level for level, paths in levels.items() if len(paths) >= self.fanout]
            if not full:
                return
            level = min(full)
            made = File("output", f"{self.root}/output/attempt={uuid.uuid4().hex}", self.name, level + 1)
            self._output(levels[level]).hint("rebalance").write.parquet(made.path)
            try:
                self.log.commit(seen, None, [made], levels[level], levels[level])
            except Conflict:  # another process of this consumer merged them
                return

    def _try(self, version: int) -> bool:
        seen = self.log.snapshot()
        last, used = self.checkpoint(seen.version) if seen.version >= 0 else -1, []
        try:
            with collecting(used):
                events = self.archive.changes(last, version)
                events = events if events is None else cut(events)
                top = None if events is None else events.agg(F.max("seq")).first()[0]
                if top is None:
                    return True
                known = self.archive.of_items(events, version) | {"change_log": events}
                made = [File(t, f"{self.root}/{t}/attempt={uuid.uuid4().hex}", self.name) for t in ("output", "consumer_checkpoints")]
                self.work(analysis_items_after(known, self.sources, last, limit=None)).write.parquet(made[0].path)
            point = self.spark.range(1).select(F.lit(self.name).alias("consumer_name"), F.lit(top).cast("long").alias("last_seq"), F.current_timestamp().alias("updated_at"))
            point.write.parquet(made[1].path)
            old = [f.path for f in seen.of("consumer_checkpoints") if f.batch == self.name]
            self.log.commit(seen, None, made, old, [f"consumer:{self.name}"])
            return True
        except Conflict:  # another process of this consumer was faster: begin behind its checkpoint
            return False
        finally:
            discard(self.spark, used)

    def stream(self, checkpoint: str) -> StreamingQuery:
        """Advance whenever the archive's log has new entries. They only say up to which version; where to begin is in the consumer's commit, so a lost folder
        `checkpoint` loses and repeats nothing. Folders that compaction replaced have to stay until the consumers have passed, see remove_old().
        """
        entries = self.spark.readStream.schema("version long").option("pathGlobFilter", "*.json").json(f"{self.archive.root}/_log")

        def step(batch: DataFrame, number: int) -> None:
            top = batch.agg(F.max("version")).first()[0]  # null if only checkpoints of the log came
            if top is not None:
                self.advance(top)

        return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_SEEN = "run_id", "status", "finished_at", "error_type", "interval_seconds"
_STATE = (
    "last_attempt_at timestamp, ok_run long, last_success_at timestamp, run_id long, status string, finished_at timestamp, error_type string, interval_seconds long, "
    "failed array<bigint>"
)
_OUT = "source_id string, last_run long, next_run_at timestamp, last_attempt_at timestamp, last_success_at timestamp, consecutive_failures long"


def _newest(before: tuple, runs: pd.DataFrame, columns: tuple[str, ...]) -> tuple:
    """The columns of the run with the greatest id, of a known one (its id first) and those given."""
    if runs.empty:
        return before
    run = runs.loc[runs["run_id"].idxmax(), list(columns)]
    found = tuple(None if pd.isna(x) else x for x in run)
    return found if before[0] is None or found[0] > before[0] else before


def _next_run(run: int | None, status: str | None, finished: pd.Timestamp | None, error: str | None, interval: int | None, losses: list[int]) -> pd.Timestamp | None:
    if run is None:
        return None
    wait = 0 if error == "AbandonedRun" else min(MAX_DELAY, BASE_DELAY * 2 ** min(20, len(losses) - 1)) if status == "failed" else int(interval)
    return finished + pd.Timedelta(seconds=wait)


def _fold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold runs into a source's state, in whatever order, chunks or batches they come; a late run counts where its id puts it.

    The state holds the newest finished run, the newest success, and the ids of the failures behind that.
    """
    attempt, ok, success, *newest, failed = state.get if state.exists else (None,) * 8 + ([],)
    good, newest, losses = (ok, success), tuple(newest), set(failed or ())
    for batch in batches:
        live = batch[batch["run_kind"] == "live"]
        if live.empty:
            continue
        started = live["started_at"].max()
        attempt = started if attempt is None else max(attempt, started)
        done = live[live["status"].isin(DONE)]
        good = _newest(good, done, ("run_id", "finished_at"))
        newest = _newest(newest, live[live["status"].isin([*DONE, "failed"])], _SEEN)
        losses.update(live.loc[live["status"] == "failed", "run_id"])
    losses = sorted(int(x) for x in losses if good[0] is None or x > good[0])
    run, status, finished, error, interval = newest
    due = _next_run(*newest, losses)
    whole = lambda x: None if x is None else int(x)
    state.update((attempt, whole(good[0]), good[1], whole(run), status, finished, error, whole(interval), losses))
    yield pd.DataFrame([(key[0], run, due, attempt, good[1], len(losses))], columns=[c.split()[0] for c in _OUT.split(", ")])


def stream_source_state(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Running state of each source, as fold_stream_state() has it: one row a source and batch, the last counts.

    A run that is still running is an attempt; when it has finished it comes again. Late runs change what they would have changed in time.
    """
    wanted = runs.join(sources.select("source_id", "interval_seconds"), "source_id")
    wanted = wanted.select(
        "source_id", "run_id", "run_kind", "status", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"), "error_type", "interval_seconds"
    )
    return wanted.groupBy("source_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


_DUE = "source_id string, next_run_at timestamp, is_due boolean"


def _scheduler(zone: str) -> Callable[[tuple[str], Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """zone: the session's, in which pandas has times."""

    def schedule(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Fold what came for a source and set its timer, or tell that the timer has run out."""
        if not key[0]:  # ticks: they have moved the clock
            return
        if not state.hasTimedOut:
            for _ in _fold(key, batches, state):
                pass
        _, _, _, *newest, failed = state.get
        due = _next_run(*(None if pd.isna(x) else x for x in newest), failed or [])
        now, at = state.getCurrentWatermarkMs(), None
        if due is not None:  # the first whole millisecond at which it is due
            at = math.ceil(pd.Timestamp(due).tz_localize(zone, ambiguous=True, nonexistent="shift_forward").timestamp() * 1000)
        is_due = state.hasTimedOut or at is None or at <= now
        if not is_due:
            state.setTimeoutTimestamp(max(1, at - 1))  # runs out when the clock has passed it
        yield pd.DataFrame([(key[0], due, is_due)], columns=[c.split()[0] for c in _DUE.split(", ")])

    return schedule


def stream_due_sources(arrivals: DataFrame, sources: DataFrame) -> DataFrame:
    """Schedules of enabled sources as they change, as due_sources() has them: (source_id, next_run_at, is_due), the last row of a source counts.

    arrivals has the columns of runs and tick. A row with a tick and no source moves the clock, which goes by ticks alone: a source becomes due by its
    timer with no run coming in, at the first tick that isn't before its next_run_at (whole milliseconds). Rows with a source and no tick are its runs, in any order, none
    is too late; one with a null run_kind announces a source, which is due until it has a finished live run.
    """
    chosen = sources.select("source_id", "interval_seconds", "enabled")
    clocked = arrivals.withColumn("tick", F.col("tick").cast("timestamp")).withWatermark("tick", "0 seconds").join(chosen, "source_id", "left")
    wanted = clocked.where("source_id is null or enabled").select(
        F.coalesce("source_id", F.lit("")).alias("source_id"), "run_id", "run_kind", "status", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"),
        "error_type", "interval_seconds", "tick",
    )
    zone = arrivals.sparkSession.conf.get("spark.sql.session.timeZone")
    return wanted.groupBy("source_id").applyInPandasWithState(_scheduler(zone), _DUE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
