import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from headrow.operators.changes import analysis_items_after
from headrow.operators.health import due_sources, fold_stream_state
from headrow.operators.increments import IncrementalArchive
from headrow.streaming import jobs
from tests.test_archive import RUNS, accepted, make, run_log
from tests.test_increments import runs_of

SOURCES = "source_id string, language string, enabled boolean, stream_kind string, interval_seconds long"


def all_sources(spark, rows):
    return spark.createDataFrame([(s, "en", True, "latest", 600) for s in sorted({r.source_id for r in rows.select("source_id").distinct().collect()})], SOURCES)


def test_consumers_neither_lose_nor_repeat(spark, tmp_path):
    """One consumer fails in the middle of its second set, one has lost its checkpoint folder; a version before the checkpoint gives nothing."""
    raw = runs_of(make(random.Random(2), 30), 2)
    sources = all_sources(spark, accepted(spark, raw))
    archive = IncrementalArchive(spark, f"{tmp_path}/archive", buckets=2)
    fails = [False, True]

    def work(events):
        if len(fails) > 1:
            fails.pop(0)
        elif fails and fails.pop():
            return events.withColumn("title", F.when(F.col("change_seq") % 2 == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
        return events

    make_ = lambda n, **k: jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", n, **k)
    one, two = make_("one", work=work), make_("two")
    run = lambda c, folder: c.stream(f"{tmp_path}/{folder}").awaitTermination()
    assert one.output() is None and one.checkpoint() == -1
    half = len(raw) // 8 * 4
    archive.apply(accepted(spark, raw[:half]), 0)
    first = archive.log.snapshot().version
    run(one, "cp1")
    middle = one.checkpoint()
    archive.apply(accepted(spark, raw[half:]), 1)
    with pytest.raises(Exception, match="lost"):
        run(one, "cp1")
    assert one.checkpoint() == middle and two.checkpoint() == -1
    run(two, "cp2")
    run(one, "cp1")
    run(two, "another folder")
    two.advance(first)
    want = sorted(r.seq for r in archive.changes(-1).collect())
    whole = {r.change_seq: r.title for r in analysis_items_after(archive.read(), sources, -1, limit=None).collect()}
    for c in (one, two):
        got = c.output().collect()
        assert sorted(r.change_seq for r in got) == want and c.checkpoint() == want[-1]
        assert {r.change_seq: r.title for r in got} == whole


def test_a_broken_event_is_not_passed(spark, tmp_path):
    """A source that isn't known fails the set; once it is, nothing is missing."""
    raw = runs_of(make(random.Random(4), 8), 4)
    rows = accepted(spark, raw)
    archive = IncrementalArchive(spark, f"{tmp_path}/archive", buckets=2)
    archive.apply(rows, 0)
    sources = all_sources(spark, rows)
    gone = sources.where(F.col("source_id") != archive.changes(-1).orderBy("seq").first()["source_id"])
    with pytest.raises(Exception, match="missing_source"):
        jobs.ChangeConsumer(archive, gone, f"{tmp_path}/out", "c").advance()
    c = jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", "c")
    assert c.checkpoint() == -1
    c.advance()
    assert c.output().count() == archive.changes(-1).count()


def test_two_processes_of_one_consumer(spark, tmp_path):
    """Another process takes the events while this one works on them: they are committed once."""
    raw = runs_of(make(random.Random(6), 8), 6)
    archive = IncrementalArchive(spark, f"{tmp_path}/archive", buckets=2)
    archive.apply(accepted(spark, raw), 0)
    sources = all_sources(spark, accepted(spark, raw))
    other = jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", "c")

    def slow(events):
        other.advance()
        return events

    jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", "c", work=slow).advance()
    assert other.output().count() == archive.changes(-1).count()


def test_output_is_compacted_by_levels(spark, tmp_path):
    """Three sets, two folders a level at once: none is lost or doubled, a later column is null in earlier rows, and replaced folders can be deleted."""
    raw = runs_of(make(random.Random(9), 12), 9)
    rows = accepted(spark, raw)
    sources = all_sources(spark, rows)
    archive = IncrementalArchive(spark, f"{tmp_path}/archive", buckets=2)
    other = jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", "other", fanout=2)
    parts = [raw[: len(raw) // 3], raw[len(raw) // 3 : len(raw) * 2 // 3], raw[len(raw) * 2 // 3 :]]
    for i, part in enumerate(parts):
        archive.apply(accepted(spark, part), i)
        work = (lambda e: e.withColumn("more", F.lit(1))) if i else (lambda e: e)
        c = jobs.ChangeConsumer(archive, sources, f"{tmp_path}/out", "c", work=work, fanout=2)
        c.advance()
        if i == 0:
            other.advance()
            first = c.checkpoint()
    files = c.log.snapshot().of("output")
    assert sorted(f.level for f in files if f.batch == "c") == [0, 1] and [f.level for f in files if f.batch == "other"] == [0]
    want, theirs = sorted(r.seq for r in archive.changes(-1).collect()), other.output().count()
    c.log.remove_old()
    got = c.output().collect()
    assert sorted(r.change_seq for r in got) == want and all((r.more is None) == (r.change_seq <= first) for r in got)
    assert other.output().count() == theirs and len(list((tmp_path / "out" / "output").iterdir())) == 3


def test_timers_find_due_sources_at_each_instant(spark, tmp_path):
    """Replay by a clock of ticks, some with no run since the last: the due sources are those of the fold at that instant. s3 has no run, s4 is disabled."""
    rows = run_log(random.Random(8))[:30]
    names = [f"s{i}" for i in range(5)]
    sources = spark.createDataFrame([(s, 600, s != "s4") for s in names], "source_id string, interval_seconds long, enabled boolean")
    runs = spark.createDataFrame(rows, RUNS)
    schema = f"{RUNS}, tick timestamp"
    empty = [None] * len(runs.columns)
    told = [(None, None, s, *empty[3:], None) for s in names]
    ends = sorted(r[4] for r in rows if r[4])
    ticks = [ends[4], ends[4] + dt.timedelta(seconds=45), ends[15], ends[15] + dt.timedelta(seconds=599), ends[-1] + dt.timedelta(days=1)]
    before = dt.datetime(1990, 1, 1)
    for i, tick in enumerate(ticks):
        new = [(*r, None) for r in rows if before < (r[4] or r[3]) <= tick] + (told if i == 0 else [])
        before = tick
        spark.createDataFrame([*new, (*empty, tick)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.stream_due_sources(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sources)
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        last = {r.source_id: r for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()}
        so_far = runs.where(F.coalesce("finished_at", "started_at") <= F.lit(tick))
        want = due_sources(sources, fold_stream_state(so_far, sources), F.lit(tick)).collect()
        assert {(s, r.next_run_at) for s, r in last.items() if r.is_due} == {tuple(r) for r in want}, i
