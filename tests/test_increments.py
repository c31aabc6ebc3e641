import random

import pytest
from pyspark.sql import functions as F

from headrow.operators import archive as arc
from headrow.operators.increments import STATES, IncrementalArchive, merged, states_of
from tests.test_archive import accepted, make

TABLES = "resolved", "items", "item_url_identities", "observations", "item_versions", "snapshots", "snapshot_entries", "change_log"


def same(spark, got, want):
    for name in TABLES:
        columns = sorted(want[name].columns)
        rows = lambda df: sorted(map(repr, df.select(*(c for c in columns if c not in ("version_id", "inew", "onew", "vnew") or name != "resolved")).collect()))
        assert rows(got[name]) == rows(want[name]), name


def runs_of(rows, seed):
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    return [(i, i // 4, *r[2:]) for i, r in enumerate(rows)]


def test_tables_after_increments_equal_the_whole(spark, tmp_path, seed=1, fanout=2):
    """Times come out of order; batches of other sizes, one without rows, one repeated."""
    rows = runs_of(make(random.Random(seed), 40), seed)
    archive = IncrementalArchive(spark, f"{tmp_path}/a", buckets=3, fanout=fanout)
    at = [0, 4, 4, len(rows) // 8 * 4, len(rows)]
    for i, (a, b) in enumerate(zip(at, at[1:])):
        archive.apply(accepted(spark, rows[a:b]), i)
        if i == 2:
            archive.apply(accepted(spark, rows[:4]), i)  # it was committed: nothing happens
            middle = archive.log.snapshot().version
    same(spark, archive.read(), arc.build_archive(accepted(spark, rows)))
    same(spark, archive.read(middle), arc.build_archive(accepted(spark, rows[: at[3]])))
    archive.remove_old()
    assert archive.read()["items"].count() == len({r.item_id for r in arc.resolve_items(accepted(spark, rows)).collect()})


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    rows = runs_of(make(random.Random(5), 10), 5)
    archive = IncrementalArchive(spark, f"{tmp_path}/a", buckets=2)
    assert archive.read() == {}
    archive.apply(accepted(spark, rows[:8]), 0)
    bad = accepted(spark, rows[8:]).withColumn("metrics", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        archive.apply(bad, 1)
    assert archive.read()["resolved"].count() == 8
    archive.apply(accepted(spark, rows[8:]), 1)
    same(spark, archive.read(), arc.build_archive(accepted(spark, rows)))


def test_folders_stay_few(spark, tmp_path):
    """Folders of a table after many batches: at most fanout - 1 of each level."""
    archive = IncrementalArchive(spark, f"{tmp_path}/a", buckets=2, fanout=2)
    for i in range(12):  # states of 12 batches
        made = archive._write("ids", spark.createDataFrame([(f"p{i % 5}", i), (f"q{i}", i)], "p string, item_id long"), str(i))
        archive.log.commit(archive.log.snapshot(), str(i), made)
        archive.compact()
        levels = [f.level for f in archive.log.snapshot().of("ids")]
        assert len(levels) == len(set(levels)) and max(levels) <= (i + 1).bit_length()
    found = archive._state(archive.log.snapshot(), "ids", spark.createDataFrame([("p3",), ("q7",), ("none",)], "p string"))
    assert {tuple(r) for r in found.collect()} == {("p3", 3), ("q7", 7)}


def test_states_merge_in_any_order_and_more_than_once(spark):
    rows = arc.resolve_items(accepted(spark, runs_of(make(random.Random(7), 20), 7))).cache()
    none = spark.createDataFrame([], "item_id long, token string")
    whole, parts = states_of(rows, none), [states_of(rows.where(F.col("obs_seq") % 3 == i), none) for i in (2, 0, 1, 0)]
    for name in whole:
        union = parts[0][name]
        for p in parts[1:]:
            union = union.unionByName(p[name])
        keys = STATES[name][0]
        assert sorted(map(repr, merged(name, union).orderBy(*keys).collect())) == sorted(map(repr, whole[name].orderBy(*keys).collect())), name


def test_an_empty_successful_run_is_the_latest_snapshot(spark):
    rows = accepted(spark, [r for r in make(random.Random(8), 5) if r[1] >= 0])
    runs = rows.groupBy("run_id", "run_kind").agg(F.min("source_id").alias("source_id"), F.max("seen_at").alias("observed_at"))
    empty = spark.sql("select 999L as run_id, 'live' as run_kind, 's0' as source_id, timestamp'2030-01-01' as observed_at union all select 998L, 'history', 's0', timestamp'2031-01-01'")
    made = arc.build_archive(rows, runs.unionByName(empty))
    from headrow.operators import browse

    latest = {r.source_id: r.snapshot_id for r in browse.latest_snapshots(made["snapshots"]).collect()}
    assert latest["s0"] == 999 and made["snapshot_entries"].where("snapshot_id >= 998").count() == 0
    assert made["snapshots"].where("snapshot_id = 998").count() == 0
