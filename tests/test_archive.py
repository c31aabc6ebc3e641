import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from headrow.operators import archive as arc
from headrow.operators import cluster
from headrow.operators import validate as val
from headrow.operators.components import connected_components
from headrow.plans.lineage import cut
from headrow.streaming import jobs

SCHEMA = (
    "obs_seq long, run_id long, run_kind string, source_id string, provider_id string, seen_at timestamp, title string, url string, external_id string, "
    "published_at timestamp, raw_published_at string, position long, metrics string, item_kind string, entity_kind string, item_variant string"
)


def make(rnd, groups=60, n=12, start=0):
    rows, seq = [], start
    for g in range(groups):
        for _ in range(rnd.randrange(1, n)):
            seq += 1
            t = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(500))
            rows.append((
                seq, seq // 4, "live", f"s{rnd.randrange(3)}", f"p{rnd.randrange(2)}", t, f"T{rnd.randrange(3)}", f"https://e/{g}-{rnd.randrange(3)}",
                rnd.choice([None, " ", f"{g}-{rnd.randrange(3)}"]), rnd.choice([None, t]), None, rnd.choice([None, 1, 2]), "{}", "article", None, None,
            ))
    return rows


def fold(rows):
    """Sequential resolution: ids own items; a URL-only item is taken over by the next new id at its URL."""
    items, by_id, alias, live, owner = [], {}, {}, {}, {}
    for r in sorted(rows):
        seq, provider, url = r[0], r[4], r[7]
        ident = (r[8] or "").strip()
        if ident:
            key = (provider, ident)
            if key in by_id:
                item = by_id[key]
            elif url in live:
                item = by_id[key] = live.pop(url)
            else:
                item = by_id[key] = seq
        else:
            if url in live:
                item = live[url]
            else:
                known = alias.get(url, set())
                if len(known) == 1:
                    item = next(iter(known))
                else:
                    item = live[url] = seq
        alias.setdefault(url, set()).add(item)
        owner[seq] = item
    return owner


def accepted(spark, rows):
    return val.with_identity(spark.createDataFrame(rows, SCHEMA))


def test_resolution_matches_the_fold(spark):
    rows = make(random.Random(1), 120)
    for bits in (30, 2):  # one block, and blocks of four rows
        got = {r.obs_seq: r.item_id for r in arc.resolve_items(accepted(spark, rows), bits).collect()}
        assert got == fold(rows)


@pytest.mark.parametrize("seed, bits", [(2, 30), (12, 3)])
def test_increment_equals_whole(spark, seed, bits):
    rows = make(random.Random(seed), 60)
    random.Random(3).shuffle(rows)
    rows = [(i, i // 4, *r[2:]) for i, r in enumerate(rows)]
    third = len(rows) // 12 * 4
    whole = {tuple(r) for r in arc.resolve_items(accepted(spark, rows)).select("obs_seq", "token", "item_id", "rep").collect()}
    step = arc.resolve_items(accepted(spark, rows[:third]), bits)
    for part in (rows[third : 2 * third], rows[2 * third :]):
        step = cut(arc.apply_increment(cut(step), accepted(spark, part), bits))
    assert {tuple(r) for r in step.select("obs_seq", "token", "item_id", "rep").collect()} == whole


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i // 4, *r[2:]) for i, r in enumerate(make(random.Random(4), 20))]
    src = f"{tmp_path}/src"
    whole = accepted(spark, rows)
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        accepted(spark, part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(whole.schema).parquet(src)
        jobs.stream_archive(stream, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = jobs.latest_state(spark, f"{tmp_path}/state")
    want = arc.resolve_items(whole)
    keys = ["obs_seq", "token", "item_id", "rep", "title_hash"]
    assert {tuple(r) for r in got.select(keys).collect()} == {tuple(r) for r in want.select(keys).collect()}


def test_out_of_order_run_keeps_the_latest_url_and_first_known_date(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    row = lambda seq, at, url, pub, pos: (seq, seq, "live", "s", "p", at, "A", url, "x", pub, None, pos, "{}", "article", None, None)
    resolved = arc.resolve_items(accepted(spark, [row(1, t[2], "https://e/new", None, 5), row(2, t[0], "https://e/old", t[0], None), row(3, t[2], "https://e/tie", t[1], None)]))
    item = arc.build_items(resolved).first()
    assert (item.item_id, item.original_url, item.published_at, item.first_seen_at, item.last_seen_at) == (1, "https://e/tie", t[0], t[0], t[2])
    seen = arc.build_observations(resolved).first()
    assert seen.position is None and seen.upstream_id == "x"


def test_dedupe_matches_the_walk(spark):
    rnd = random.Random(5)
    rows = [(i, i // 6, "live", "s", "p", dt.datetime(2024, 1, 1), "T", f"https://e/{rnd.randrange(3)}", rnd.choice([None, "a", "b", "c"]), None, None, 1, "{}", "article", None, None) for i in range(600)]
    got = {r.obs_seq: r.reason for r in val.validate(spark.createDataFrame(rows, SCHEMA), F.col("seen_at")).collect()}
    want = {}
    for run in range(100):
        ids, urls, bare = set(), set(), set()
        for r in rows[run * 6 : run * 6 + 6]:
            dup = r[8] in ids or r[7] in bare if r[8] else r[7] in urls or r[7] in bare
            want[r[0]] = "duplicate_identity" if dup else None
            if not dup:
                urls.add(r[7])
                (ids.add(r[8]) if r[8] else bare.add(r[7]))
    assert got == want


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    for small in (0, 50, 50_000):  # by rounds alone, by rounds and one task, by one task
        got = connected_components(spark.createDataFrame(edges, "a long, b long"), small=small)
        assert {r.node: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


RUNS = "run_id long, run_kind string, source_id string, started_at timestamp, finished_at timestamp, status string, error_type string"
STATES = ["source_id", "next_run_at", "last_attempt_at", "last_success_at", "consecutive_failures"]


def run_log(rnd, n=60):
    """Runs of three sources: successes, failures, abandoned, running and history runs."""
    t = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        status = rnd.choice(["success", "not_modified", "failed", "failed", "failed", "abandoned", "running"])
        start = t + dt.timedelta(hours=i)
        end = None if status == "running" else start + dt.timedelta(minutes=1)
        out.append((i, "live" if rnd.random() < 0.8 else "history", f"s{i % 3}", start, end, "failed" if status == "abandoned" else status, "AbandonedRun" if status == "abandoned" else None))
    return out


def state_by_run(rows):
    """The state after each run in turn."""
    attempt = success = due = None
    failures = 0
    for _, kind, _, start, end, status, error in sorted(rows):
        if kind != "live":
            continue
        attempt = start
        if status in ("success", "not_modified"):
            success, failures, due = end, 0, end + dt.timedelta(seconds=600)
        elif status == "failed":
            due = end + dt.timedelta(seconds=0 if error else min(jobs.MAX_DELAY, jobs.BASE_DELAY * 2 ** min(20, failures)))
            failures += 1
    return due, attempt, success, failures


def test_source_states_follow_the_runs(spark, tmp_path):
    """The fold, and the stream with runs that come late, equal the state run by run. Source s0's newest run is still running."""
    from headrow.operators.health import due_sources, fold_stream_state

    rows = [*run_log(random.Random(3)), (63, "live", "s0", dt.datetime(2024, 1, 5), None, "running", None)]
    want = {(f"s{k}", *state_by_run([r for r in rows if r[2] == f"s{k}"])) for k in range(3)}
    runs = spark.createDataFrame(rows, RUNS)
    sources = spark.createDataFrame([(f"s{i}", 600, True) for i in range(3)], "source_id string, interval_seconds long, enabled boolean")
    states = fold_stream_state(runs, sources)
    assert {tuple(r) for r in states.select(STATES).collect()} == want
    due = {r.source_id for r in due_sources(sources, states, F.lit(dt.datetime(2024, 1, 1))).collect()}
    assert due == {w[0] for w in want if w[1] is None}
    for late in (0, 1):
        runs.where(F.col("run_id") % 4 == 1 if late else F.col("run_id") % 4 != 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
        out = jobs.stream_source_state(spark.readStream.schema(runs.schema).parquet(f"{tmp_path}/runs"), sources)
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = {r.source_id: tuple(r[c] for c in STATES) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()}
    assert set(last.values()) == want


@pytest.mark.parametrize("rows_a_chunk", [1, 7, 1000])
def test_source_state_folds_chunks_in_any_order(rows_a_chunk):
    """Any division of the runs of three micro-batches into chunks, in any order, gives the state run by run."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rnd = random.Random(9)
    for _ in range(40):
        rows = [(*r[:2], "s", *r[3:]) for r in run_log(rnd)]
        state, last = State(), None
        parts = [rows[:25], rows[45:], rows[25:45]]
        for part in parts:
            part = rnd.sample(part, len(part))
            chunks = [part[i : i + rows_a_chunk] for i in range(0, len(part), rows_a_chunk)]
            frames = [pd.DataFrame(c, columns=[x.split()[0] for x in RUNS.split(", ")]).assign(interval_seconds=600) for c in chunks]
            for f in frames:
                for c in ("started_at", "finished_at"):
                    f[c] = pd.to_datetime(f[c])
            last = list(jobs._fold(("s",), iter(frames), state))[0].iloc[0]
        assert tuple(None if pd.isna(x) else x for x in last[["next_run_at", "last_attempt_at", "last_success_at", "consecutive_failures"]]) == state_by_run(rows)


def test_validators_across_blocks(spark):
    """Stored values run by run equal those of windows inside small blocks and of one whole block."""
    from headrow.operators.health import validator_state

    rnd = random.Random(4)
    rows = [(i, "live", f"s{rnd.randrange(2)}", rnd.choice(["success", "not_modified", "not_modified", "failed"]), rnd.choice([None, f"e{i}"]), rnd.choice([None, f"m{i}"]), rnd.choice([None, "a", "b"])) for i in range(300)]
    want, now = {}, {}
    for i, _, source, status, etag, modified, identity in rows:
        if status == "failed":
            continue
        e, m, stored = now.get(source, (None, None, None))
        kept = (etag, modified) if status == "success" else (etag or e, modified or m)
        want[i] = (source, status, *kept, identity, status == "not_modified" and stored != identity)
        now[source] = (*kept, identity)
    runs = spark.createDataFrame(rows, "run_id long, run_kind string, source_id string, status string, response_etag string, response_last_modified string, request_identity string")
    for bits in (2, 12):
        got = {r.run_id: tuple(r)[1:] for r in validator_state(runs, bits).select("run_id", "source_id", "status", "etag", "last_modified", "request_identity", "identity_error").collect()}
        assert got == want


def test_cut_tables_of_two_threads(spark):
    """Each thread's collector has only its own tables, so neither deletes the other's."""
    import threading

    from headrow.plans.lineage import collecting, discard

    both, seen, failed = threading.Barrier(2, timeout=60), {}, []

    def work(name):
        try:
            used = []
            with collecting(used):
                both.wait()
                mine = cut(spark.range(10))
                both.wait()
            seen[name] = list(used)
            both.wait()
            if name == "a":
                discard(spark, used)
            both.wait()
            if name == "b":
                assert mine.count() == 10
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(seen["a"]) == len(seen["b"]) == 1 and seen["a"] != seen["b"]


def test_places_in_a_cluster_do_not_depend_on_hours(spark):
    rnd, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    at = lambda: None if rnd.random() < 0.3 else t0 + dt.timedelta(minutes=rnd.randrange(600))
    rows = [(rnd.choice("aaab"), i, f"s{i % 3}", rnd.choice([None, 1, 2]), at(), at()) for i in range(200)] + [("lone", 900, "s", 1, t0, None)]
    df = spark.createDataFrame(rows, "cluster_id string, item_id long, source_name string, position long, first_seen_at timestamp, published_at timestamp")
    for order, column in (("observed", 4), ("published", 5)):
        want = {}
        for c in ("a", "b") if order == "published" else ("a", "b", "lone"):
            mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[column] is None, t0 - (r[column] or t0), r[2], r[3] or 0, r[1]))
            want |= {r[1]: (i, mine[0][column]) for i, r in enumerate(mine, 1)}
        got = cluster.headline_groups(df, order)
        assert got.columns == [*df.columns, "place", "group_time"]
        assert {r.item_id: (r.place, r.group_time) for r in got.collect()} == want


def test_validation_computes_identities_once(spark):
    """Candidates go through one exchange and one fold, however many batches repeat an identity."""
    rows = [(i, i // 6, "live", "s", "p", dt.datetime(2024, 1, 1), "T", "https://e/0", None, None, None, 1, "{}", "article", None, None) for i in range(60)]
    df = val.validate(spark.createDataFrame(rows, SCHEMA), F.col("seen_at"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Window" not in plan and "Join" not in plan
    assert df.where("reason is null").count() == 10


def test_resolution_reads_its_candidates_once(spark):
    """Candidates are computed once, however often resolution and the tables read them; a resolved row is joined from keys."""
    rows = accepted(spark, make(random.Random(9), 40))
    count = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            count.add(part.num_rows)
            yield part

    n = rows.count()
    archive = arc.build_archive(rows.mapInArrow(seen, rows.schema))
    for name in ("items", "item_versions", "observations", "snapshot_entries", "change_log"):
        archive[name].collect()
    assert count.value == n
