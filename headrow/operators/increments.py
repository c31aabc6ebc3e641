"""Archive tables kept by increments: states that merge by minimum and maximum, in buckets of their keys, compacted level by level.

A state's columns are minima or maxima (of structs that begin with what orders them), so merging two states of a key, in any order or more than once, gives
the state of all rows. A batch therefore appends the states of its own rows; old states are read only where resolution or novelty asks for them, in the
buckets of the batch's keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headrow.functions.text import none_if_blank, strip
from headrow.functions.urls import canonicalize_url
from headrow.operators.archive import build_change_log, build_snapshots, resolve_known
from headrow.plans.lineage import collecting, cut, discard
from headrow.sources.commit_log import CommitLog, Conflict, File, Snapshot

FANOUT = 4  # folders of one level that are compacted together
BUCKETS = 64

# states: the key (whose first column gives the bucket), and how each other column merges
STATES: dict[str, tuple[list[str], dict[str, Callable[[str], Column]]]] = {
    "ids": (["p"], {"item_id": F.min}),
    "urls": (["u"], {"state": F.max}),
    "items": (["item_id"], {"name": F.max, "external_id": F.max, "latest": F.max, "created": F.min, "published": F.min, "raw": F.min, "first_seen_at": F.min, "last_seen_at": F.max}),
    "item_url_identities": (["item_id", "identity_key"], {}),
    "observations": (["item_id", "source_id"], {"upstream": F.min, "first_seen_at": F.min, "last_seen_at": F.max, "latest": F.max, "first": F.min}),
    "item_versions": (["item_id", "title_hash"], {"first": F.min, "first_seen_at": F.min, "last_seen_at": F.max}),
}
_APPENDED = "rows", "taken", "snapshots", "snapshot_entries", "change_log"


def merged(name: str, states: DataFrame) -> DataFrame:
    return _merged(STATES[name], states)


def _merged(spec: tuple[list[str], dict[str, Callable[[str], Column]]], states: DataFrame) -> DataFrame:
    keys, columns = spec
    return states.groupBy(*keys).agg(*(how(c).alias(c) for c, how in columns.items())) if columns else states.select(*keys).distinct()


def states_of(rows: DataFrame, taken: DataFrame) -> dict[str, DataFrame]:
    """States of items, aliases, observations and versions that resolved rows leave; taken: (item_id, token) of older items that got an id."""
    wrote = F.col("rep")
    known = lambda c: F.min(F.when(wrote & F.col(c).isNotNull(), F.struct("obs_seq", F.col(c).alias("value"))))
    items = rows.groupBy("item_id").agg(
        F.max(F.struct((F.col("token") != F.col("u")).alias("has_id"), "token")).alias("name"),
        F.max(none_if_blank(F.col("external_id"))).alias("external_id"),
        F.max(F.when(wrote & F.col("seen_at").isNotNull(), F.struct("seen_at", "obs_seq", strip(F.col("url")).alias("url")))).alias("latest"),
        F.min(F.struct("obs_seq", "item_kind", "entity_kind", "item_variant")).alias("created"),
        known("published_at").alias("published"), known("raw_published_at").alias("raw"),
        F.min(F.when(wrote, F.col("seen_at"))).alias("first_seen_at"), F.max(F.when(wrote, F.col("seen_at"))).alias("last_seen_at"),
    )
    names = taken.select("item_id", F.struct(F.lit(True).alias("has_id"), "token").alias("name"))
    reps = rows.where("rep").withColumn("ext", none_if_blank(F.col("external_id")))
    observations = reps.groupBy("item_id", "source_id").agg(
        F.min(F.when(F.col("ext").isNotNull(), F.struct("obs_seq", "ext"))).alias("upstream"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"),
        F.max(F.struct("seen_at", "obs_seq", "position")).alias("latest"), F.min("obs_seq").alias("first"),
    )
    versions = reps.groupBy("item_id", "title_hash").agg(
        F.min(F.struct("obs_seq", strip(F.col("title")).alias("title"))).alias("first"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )
    return {
        "items": merged("items", items.unionByName(names, allowMissingColumns=True)), "item_url_identities": rows.select("item_id", F.col("u").alias("identity_key")).distinct(),
        "observations": observations, "item_versions": versions,
    }


def tables_of(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Archive tables of merged states, as the builds of whole archives have them."""
    items = states["items"].select(
        "item_id", F.col("name.token").alias("identity_key"), "external_id", F.col("latest.url").alias("original_url"), "created.item_kind", "created.entity_kind", "created.item_variant",
        F.col("published.value").alias("published_at"), F.col("raw.value").alias("raw_published_at"), "first_seen_at", "last_seen_at",
    )
    seen = F.col("latest.position").alias("position")
    return {
        "items": items.withColumn("canonical_url", canonicalize_url(F.col("original_url"))),
        "item_url_identities": states["item_url_identities"],
        "observations": states["observations"].select("source_id", "item_id", F.col("upstream.ext").alias("upstream_id"), "first_seen_at", "last_seen_at", seen),
        "item_versions": states["item_versions"].select("item_id", "title_hash", F.col("first.obs_seq").alias("version_id"), F.col("first.title").alias("title"), "first_seen_at", "last_seen_at"),
    }


def _urls_after(urls: DataFrame, rows: DataFrame, taken: DataFrame, batch: int) -> DataFrame:
    """(u, state) of the URLs of rows after a batch; state begins with the batch's number and has what archive.seed_state() has."""
    old = urls.select("u", F.col("dp").alias("o_dp"), F.col("firstp").alias("o_firstp"), F.col("live").alias("o_live"))
    pairs = rows.where("p is not null").groupBy("u", "p").agg(F.min("obs_seq").alias("o")).join(old, "u", "left")
    more = F.count_if(~F.coalesce(F.col("p") == F.col("o_firstp"), F.lit(False)))
    seen = pairs.groupBy("u").agg(more.cast("int").alias("more"), F.min_by("p", "o").alias("n_firstp"))
    alive = rows.where("p is null and token = u").groupBy("u").agg(F.min("item_id").alias("n_live"))
    gone = taken.select(F.col("item_id").alias("o_live"), F.lit(True).alias("gone"))
    all_ = rows.select("u").distinct().join(old, "u", "left").join(seen, "u", "left").join(alive, "u", "left").join(gone, "o_live", "left")
    dp = F.least(F.lit(2), F.coalesce("o_dp", F.lit(0)) + F.coalesce("more", F.lit(0)))
    live = F.coalesce("n_live", F.when(F.col("gone").isNull(), F.col("o_live")))
    return all_.select("u", F.struct(F.lit(batch).cast("long").alias("batch"), dp.alias("dp"), F.coalesce("o_firstp", "n_firstp").alias("firstp"), live.alias("live")).alias("state"))


class StateTables:
    """Mergeable states (as STATES has them) and appended tables below root, changed by one commit a batch.

    When fanout folders of a table have one level, they are merged by bucket to one of the next level, which takes their place in one commit. So a table has at most
    fanout - 1 folders a level, and as many levels as the logarithm of the number of batches. Readers work on one version of the log.
    """

    def __init__(self, spark: SparkSession, root: str, states: dict[str, tuple[list[str], dict[str, Callable[[str], Column]]]], buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.root, self.states, self.buckets, self.fanout = spark, root, states, buckets, fanout
        self.log = CommitLog(spark, root)

    def _bucketed(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))

    def _write(self, name: str, df: DataFrame, batch: str, level: int = 0) -> list[File]:
        """The folder written; none for states of no key."""
        f = File(name, f"{self.root}/{name}/folder={uuid.uuid4().hex}", batch, level)
        if name not in self.states:
            df.write.parquet(f.path)
            return [f]
        self._bucketed(df, self.states[name][0][0]).repartition("bucket").write.partitionBy("bucket").parquet(f.path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return [f] if any(s.getPath().getName().startswith("bucket=") for s in there) else []

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop("folder")

    def _state(self, seen: Snapshot, name: str, keys: DataFrame, like: DataFrame | None = None) -> DataFrame | None:
        """Merged states of the given keys (their bucket's column); only their buckets are read."""
        paths, key = seen.paths(name), self.states[name][0][0]
        if not paths:
            return None
        wanted = self._bucketed(keys.distinct(), key)
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most self.buckets
        whole = self._read(name, paths).where(F.col("bucket").isin(buckets)).drop("bucket")
        return _merged(self.states[name], whole.join(wanted.select(key), key, "left_semi"))

    def compact(self) -> None:
        """Merge the folders of each table that has FANOUT or more of one level, until none has."""
        while True:
            seen = self.log.snapshot()
            groups: dict[tuple[str, int], list[File]] = {}
            for f in seen.files.values():
                groups.setdefault((f.table, f.level), []).append(f)
            full = {k: fs for k, fs in groups.items() if len(fs) >= self.fanout}
            if not full:
                return
            made, gone = [], []
            for (name, level), files in full.items():
                whole = self._read(name, [f.path for f in files])
                whole = _merged(self.states[name], whole.drop("bucket")) if name in self.states else whole.hint("rebalance")
                made += self._write(name, whole, "compacted", level + 1)
                gone += [f.path for f in files]
            try:
                self.log.commit(seen, None, made, gone, gone)
            except Conflict:  # another one compacted them
                return

    def remove_old(self) -> None:
        """Delete folders that the newest version doesn't hold, see CommitLog.remove_old()."""
        self.log.remove_old()


class IncrementalArchive(StateTables):
    """An archive below root to which batches of runs are added, one commit each, in the order of their obs_seq.

    apply() costs what the batch's own keys cost: it reads ids and URLs, observations and versions in the buckets that those keys fall in.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        super().__init__(spark, root, STATES, buckets, fanout)

    def apply(self, accepted: DataFrame, batch: int, runs: DataFrame | None = None) -> None:
        """Add a batch of accepted candidates, whole runs behind all earlier ones; runs: the batch's successful runs, see build_snapshots().

        A batch that has been committed is left alone, so a batch can be repeated after a failure at any point.
        """
        seen = self.log.snapshot()
        if str(batch) in seen.batches:
            return
        used: list[str] = []
        with collecting(used):
            rows = cut(accepted)
            none = self.spark.createDataFrame([], "u string, state struct<batch:bigint,dp:int,firstp:string,live:bigint>")
            urls = self._state(seen, "urls", rows.select("u"))
            urls = cut((none if urls is None else urls).select("u", "state.dp", "state.firstp", "state.live"))
            named = rows.select("p").unionByName(urls.select(F.col("firstp").alias("p"))).where("p is not null")
            ids = self._state(seen, "ids", named)
            ids = cut(self.spark.createDataFrame([], "p string, item_id long") if ids is None else ids)
            found, taken = (cut(x) for x in resolve_known(ids, urls, rows))
            new = {n: cut(s) for n, s in states_of(found, taken).items()}
            touched = found.where("rep").select("item_id").distinct()
            with_old = lambda n: new[n] if (old := self._state(seen, n, touched)) is None else merged(n, old.unionByName(new[n]))
            versions = with_old("item_versions").select("item_id", "title_hash", F.col("first.obs_seq").alias("version_id"))
            firsts = with_old("observations").select("item_id", "source_id", F.col("first").alias("seen_first"))
            at = F.col("obs_seq")
            told = found.where("rep").join(versions, ["item_id", "title_hash"]).join(firsts, ["item_id", "source_id"])
            told = cut(told.select(*found.columns, "version_id", (at == F.col("item_id")).alias("inew"), (at == F.col("seen_first")).alias("onew"), (at == F.col("version_id")).alias("vnew")))
            new |= {"ids": found.where("p is not null").groupBy("p").agg(F.min("item_id").alias("item_id")).join(ids, "p", "left_anti"), "urls": _urls_after(urls, found, taken, batch)}
            snapshots, entries = build_snapshots(told, runs)
            new |= {"rows": found, "taken": taken, "snapshots": snapshots, "snapshot_entries": entries, "change_log": build_change_log(told)}
            made = [f for n, df in new.items() for f in self._write(n, df, str(batch))]
        try:
            self.log.commit(seen, str(batch), made, keys=["batches"])
        finally:
            discard(self.spark, used)
        self.compact()

    def changes(self, after: int, version: int | None = None) -> DataFrame | None:
        """Change events with a greater seq, at a version of the log; None before the first commit. Batches hold rising seqs, so Parquet's statistics leave out most older files."""
        paths = self.log.snapshot(version).paths("change_log")
        return self._read("change_log", paths).where(F.col("seq") > after) if paths else None

    def of_items(self, keys: DataFrame, version: int | None = None) -> dict[str, DataFrame]:
        """Items, aliases, observations and versions of the item_ids in keys, at a version of the log that has some; only those items' buckets are read."""
        seen = self.log.snapshot(version)
        return tables_of({n: self._state(seen, n, keys.select("item_id")) for n in ("items", "item_url_identities", "observations", "item_versions")})

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of build_archive() at a version of the log, resolved rows (with the ids that items got later) among them; empty if no batch had a row."""
        seen = self.log.snapshot(version)
        if not seen.paths("items"):
            return {}
        states = "items", "item_url_identities", "observations", "item_versions"
        whole = {n: self._read(n, seen.paths(n)) for n in (*states, *_APPENDED)}
        out = tables_of({n: merged(n, whole[n].drop("bucket")) for n in states})
        late = whole["taken"].select("item_id", F.col("token").alias("__token"))
        rows = whole["rows"]
        out["resolved"] = rows.join(late, "item_id", "left").withColumn("token", F.coalesce("__token", "token")).select(*rows.columns)
        return out | {n: whole[n] for n in ("snapshots", "snapshot_entries", "change_log")}
