"""Story clusters: headlines joined by canonical URL or normal title, transitively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headrow.functions.text import duplicate_label, title_cluster_key
from headrow.operators.components import connected_components
from headrow.operators.increments import BUCKETS, FANOUT, StateTables
from headrow.plans.lineage import collecting, cut, discard
from headrow.sources.commit_log import Snapshot


def cluster_keys(rows: DataFrame) -> DataFrame:
    """Add url_key and title_key; a row with neither gets a key of its own."""
    url = F.when(F.coalesce("canonical_url", F.lit("")) != "", F.concat(F.lit("canonical:"), F.col("canonical_url"))).otherwise("")
    title = F.coalesce(title_cluster_key(F.col("title"), F.col("item_kind"), F.col("entity_kind")), F.lit(""))
    keyed = rows.withColumn("url_key", url).withColumn("title_key", title)
    own = F.concat_ws(":", F.lit("row"), F.col("source_id"), F.col("item_id").cast("string"))
    return keyed.withColumn("url_key", F.when((F.col("url_key") == "") & (F.col("title_key") == ""), own).otherwise(F.col("url_key")))


def cluster_headlines(rows: DataFrame) -> DataFrame:
    """Add cluster_id: the smallest key of the rows joined over shared URL or title keys.

    Components are found on distinct key pairs, not on rows; a key pair whose two keys occur in no other pair, and in no row of one key, needs
    no search.
    """
    keyed = cluster_keys(rows)
    found = keyed.select("url_key", "title_key").distinct()  # a row of one key may share it with a pair
    pairs = found.where("url_key <> '' and title_key <> ''")
    shared = [
        pairs.join(found.where(F.col(c) != "").groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c), c, "left_semi") for c in ("url_key", "title_key")
    ]
    parts = connected_components(shared[0].unionByName(shared[1]).distinct(), "url_key", "title_key")
    key = F.when(F.col("url_key") != "", F.col("url_key")).otherwise(F.col("title_key"))
    found = keyed.withColumn("key", key).join(parts.select(F.col("node").alias("key"), "component"), "key", "left")
    alone = F.when((F.col("url_key") != "") & (F.col("title_key") != ""), F.least("url_key", "title_key")).otherwise(F.col("key"))
    return found.withColumn("cluster_id", F.coalesce("component", alone)).drop("key", "component")


class IncrementalClusters(StateTables):
    """Clusters below root that are kept as rows arrive: a batch joins labels, it doesn't look at earlier rows.

    keys has each key's label, the smallest key of its cluster, as it was when the key came; merges has the label that a label was joined into.
    Labels only become smaller, so both merge by minimum. A batch looks up its own keys, follows their labels to the present ones, and finds components of edges between those; every label it
    came by is written with the one it leads to, so that ways stay short. changes has what each batch joined.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        super().__init__(spark, root, {"keys": (["key"], {"label": F.min}), "merges": (["label"], {"into": F.min})}, buckets, fanout)

    def _roots(self, seen: Snapshot, labels: DataFrame) -> DataFrame:
        """(label, root): the present label of each."""
        found = cut(labels.distinct().withColumn("root", F.col("label")))
        while (into := self._state(seen, "merges", found.select(F.col("root").alias("label")))) is not None:
            step = found.join(into.select(F.col("label").alias("root"), "into"), "root", "left")
            found = cut(step.select("label", F.coalesce("into", "root").alias("root"), F.col("into").isNotNull().alias("moved")))
            if found.where("moved").isEmpty():
                break
            found = found.drop("moved")
        return found.select("label", "root")

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Add a batch of headlines, as cluster_headlines() takes them; a batch that has been committed is left alone."""
        seen = self.log.snapshot()
        if str(batch) in seen.batches:
            return
        used: list[str] = []
        with collecting(used):
            pairs = cut(cluster_keys(rows).select(F.nullif("url_key", F.lit("")).alias("a"), F.nullif("title_key", F.lit("")).alias("b")).distinct())
            pairs = pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
            keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            old = self._state(seen, "keys", keys)
            old = cut(self.spark.createDataFrame([], "key string, label string") if old is None else old)
            roots = self._roots(seen, old.select("label"))
            at = cut(keys.join(old, "key", "left").join(roots, "label", "left").select("key", "label", F.coalesce("root", "key").alias("root")))
            ends = [at.select(F.col("key").alias(c), F.col("root").alias("r" + c)) for c in "ab"]
            parts = connected_components(pairs.join(ends[0], "a").join(ends[1], "b"), "ra", "rb").select(F.col("node").alias("root"), "component")
            now = cut(at.join(parts, "root"))
            joined = now.where("label is not null and root <> component").select(F.col("root").alias("label"), F.col("component").alias("into")).distinct()
            short = now.where("label <> component").select("label", F.col("component").alias("into")).distinct()
            new = {"keys": now.where("label is null").select("key", F.col("component").alias("label")), "merges": joined.unionByName(short).distinct(), "changes": joined.withColumn("batch", F.lit(batch).cast("long"))}
            made = [f for n, df in new.items() for f in self._write(n, df, str(batch))]
        self.log.commit(seen, str(batch), made, keys=["batches"])
        discard(self.spark, used)
        self.compact()

    def clusters(self, version: int | None = None) -> DataFrame:
        """(key, cluster_id) of every key; empty if no batch had a row."""
        seen = self.log.snapshot(version)
        if not seen.paths("keys"):
            return self.spark.createDataFrame([], "key string, cluster_id string")
        keys = cut(self._read("keys", seen.paths("keys")).groupBy("key").agg(F.min("label").alias("label")))
        return keys.join(self._roots(seen, keys.select("label")), "label").select("key", F.col("root").alias("cluster_id"))

    def changes(self, version: int | None = None) -> DataFrame:
        """(batch, label, into): which labels each batch joined into others."""
        paths = self.log.snapshot(version).paths("changes")
        return self._read("changes", paths) if paths else self.spark.createDataFrame([], "label string, into string, batch long")


def _chronology(order: str) -> Column:
    return F.col("first_seen_at") if order == "observed" else F.col("published_at")


def _order(order: str) -> list[Column]:
    return [_chronology(order).desc_nulls_last(), F.col("source_name"), F.coalesce("position", F.lit(0)), F.col("item_id")]


def cluster_representative(clustered: DataFrame, order: str = "observed") -> DataFrame:
    """The newest row of each cluster; by publication, clusters without a dated row are left out."""
    rows = clustered if order == "observed" else clustered.where("published_at is not null")
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*_order(order)))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n")


def headline_groups(clustered: DataFrame, order: str = "observed") -> DataFrame:
    """All appearances of each cluster, a row each, with their place in it (from 1, undated ones last) and the time of its representative.

    The row at place 1 represents its cluster; by publication, clusters without a dated row are left out. Groups sort newest first by group_time.
    No task sorts a whole cluster: rows are ranked inside an hour, and what stands before an hour comes from windows over one row an hour.
    """
    rows = clustered.withColumn("__hour", F.coalesce(F.date_format(_chronology(order), "yyyy-MM-dd HH"), F.lit("")))
    hours = rows.groupBy("cluster_id", "__hour").agg(F.count(F.lit(1)).alias("n"), F.max(_chronology(order)).alias("newest"))
    cluster = Window.partitionBy("cluster_id")
    newer = cluster.orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("cluster_id", "__hour", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("__before"), F.max("newest").over(cluster).alias("group_time"))
    nth = F.row_number().over(Window.partitionBy("cluster_id", "__hour").orderBy(*_order(order)))
    placed = rows.withColumn("__nth", nth).join(hours.where("group_time is not null"), ["cluster_id", "__hour"])
    return placed.withColumn("place", (F.col("__nth") + F.col("__before")).cast("long")).select(*clustered.columns, "place", "group_time")


def headline_feed(clustered: DataFrame, order: str = "observed") -> DataFrame:
    """One row a cluster, with how many more rows it has."""
    size = clustered.groupBy("cluster_id").agg((F.count(F.lit(1)) - 1).alias("duplicate_count"))
    rep = cluster_representative(clustered, order).join(size, "cluster_id")
    return rep.select(
        "cluster_id", "title", "url", "published_at", "first_seen_at", "source_name", "duplicate_count",
        duplicate_label(F.col("source_name"), F.col("duplicate_count")).alias("source_label"),
    )
