"""Literal substring search of titles by postings of trigrams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headrow.functions.text import ascii_fold, title_search
from headrow.sources.commit_log import CommitLog, File, Snapshot

_SPREAD = 8  # tasks that write the postings of a bucket: one trigram may be in every title
_RAREST = 4  # trigrams of a query whose postings are intersected


def grams(text: Column) -> Column:
    """The distinct runs of three code points of a folded text; none of a shorter one."""
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(3))))


class TitleIndex:
    """Titles and their trigrams below root: postings (gram, item_id) lie in buckets of their gram, sorted, and titles in buckets of their item.

    Batches of titles are added in order, one commit each; the last title of an item is the one that is searched. Postings of titles that were replaced
    stay and only cost a look, since every item found is checked against its title. Searches work on one version of the log.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets, self.log = spark, root, buckets, CommitLog(spark, root)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def add(self, titles: DataFrame, batch: int) -> None:
        """Add (item_id, title), one title an item; null titles are left out. A batch that has been committed is left alone."""
        seen = self.log.snapshot()
        if str(batch) in seen.batches:
            return
        rows = titles.where("title is not null").select("item_id", "title")
        said = rows.select("item_id", F.struct(F.lit(batch).cast("long").alias("batch"), "title").alias("said"), self._bucket(F.col("item_id")).alias("bucket"))
        found = rows.select("item_id", F.explode(grams(ascii_fold(F.col("title")))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        postings = found.repartition("bucket", F.pmod(F.xxhash64("item_id"), F.lit(_SPREAD))).sortWithinPartitions("bucket", "gram")
        made = [File(n, f"{self.root}/{n}/folder={uuid.uuid4().hex}", str(batch)) for n in ("titles", "postings")]
        said.repartition("bucket").write.partitionBy("bucket").parquet(made[0].path)
        postings.write.partitionBy("bucket").parquet(made[1].path)
        self.log.commit(seen, str(batch), made, keys=["batches"])

    def _read(self, seen: Snapshot, name: str) -> DataFrame:
        kinds = {"titles": "item_id long, said struct<batch:bigint,title:string>, bucket int, folder string", "postings": "item_id long, gram string, bucket int, folder string"}
        return self.spark.read.schema(kinds[name]).option("basePath", f"{self.root}/{name}").parquet(*seen.paths(name)).drop("folder")

    def postings(self, seen: Snapshot, wanted: list[str]) -> DataFrame:
        """Postings of the given trigrams; only their buckets are listed, and the row groups whose range holds one are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()]
        return self._read(seen, "postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).select("gram", "item_id")

    def search(self, query: str, version: int | None = None) -> DataFrame:
        """(item_id, title) of the items whose title holds query, as title_search() has it; %, _ and \\ are characters like others.

        The postings of the query's four rarest trigrams are intersected, and what is left is checked. A query of less than three characters has no trigram:
        all titles are looked at.
        """
        seen = self.log.snapshot(version)
        if not seen.files:
            return self.spark.createDataFrame([], "item_id long, title string")
        said = self._read(seen, "titles")
        folded = query.translate({c: c + 32 for c in range(65, 91)})
        wanted = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
        if wanted:
            held = self.postings(seen, wanted)
            counts = {r["gram"]: r["count"] for r in held.groupBy("gram").count().collect()}  # a row for each of the query's trigrams
            if len(counts) < len(wanted):
                return self.spark.createDataFrame([], "item_id long, title string")
            rare = sorted(wanted, key=lambda g: (counts[g], g))[:_RAREST]
            found = self.postings(seen, rare).distinct().groupBy("item_id").count().where(F.col("count") == len(rare)).select("item_id", self._bucket(F.col("item_id")).alias("bucket"))
            said = said.join(found, ["bucket", "item_id"], "left_semi")
        last = said.groupBy("item_id").agg(F.max("said").alias("said")).select("item_id", "said.title")
        return last.where(title_search(F.col("title"), query))
