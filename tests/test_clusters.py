import random

from headrow.operators.cluster import IncrementalClusters, cluster_headlines, cluster_keys

ROW = "source_id string, item_id long, title string, canonical_url string, item_kind string, entity_kind string"


def test_clusters_after_batches_equal_the_whole(spark, tmp_path):
    """Clusters join over batches, labels change more than once, rows come with one key or none; a batch comes twice."""
    rnd = random.Random(3)
    rows = [("s", i, rnd.choice([f"T{rnd.randrange(40)}", "", None]), rnd.choice([f"https://e/{rnd.randrange(60)}", None, ""]), "article", None) for i in range(120)]
    kept = IncrementalClusters(spark, f"file://{tmp_path}/c", buckets=2, fanout=2)
    assert kept.clusters().count() == 0 == kept.changes().count()
    before = None
    for i, n in enumerate((40, 80, 120)):
        part = spark.createDataFrame(rows[n - 40 : n], ROW)
        kept.apply(part, i)
        if i == 1:
            kept.apply(spark.createDataFrame(rows[:5], ROW), i)
        whole = cluster_headlines(spark.createDataFrame(rows[:n], ROW)).collect()
        want = {k: r.cluster_id for r in whole for k in (r.url_key, r.title_key) if k}
        got = {r.key: r.cluster_id for r in kept.clusters().collect()}
        assert got == want
        if before:
            told = {(r.label, r.into) for r in kept.changes().where(f"batch = {i}").collect()}
            assert told == {(a, got[k]) for k, a in before.items() if got[k] != a}
        before = got
    assert len(kept.log.snapshot().of("keys")) <= 2
