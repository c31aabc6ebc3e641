import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from headrow.llm.mixing import budgets
from headrow.plans.lineage import cut
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {0: {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}}
    for i, (_, stage) in enumerate(cp.STAGES, 1):
        docs = cut(stage(spark, docs, SF))
        if i < len(cp.STAGES):
            assert docs.columns == cp.COLUMNS
            kept[i] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert kept[i].items() <= kept[i - 1].items() and len(kept[i]) < len(kept[i - 1])
    first = {}
    for d, t in sorted(kept[1].items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), d)
    assert set(kept[2]) == set(first.values())
    near = brute_components(sorted(kept[2].items()), 5, 80, 100)
    assert set(kept[3]) == {c for _, c in near.values()}
    assert docs.count() == len(kept[4])
    assert {r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()} == set(kept[4])


def test_labelled_clean_documents_pass_the_quality_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    clean = docs.join(clean, "doc_id", "left_semi").where(F.expr("size(split(text, ' ')) >= 50"))
    passed = cp.quality(spark, docs, SF).join(clean.select("doc_id"), "doc_id", "left_semi").count()
    assert passed >= 0.97 * clean.count() and budgets({}, 5, 1, lambda p, n: 1.0) == {}


def test_pipeline_on_empty_null_and_long_texts(spark, tmp_path):
    """An empty table gives no rows; null and empty texts go by their words; a very long text and null languages and sources pass through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    part = docs.orderBy("doc_id").limit(300)
    most = part.agg(F.max("doc_id")).first()[0]
    long = " ".join(r.text for r in docs.where("lang = 'en'").orderBy(F.desc("doc_id")).limit(200).select("text").collect() if r.text)
    more = [(most + 1, None, None, None, 0), (most + 2, "", None, "src", 0), (most + 3, long, None, None, len(long)), (None, None, "en", None, 0)]
    odd = spark.createDataFrame(more, docs.schema).withColumn("extra", F.lit(1))
    part.withColumn("extra", F.lit(1)).unionByName(odd).write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    kept = {r.doc_id for r in cp.quality(spark, rows, "").collect()}
    assert not kept & {most + 1, most + 2, None}
    for _, stage in cp.STAGES[1:]:
        out = stage(spark, rows, "")
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in rows.select("doc_id").collect()} and ids
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/odd").select("doc_id").collect()} <= kept
