import duckdb
import pytest

import __spark_entry__
from headrow.plans import lineage
from headrow.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"  # as the correctness gate has it: smaller tables hide rows of rare kinds


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "pages", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert got


def test_catalog_findings_cover_every_event(spark):
    """sf0.01 has 10,000 events, of which each fiftieth has a bad source id."""
    sf, name = "/root/testdata/sf0.01", "d5_catalog_violations"
    got = {tuple(r) for r in QUERIES[name](spark, sf).select("rule", "subject").collect()}
    assert {s for r, s in got if r == "bad_source_id"} == {f"Bad {i}" for i in range(0, 10_000, 50)}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert got == set(c.sql(ORACLE_SQL[name]).fetchall())


def test_projections_cover_every_document(spark, tmp_path):
    """Null, empty, blank and short texts, and a long first word and line."""
    name, long = "b10_b14_projections", "w" * 100
    rows = [(1, None), (2, ""), (4, "  \n x"), (5, "Short."), (7, f"{long} and more\nsecond line"), (9, None), (10, 'say"so" there')]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = {1: ("", "Document 1"), 2: ("", "Document 2"), 4: ("", "Document 4"), 5: ("Short.", "Short."), 7: (long, f"{long} and more"), 9: ("", "T 9"), 10: ("say", 'say"so" there')}
    assert {k: (r["head"], r.title) for k, r in got.items()} == want
    assert got[4].flash == "" and got[10].flash == 'say"so" there' and got[7].flash == rows[4][1]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r for r in c.sql(f"SELECT doc_id, head, title FROM ({ORACLE_SQL[name]})").fetchall()} == {k: (k, *v) for k, v in want.items()}


def test_tables_of_queries_are_deleted_on_close(spark):
    """What a query cuts is there while its result is read, and gone after close()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(lineage.shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in files.listStatus(path)}
    before = names()
    df = __spark_entry__.queries()["f2_latest_snapshot_headlines"](spark, "/root/testdata/sf0.001")
    assert df.count() and names() > before
    __spark_entry__.close(spark)
    assert names() <= before
