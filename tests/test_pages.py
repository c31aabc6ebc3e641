import random

from pyspark.sql import functions as F

from headrow.operators.browse import browse_after, page_of


def test_pages_by_counting_equal_the_sorted_rows(spark):
    """Many items of one time, ties, gaps of years, any page; and page after page by the last row."""
    rnd = random.Random(4)
    rows = [(i * 3, rnd.choice([0, 0, 0, 1, 5, 10**9, rnd.randrange(10**12), 10**15])) for i in range(700)]
    keys = spark.createDataFrame(rows, "item_id long, us long").select("item_id", F.timestamp_micros("us").alias("first_seen_at")).cache()
    order = [i for i, _ in sorted(rows, key=lambda r: (-r[1], -r[0]))]
    for offset in (0, 300, 699, 700):
        for small, cells in ((1, 5), (40, 16)):
            got = [r.item_id for r in page_of(keys, len(rows), offset, 7, cells, small).collect()]
            assert sorted(got) == sorted(order[offset : offset + 7]), (offset, small)
    seen, last = [], (F.lit("9999-01-01").cast("timestamp"), F.lit(0))
    for _ in range(3):
        page = browse_after(keys, *last, page_size=50).collect()
        seen += [r.item_id for r in page]
        last = F.lit(page[-1].first_seen_at), F.lit(page[-1].item_id)
    assert seen == order[:150]
    assert page_of(keys.limit(0), 0, 0, 7).count() == 0
