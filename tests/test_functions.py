import datetime as dt
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from headrow.functions import checks, text, times, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_normalize_and_canonicalize(spark):
    given = [
        " HTTPS://User:pw@Example.COM:443/A/b?x=1&utm_source=z#frag ", "http://example.com:80", "http://example.com:8080/p?", "http://[2001:DB8::1]:80/x",
        "https://e.com/?utm_source=a&b=%20&UTM_Medium=q&b=2&fbclid", "https://e.com/?utm%5Fsource=1&c", "https://e.com:0443/a;b?c=d?e", None,
    ]
    assert column(spark, given, urls.normalize_url_for_identity) == [
        "https://example.com/A/b?x=1&utm_source=z", "http://example.com", "http://example.com:8080/p", "http://[2001:db8::1]/x",
        "https://e.com/?utm_source=a&b=%20&UTM_Medium=q&b=2&fbclid", "https://e.com/?utm%5Fsource=1&c", "https://e.com/a;b?c=d?e", None,
    ]
    assert column(spark, given, urls.canonicalize_url)[:1] + column(spark, given, urls.canonicalize_url)[4:6] == [
        "https://example.com/A/b?x=1", "https://e.com/?b=%20&b=2", "https://e.com/?c",
    ]


def test_http_urls(spark):
    good = ["http://a.example", "https://a.example:65535/x?y#z", "HTTP://A", "http://[::1]/", "https://u:p@h/"]
    bad = ["", "ftp://a", "http://", "http:///x", "a.example/x", "http://a b", "http://a b", "http://a/\x7f", 'http://a/"', "http://a:65536", "http://a:x", "http://a|b", "http://[::1", None, "http://a\\b", "http://a/{x}"]
    assert column(spark, good, urls.is_http_url) == [True] * len(good)
    assert column(spark, bad, urls.is_http_url) == [False] * len(bad)


def test_url_helpers(spark):
    from urllib.parse import quote, urljoin

    words = ["a b", "中文*~/+", "100%", ""]
    assert column(spark, words, urls.quote_component) == [quote(w, safe="") for w in words]
    hrefs = ["/x", "y?z", "//h/p", "../up", "", None]
    base = "https://e.example/a/b/c"
    got = column(spark, hrefs, lambda c: urls.absolute_url(F.lit(base), c))
    assert got == [None if h is None else urljoin(base, h) for h in hrefs]
    assert column(spark, ["https://U@h.example:1/p?q#f"], urls.safe_url) == ["https://h.example:1/p"]


def test_titles(spark):
    given = ["  A　 b\tc ", "ﬁne Ｗide", "Straße", "", " ", "plain", None]
    want = [None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()) for x in given]
    assert column(spark, given, text.normalize_title) == want
    assert column(spark, given, text.title_hash) == [None if w is None else hashlib.sha256(w.encode()).hexdigest() for w in want]
    keys = column(spark, given, lambda c: text.title_cluster_key(c, F.lit("article"), F.lit(None).cast("string")))
    assert keys[2] == "title:article::strasse" and keys[3] == "" and keys[4] == "" and keys[5] == "title:article::plain"


def test_title_search_is_literal_and_ascii_only(spark):
    titles = ["50% OFF_now", "50x offanow", "ÀB", "àb", r"a\b"]
    found = lambda q: column(spark, titles, lambda c: text.title_search(c, q))
    assert found("50% off_") == [True, False, False, False, False]
    assert found("Àb") == [False, False, True, False, False]
    assert found("A\\B") == [False, False, False, False, True]


def test_flash_and_errors(spark):
    assert column(spark, ["<b>【Head】</b>rest", "no head", "<B>x</B>"], text.headline_from_flash) == ["Head", "no head", "x"]
    assert column(spark, [" a \n b ", "", None], lambda c: text.error_message(c, F.lit("ValueError"))) == ["a b", "ValueError", "ValueError"]


UTC = dt.timezone.utc


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000123", dt.datetime(2023, 11, 14, 22, 13, 20, 123000)),
        ("1.7e9", dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("20260917", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=20260917)),
        ("2026-09-17T08:00:00Z", dt.datetime(2026, 9, 17, 8)),
        ("2026-09-17T08:00:00.123456+08:00", dt.datetime(2026, 9, 17, 0, 0, 0, 123456)),
        ("2026-09-17 08:00+0530", dt.datetime(2026, 9, 17, 2, 30)),
        ("2026-09-17T08:00:00", None),
        ("2026-09-17", None),
        ("Thu, 17 Sep 2026 08:00:00 GMT", dt.datetime(2026, 9, 17, 8)),
        ("17 Sep 2026 08:00 EST", dt.datetime(2026, 9, 17, 13)),
        ("Thu, 17 Sep 2026 08:00:00 -0000", None),
        ("2026-13-40T00:00:00Z", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_timestamp(spark, raw, want):
    us = column(spark, [raw], lambda c: F.unix_micros(times.parse_timestamp(c)))[0]
    assert us == (None if want is None else int(want.replace(tzinfo=UTC).timestamp() * 1_000_000 + 0.5))


def test_relative_and_since(spark):
    now = F.lit("2026-09-17 01:00:00").cast("timestamp")
    said = column(spark, ["刚刚", "3分钟前", "2 小時前", "1天前", "昨天 12:05", "昨天 25:00", "前天", ""], lambda c: times.parse_relative_time(c, now).cast("string"))
    assert said == ["2026-09-17 01:00:00", "2026-09-17 00:57:00", "2026-09-16 23:00:00", "2026-09-16 01:00:00", "2026-09-16 04:05:00", None, None, None]
    since = column(spark, ["7d", "2 W", "3m", "1y", "5", "x", "-1d"], lambda c: times.parse_since(c, now).cast("string"))
    assert since == ["2026-09-10 01:00:00", "2026-09-03 01:00:00", "2026-06-19 01:00:00", "2025-09-17 01:00:00", "2026-09-12 01:00:00", None, None]
    assert column(spark, [1, 3], lambda c: times.calendar_window_start(c, now).cast("string"), "int") == ["2026-09-16 16:00:00", "2026-09-14 16:00:00"]
    assert column(spark, ["20260917080000", "2026091708000", "20261317080000"], lambda c: times.parse_compact_date(c).cast("string")) == ["2026-09-17 00:00:00", None, None]


def test_json_scalars(spark):
    given = ["1", "true", '"1"', "1.5", "null", "[]", '" x "', "12345678901234567890"]
    v = lambda c: F.parse_json(c)
    assert column(spark, given, lambda c: checks.optional_integer(v(c)))[:7] == [1, None, None, None, None, None, None]
    assert column(spark, given, lambda c: checks.optional_finite_number(v(c)))[:7] == [1.0, None, None, 1.5, None, None, None]
    assert column(spark, given, lambda c: checks.text_of(v(c)))[:7] == [None, None, "1", None, "", None, "x"]
    assert column(spark, given, lambda c: checks.scalar_text_of(v(c)))[:7] == ["1", None, "1", "1.5", "", None, "x"]


def test_plain_urls_go_the_short_way_to_the_same_result(spark):
    """URLs at the edge of the pattern for normal ones: what they give is what the same URL gives with a port that is dropped."""
    tails = ["", "/", "/a", "/a?", "/a?x=1", "?", "?x", "?utm_source=a", "/a?utm_source=a&b=2", "/a?x#f", "#f", "/a#", "/a b", "/a\n", "/a?x　", "/aé", "/a?x?y", "/<", "/a|b", "//x", ":", "/a\\b"]
    rows = [(i, f"https://e.example{t}", f"HTTPS://E.example:443{t}" if t != ":" else "HTTPS://E.example:") for i, t in enumerate(tails)]
    both = lambda f: [f(F.col("plain")), f(F.col("long"))]
    df = spark.createDataFrame([*rows, (99, None, None)], "i int, plain string, long string")
    for f in (urls.normalize_url_for_identity, urls.canonicalize_url, urls.is_http_url):
        for r in df.select("i", *(c.alias(n) for c, n in zip(both(f), "ab"))).collect():
            assert r.a == r.b, (f.__name__, r)


def test_long_titles_are_folded_a_few_at_a_time():
    """No more than a slice of a batch is held as Python strings, whatever the batch holds."""
    import pyarrow as pa

    held, most = [], 0

    class Texts:
        """A column that notes how much of it is made into strings at once."""

        def __init__(self, array):
            self.array, self.type, self.null_count = array, array.type, array.null_count

        def __len__(self):
            return len(self.array)

        def slice(self, *at):
            return Texts(self.array.slice(*at))

        def to_pylist(self):
            held.append(sum(len(x or "") for x in self.array.to_pylist()))
            return self.array.to_pylist()

    texts = pa.array([None, "", *(f"É {i} " * 60_000 for i in range(20)), None, "ß"])
    lengths, text.pc.binary_length = text.pc.binary_length, lambda t: lengths(t.array)
    try:
        got = text._each(Texts(texts), str.lower)
    finally:
        text.pc.binary_length = lengths
    most = max(held)
    assert got.to_pylist() == [None if x is None else x.lower() for x in texts.to_pylist()]
    assert len(held) > 5 and most <= text._SLICE_BYTES + 400_000
    assert text._each(pa.array([], pa.string()), str.lower).to_pylist() == []
    assert text._each(pa.array([None, None], pa.string()), str.lower).to_pylist() == [None, None]
