"""Times as column expressions; timestamps are instants, naive inputs need a zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from headrow.functions.text import let, strip

CHINA = "+08:00"
_WALL = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Seconds of relative units, days of window units, zone names of RFC 822.
RELATIVE_UNITS = {"秒": 1, "秒鐘": 1, "分钟": 60, "分鐘": 60, "小时": 3600, "小時": 3600, "天": 86400, "日": 86400}
WINDOW_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_OFFSET = r"([+-][0-9]{2}(:?[0-9]{2})?(:?[0-9]{2})?)$"
_ISO = r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}([ T][0-9]{2}(:?[0-9]{2}(:?[0-9]{2}([.,][0-9]{1,9})?)?)?([+-][0-9]{2}(:?[0-9]{2})?)?)?$"


def later(ts: Column, seconds: Column) -> Column:
    """ts moved by whole seconds; keeps the timestamp's kind, with or without zone."""
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def from_unix(number: Column) -> Column:
    """Unix seconds, or milliseconds from a magnitude of 1e10 on; null outside the years 1 to 9999."""
    n = number.cast("double")
    seconds = F.when(F.abs(n) >= 1e10, n / 1000).otherwise(n)
    return F.when(seconds.between(-62135596800, 253402300799), F.timestamp_micros(F.round(seconds * 1000000).cast("long")))


def _map(of: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def _instant(wall: Column, offset: Column) -> Column:
    """The instant of a wall time (a naive timestamp) at an offset like +08:00."""
    seconds = F.unix_micros(F.to_utc_timestamp(wall.cast("string"), "UTC"))
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("long") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("long"), F.lit(0))
    return F.timestamp_micros(seconds - sign * minutes * 60_000_000)


def parse_iso_timestamp(value: Column, naive_offset: str | None = None) -> Column:
    """ISO 8601 text as an instant. A value without offset is wall time at naive_offset, or null if that is None."""

    def whole(text: Column) -> Column:
        offset = F.when(text.rlike("[ T]"), F.regexp_extract(text, _OFFSET, 1)).otherwise("")
        return F.when(text.rlike(_ISO), let(offset, lambda offset: parts(text, offset)))

    def parts(text: Column, offset: Column) -> Column:
        bare = F.replace(F.substring(text, F.lit(1), F.length(text) - F.length(offset)), F.lit(","), F.lit("."))
        date = F.regexp_replace(F.substring(bare, 1, 10), r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2}).*$", "$1-$2-$3")
        clock = F.regexp_extract(bare, "[ T](.*)$", 1)
        clock = F.regexp_replace(clock, r"^([0-9]{2})([0-9]{2})?([0-9]{2})?(?=$|\.)", "$1:$2:$3")
        clock = F.regexp_replace(clock, r"^([0-9]{2})(:[0-9]{2})?:*(:[0-9]{2})?:*(?=$|\.)", "$1$2$3")
        clock = F.regexp_replace(clock, "^([0-9]{2})$", "$1:00")
        clock = F.regexp_replace(clock, r"(\.[0-9]{6})[0-9]*$", "$1")
        zone = F.when(offset != "", offset).otherwise(F.lit(naive_offset).cast("string"))
        naive = F.try_to_timestamp(let(clock, lambda c: F.concat_ws(" ", date, F.nullif(c, F.lit("")))))
        return let(naive, lambda t: F.when(t.isNotNull() & zone.isNotNull(), _instant(F.date_format(t, _WALL), zone)))

    return let(F.replace(strip(value), F.lit("Z"), F.lit("+00:00")), whole)


def parse_china_timestamp(value: Column) -> Column:
    return parse_iso_timestamp(value, CHINA)


def parse_rfc822(value: Column, naive_offset: str | None = None) -> Column:
    """Text like "Thu, 17 Sep 2026 08:00:00 GMT" as an instant; zone -0000 and a missing zone are naive."""
    text = F.regexp_replace(F.regexp_replace(strip(value), r"\s*\(.*\)$", ""), r"^[A-Za-z]{3,9},?\s+", "")
    pattern = r"^([0-9]{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -]([0-9]{4}|[0-9]{2})\s+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*([A-Za-z]{1,4}|[+-][0-9]{4})?$"

    def parts(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        year = F.when(F.length(part(2)) == 4, part(2)).otherwise(F.concat(F.when(part(2) > "68", "19").otherwise("20"), part(2)))
        clock = F.when(F.length(part(3)) > 5, part(3)).otherwise(F.concat(part(3), F.lit(":00")))
        naive = F.try_to_timestamp(F.concat_ws(" ", part(0), F.initcap(part(1)), year, clock), F.lit("d MMM yyyy H:mm:ss"))
        name, unnamed = F.upper(part(4)), F.lit(naive_offset).cast("string")
        zone = F.when(name.isin("", "-0000"), unnamed).when(name.rlike("^[+-]"), name).otherwise(F.coalesce(_map(ZONES)[name], unnamed))
        return let(naive, lambda t: let(zone, lambda z: F.when(t.isNotNull() & z.isNotNull(), _instant(F.date_format(t, _WALL), z))))

    def whole(text: Column) -> Column:
        return F.when(text.rlike(pattern), let(F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, 6))), parts))

    return let(text, whole)


def parse_timestamp(value: Column, naive_offset: str | None = None) -> Column:
    """Text of a Unix number, an ISO 8601 or an RFC 822 time as an instant, tried in that order."""

    def one(text: Column) -> Column:
        dated = F.coalesce(parse_iso_timestamp(text, naive_offset), parse_rfc822(text, naive_offset))
        return F.when(text.rlike(_NUMBER), let(text.try_cast("double"), from_unix)).otherwise(dated)

    return let(strip(value.cast("string")), one)


def _shift(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000)


def parse_relative_time(label: Column, observed_at: Column) -> Column:
    """Labels like 刚刚, 3分钟前 and 昨天 12:05, anchored at the response's time; null for others."""
    text = strip(label)
    pattern = r"^([0-9]{1,9})\s*(秒鐘|分钟|分鐘|小时|小時|秒|天|日)前$"
    amount, unit = F.regexp_extract(text, pattern, 1).try_cast("long"), F.regexp_extract(text, pattern, 2)
    clock = r"^昨天\s*([0-9]{1,2}):([0-9]{2})$"
    hour, minute = F.regexp_extract(text, clock, 1).try_cast("long"), F.regexp_extract(text, clock, 2).try_cast("long")
    day = 86400
    local_day = F.floor((F.unix_micros(observed_at) / 1_000_000 + 8 * 3600) / day)
    yesterday = F.timestamp_micros((((local_day - 1) * day + hour * 3600 + minute * 60 - 8 * 3600) * 1_000_000).cast("long"))
    return (
        F.when(text.isin("刚刚", "刚才"), observed_at)
        .when(amount.isNotNull(), _shift(observed_at, -amount * _map(RELATIVE_UNITS)[unit]))
        .when((hour < 24) & (minute < 60), yesterday)
    )


def parse_compact_date(value: Column) -> Column:
    """yyyyMMddHHmmss at UTC+8, else null."""
    ok = value.rlike("^[0-9]{14}$")
    naive = F.try_to_timestamp(F.when(ok, value), F.lit("yyyyMMddHHmmss"))
    return F.when(naive.isNotNull(), _instant(F.date_format(naive, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(CHINA)))


def parse_since(text: Column, now: Column) -> Column:
    """The instant that a window like 7d, 2w, 3m, 1y or 5 (days) before now begins; null for other texts."""
    pattern = r"^([0-9]{1,7})\s*([dwmyDWMY])?$"
    bare = strip(text)
    amount = F.regexp_extract(bare, pattern, 1).try_cast("long")
    days = F.coalesce(_map(WINDOW_DAYS)[F.lower(F.regexp_extract(bare, pattern, 2))], F.lit(1))
    return F.when(amount.isNotNull(), _shift(now, -amount * days * 86400))


def calendar_window_start(days: Column, now: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """The instant of local midnight in zone, days - 1 days before the local day of now."""
    local = F.date_trunc("DAY", F.from_utc_timestamp(now, zone))
    return F.to_utc_timestamp(F.date_sub(local.cast("date"), days.cast("int") - 1).cast("timestamp"), zone)


def format_relative(ts: Column, now: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """just now, Nm ago, Nh ago, yesterday, or a date like Sep 7 in zone."""
    gone = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    day, today = F.from_utc_timestamp(ts, zone), F.from_utc_timestamp(now, zone)
    return (
        F.when(gone < 60, "just now")
        .when(gone < 3600, F.concat(F.floor(gone / 60).cast("string"), F.lit("m ago")))
        .when(gone < 86400, F.concat(F.floor(gone / 3600).cast("string"), F.lit("h ago")))
        .when(day.cast("date") == F.date_sub(today.cast("date"), 1), "yesterday")
        .otherwise(F.date_format(day, "MMM d"))
    )
