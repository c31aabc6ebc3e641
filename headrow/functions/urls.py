"""URLs as column expressions: checks, identity, canonical form, hosts."""

from __future__ import annotations

from string import ascii_letters, ascii_lowercase, digits
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from headrow.functions.text import SPACES, let, none_if_blank, strip

# Query keys that only track, default ports, and headers that are safe to show.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
DEFAULT_PORTS = {"http": "80", "https": "443"}
SAFE_HEADERS = ("content-type", "content-length", "date", "etag", "last-modified", "cache-control", "retry-after")

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

def _class(ascii_chars: str, more: str = "") -> str:
    """A Java character class. Its ASCII characters are listed one by one: they become one table that is looked up, while ranges are tried one after another for every character."""
    return "[" + "".join(c if c.isalnum() else rf"\x{ord(c):02x}" for c in ascii_chars) + more + "]"


# What is told by one pattern each. Other URLs are taken apart.
_HIGH = r"\u00a1-\u167f\u3001-\uffff"  # no white space among these
_SHOWN = "".join(map(chr, range(0x21, 0x7F)))  # of ASCII
_but = lambda *left_out: "".join(c for c in _SHOWN if c not in left_out)
_PATH, _QUERY, _ANY = _class(_but("#", "?"), _HIGH), _class(_but("#"), _HIGH), _class(_SHOWN, _HIGH)
_USER, _TAIL = rf"(?:{_class(ascii_letters + digits + '._~:%-')}*+@)?", _class(_but(*'"<>\\^`{|}'), _HIGH)
_LOWER, _HOST = _class(ascii_lowercase + digits + ".-"), _class(ascii_letters + digits + ".-")
# Normal as they stand: lower-case http(s) host without user, port or fragment. With a query they needn't be canonical.
_BARE = rf"^https?://{_LOWER}+(?:/{_PATH}*)?"
_NORMAL, _CANONICAL = rf"{_BARE}(?:\?{_QUERY}+)?\z", rf"{_BARE}\z"
# Normal once what stands before the path is put in lower case and loses its user and a default port, and the fragment is dropped.
_USUAL = rf"^[hH][tT][tT][pP][sS]?://{_USER}{_HOST}+(?::[1-9][0-9]*)?(?:/{_PATH}*(?:\?{_QUERY}+)?(?:#{_ANY}*)?)?\z"
_SOUND = rf"^[hH][tT][tT][pP][sS]?://{_USER}{_HOST}+(?::[0-9]{{0,4}})?(?:[/?#]{_TAIL}*)?\z"
_TRACKED = rf"(?i)&(?:{'|'.join(TRACKING_KEYS)})(?:=[^&]*)?(?=&|\z)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _host_and_port(netloc: Column) -> tuple[Column, Column]:
    """Lower-cased host (IPv6 in brackets) and port text of an authority, without user information."""
    bare = F.regexp_replace(netloc, "^.*@", "")
    return F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(bare, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def normalize_url_for_identity(url: Column) -> Column:
    """Scheme and host lower-cased, default port, user information and fragment dropped; path and query as they are."""

    def named(scheme: Column, authority: Column) -> Column:
        host, port = _host_and_port(authority)
        default = F.coalesce(F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv))[scheme], F.lit(""))
        shown = lambda number: F.when((number == "") | (number == default), host).otherwise(F.concat(host, F.lit(":"), number))
        return let(F.regexp_replace(port, "^0+(?=[0-9])", ""), shown)

    def joined(parts: Column, netloc: Column) -> Column:
        scheme, path, query = (F.get(parts, F.lit(i)) for i in (0, 2, 3))
        path = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
            path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )

    def whole(text: Column) -> Column:
        parts = F.array(F.lower(_part(text, 1)), *(_part(text, i) for i in (2, 3, 4)))
        return let(parts, lambda p: let(named(F.get(p, F.lit(0)), F.get(p, F.lit(1))), lambda netloc: joined(p, netloc)))

    head = F.substring_index(url, "/", 3)
    tail = F.substring_index(F.substring(url, F.length(head) + 1, F.length(url)), "#", 1)
    bare = F.lower(F.when(head.contains("@"), F.concat(F.substring_index(head, "//", 1), F.lit("//"), F.substring_index(head, "@", -1))).otherwise(head))
    shown = bare
    for scheme, port in DEFAULT_PORTS.items():
        default = bare.startswith(f"{scheme}:") & bare.endswith(f":{port}")
        shown = F.when(default, F.substring(bare, F.lit(1), F.length(bare) - len(port) - 1)).otherwise(shown)
    return F.when(url.rlike(_NORMAL), url).when(url.rlike(_USUAL), F.concat(shown, tail)).otherwise(let(strip(url), whole))


def without_tracking(normal: Column) -> Column:
    """A URL of normalize_url_for_identity() without tracking query components; the others keep order, repeats and encoding."""

    def is_tracking(component: Column) -> Column:
        key = F.replace(F.substring_index(component, "=", 1), F.lit("+"), F.lit("%2B"))
        return F.lower(F.coalesce(F.try_url_decode(key), key)).isin(*TRACKING_KEYS)

    base = F.substring_index(normal, "?", 1)

    def decoded() -> Column:
        query = F.regexp_extract(normal, r"(?s)^[^?]*\?(.*)$", 1)
        kept = F.array_join(F.filter(F.split(query, "&"), lambda c: ~is_tracking(c)), "&")
        return let(kept, lambda k: F.when(k != "", F.concat(base, F.lit("?"), k)).otherwise(base))

    # without escapes, keys stand as they are: each component goes with the sign before it
    kept = F.regexp_replace(F.concat(F.lit("&"), F.substring(normal, F.length(base) + 2, F.length(normal))), _TRACKED, "")
    plain = let(kept, lambda k: F.when(k.isin("", "&"), base).otherwise(F.concat(base, F.lit("?"), F.substring(k, F.lit(2), F.length(k)))))
    return F.when(~normal.contains("?"), normal).when(~normal.contains("%"), plain).otherwise(decoded())


def canonicalize_url(url: Column) -> Column:
    """normalize_url_for_identity() without tracking query components."""
    return F.when(url.rlike(_CANONICAL), url).otherwise(let(normalize_url_for_identity(url), without_tracking))


def url_identity_key(url: Column) -> Column:
    return F.concat(F.lit("url:"), normalize_url_for_identity(url))


def external_key(external_id: Column, provider_id: Column) -> Column:
    """external:{provider}:{id}; null if the id is blank."""
    return F.concat(F.lit("external:"), provider_id, F.lit(":"), none_if_blank(external_id))


def identity_key(url: Column, external_id: Column, provider_id: Column) -> Column:
    """external_key() if the id isn't blank, else the URL's key."""
    return F.coalesce(external_key(external_id, provider_id), url_identity_key(url))


def is_http_url(url: Column) -> Column:
    """An absolute http(s) URL with a host, a valid port and no white space, control or reserved characters; false for null."""

    def sound(netloc: Column) -> Column:
        host, port = _host_and_port(netloc)
        bare = F.regexp_replace(netloc, "^.*@", "")
        brackets = bare.rlike(r"^\[[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\](:|$)") | ~bare.rlike(r"[\[\]]")
        valid = lambda p: (p == "") | (p.rlike("^[0-9]{1,9}$") & (F.try_to_number(p, F.lit("999999999")) <= 65535))
        return ~host.isin("", "[]") & brackets & let(port, valid)

    clean = ~url.rlike(f'[{SPACES}\\u0000-\\u001f\\u007f"<>\\\\^`{{|}}]')
    checked = clean & F.lower(_part(url, 1)).isin("http", "https") & let(_part(url, 2), sound)
    return F.when(url.rlike(_SOUND), True).otherwise(F.coalesce(checked, F.lit(False)))


def upstream_host(url: Column) -> Column:
    """Lower-cased host without brackets, '' if there is none."""
    return F.regexp_replace(_host_and_port(_part(strip(url), 2))[0], r"[\[\]]", "")


def safe_url(url: Column) -> Column:
    """Without user information, query and fragment."""
    netloc = F.regexp_replace(_part(url, 2), "^.*@", "")
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), netloc, _part(url, 3))


def safe_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(*SAFE_HEADERS))


def quote_component(c: Column) -> Column:
    """Percent-encoded UTF-8; only letters, digits and _ . - ~ stay."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_template(template: str, value: Column) -> Column:
    """template with {id} filled in; null for a null value."""
    before, _, after = template.partition("{id}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def id_from_path(url: Column, pattern: str) -> Column:
    """First group of pattern in the URL's path; null if it isn't there or blank."""
    return none_if_blank(F.regexp_extract(_part(url, 3), pattern, 1))


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base by the rules of RFC 3986; null if either is null or they can't be parsed."""

    def join(b, h):
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)
