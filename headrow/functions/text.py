"""Titles, labels and messages as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Unicode white space, as a Java character class.
SPACES = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row, however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def strip_column(c: Column) -> Column:
    """strip() of a column that mostly needs none; c is read twice."""
    return F.when(c.rlike(rf"(?s)^[^{SPACES}](?:.*[^{SPACES}])?\z"), c).otherwise(strip(c))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space, and none is left at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def _collapse_plain(c: Column) -> Column:
    """collapse() of ASCII text."""
    return F.trim(F.regexp_replace(c, r"[\x09-\x0d\x1c-\x20]+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def none_if_blank(c: Column) -> Column:
    """Stripped text, null if nothing is left. Text with other ASCII at both ends stands as it is, which is told without strip()."""
    return F.when(c.rlike(r"(?s)^[!-~](?:.*[!-~])?\z"), c).otherwise(F.nullif(strip(c), F.lit("")))


_SLICE_BYTES = 1 << 20  # of text that is held as Python strings at once


def _each(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of every text, null for null. Long texts are taken a few at a time, so a batch of them isn't held as strings."""
    sizes, made, start, held = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), [], 0, 0
    for end, size in enumerate([*sizes, _SLICE_BYTES], 1):
        held += size
        if held >= _SLICE_BYTES:
            part = texts.slice(start, end - start)
            made.append(part if part.null_count == len(part) else pa.array([None if x is None else f(x) for x in part.to_pylist()], texts.type))
            start, held = end, 0
    pa.default_memory_pool().release_unused()  # the worker lives on
    return pa.concat_arrays(made)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda x: " ".join(unicodedata.normalize("NFKC", x).split()))


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def _plain(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def normalize_title(title: Column) -> Column:
    """Compatibility-normalised (NFKC), white space collapsed; ASCII titles stay in the JVM."""
    return F.when(_plain(title), _collapse_plain(title)).otherwise(_nfkc(F.when(~_plain(title), title)))


def title_hash(title: Column) -> Column:
    return F.sha2(normalize_title(title), 256)


def with_odd_title_hash(rows: DataFrame) -> DataFrame:
    """Add odd_hash, the title_hash() of a title that isn't ASCII, else null; rows is a written table. Only rows with such titles reach Python workers."""
    plain = F.coalesce(_plain(F.col("title")), F.lit(True))
    odd = rows.where(~plain).withColumn("odd_hash", title_hash(F.col("title")))
    return rows.where(plain).withColumn("odd_hash", F.lit(None).cast("string")).unionByName(odd)


def title_hash_of(title: Column, odd_hash: Column) -> Column:
    """title_hash(), given with_odd_title_hash()."""
    return F.when(odd_hash.isNotNull(), odd_hash).otherwise(F.sha2(_collapse_plain(title), 256))


def title_cluster_key(title: Column, item_kind: Column, entity_kind: Column) -> Column:
    """title:{kind}:{entity}:{case-folded normal title}; '' for a blank title."""
    folded = F.when(_plain(title), F.lower(collapse(title))).otherwise(_folded(F.when(~_plain(title), title)))
    key = F.concat(F.lit("title:"), item_kind, F.lit(":"), F.coalesce(entity_kind, F.lit("")), F.lit(":"), folded)
    return F.when(is_blank(title), "").otherwise(key)


def ascii_fold(text: Column) -> Column:
    """text with A-Z, and no other letters, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def title_search(title: Column, query: str) -> Column:
    """title holds query literally, whatever the case of A-Z; other letters must be the same."""
    return ascii_fold(title).contains(ascii_fold(F.lit(query)))


def title_fallback(*titles: Column) -> Column:
    """The first title that isn't blank, stripped."""
    return F.coalesce(*(none_if_blank(t) for t in titles))


def headline_from_flash(content: Column) -> Column:
    """Without <b> tags; the text in leading 【 】 if there is one, else all of it."""
    bare = strip(F.regexp_replace(content, r"(?i)</?b>", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)^【([^】]*)】", 1), F.lit("")), bare)


def cut_at_quote(c: Column) -> Column:
    """What stands before the first double quote, stripped."""
    return strip(F.substring_index(c, '"', 1))


def error_message(message: Column, error_type: Column, limit: int = 2000) -> Column:
    """White space collapsed and cut to limit; the type's name if nothing is left."""
    return F.coalesce(F.nullif(F.left(collapse(message), F.lit(limit)), F.lit("")), error_type)


def error_text(error_type: Column, message: Column) -> Column:
    return F.when(F.coalesce(message, F.lit("")) == "", error_type).otherwise(F.concat(error_type, F.lit(": "), message))


def source_label(provider_name: Column, channel_label: Column) -> Column:
    return F.concat(provider_name, F.lit(" — "), channel_label)


def item_label(item_kind: Column, entity_kind: Column, item_variant: Column) -> Column:
    inner = F.when(item_kind == "entity", entity_kind).otherwise(item_variant)
    return F.when(inner.isNull(), item_kind).otherwise(F.concat(item_kind, F.lit(" ("), inner, F.lit(")")))


def duplicate_label(source_name: Column, duplicates: Column) -> Column:
    more = F.concat(source_name, F.lit(" (+"), duplicates.cast("string"), F.lit(")"))
    return F.when(duplicates == 0, source_name).otherwise(more)
