"""Checks of classifications, catalog fields and untyped JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from headrow.functions.text import strip

# The vocabularies of the catalog.
ITEM_KINDS = ("article", "post", "video", "entity")
ENTITY_KINDS = ("game", "movie", "product", "repository", "topic", "security")
ITEM_VARIANTS = ("flash",)
STREAM_KINDS = ("latest", "hot", "ranking", "curated")
SURFACES = ("news", "discover")
PROVIDER_KINDS = ("publisher", "platform", "community", "government", "aggregator")
CHANNEL_ROLES = ("aggregate", "section", "view")


def classification_problem(item_kind: Column, entity_kind: Column, item_variant: Column) -> Column:
    """The first broken rule of a classification, null if it is sound."""
    return (
        F.when((item_kind == "entity") & entity_kind.isNull(), "entity_kind_required")
        .when((item_kind == "entity") & ~entity_kind.isin(*ENTITY_KINDS), "unknown_entity_kind")
        .when((item_kind != "entity") & entity_kind.isNotNull(), "entity_kind_not_allowed")
        .when(item_variant.isNotNull() & ~item_variant.isin(*ITEM_VARIANTS), "unknown_item_variant")
        .when((item_variant == "flash") & (item_kind != "article"), "flash_needs_article")
    )


def classification_ok(item_kind: Column, entity_kind: Column, item_variant: Column) -> Column:
    return classification_problem(item_kind, entity_kind, item_variant).isNull()


# The formats of catalog fields. A line feed at the very end passes, as it does where $ ends a pattern.
_SLUG, _LANGUAGE, _MARKET = r"^[a-z0-9][a-z0-9-]*\n?\z", r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*\n?\z", r"^[A-Z]{2,8}\n?\z"


def valid_slug(c: Column) -> Column:
    return c.rlike(_SLUG)


def valid_topic(c: Column) -> Column:
    return valid_slug(c)


def valid_language(c: Column) -> Column:
    return c.rlike(_LANGUAGE)


def valid_market(c: Column) -> Column:
    return c.rlike(_MARKET)


_TEXT, _WHOLE, _REAL = "STRING", ("BIGINT", "INT", "SMALLINT", "TINYINT"), ("DOUBLE", "FLOAT")


def _kind(v: Column) -> Column:
    """Type name of a variant; null for an absent value or a JSON null."""
    kind = F.schema_of_variant(v)
    return F.when(kind != "VOID", kind)


def _number(v: Column) -> Column:
    kind = _kind(v)
    return kind.isin(*_WHOLE, *_REAL) | kind.startswith("DECIMAL")


def text_of(v: Column) -> Column:
    """Stripped text of a JSON string, '' for null; null for any other type."""
    kind = _kind(v)
    return F.when(kind.isNull(), "").when(kind == _TEXT, strip(F.try_variant_get(v, "$", "string")))


def scalar_text_of(v: Column) -> Column:
    """As text_of(), but numbers come as their text too; booleans, arrays and objects give null."""
    return F.coalesce(text_of(v), F.when(_number(v), F.try_variant_get(v, "$", "string")))


def optional_integer(v: Column) -> Column:
    """A JSON integer; null for anything else, booleans and strings of digits included."""
    return F.when(_kind(v).isin(*_WHOLE), F.try_variant_get(v, "$", "bigint"))


def optional_finite_number(v: Column) -> Column:
    """A finite JSON number as a double; null for anything else."""
    x = F.when(_number(v), F.try_variant_get(v, "$", "double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def encode_metrics(metrics: Column) -> Column:
    """Metrics (JSON text) if they are strict JSON with finite numbers only, '{}' for null; null for what can't be stored."""
    bare = F.regexp_replace(metrics, r'"(?:[^"\\]|\\.)*"', '""')
    reals = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)"), F.lit(0))
    finite = ~F.exists(reals, lambda x: F.abs(x.try_cast("double")) == float("inf"))
    return F.when(metrics.isNull(), "{}").when(F.try_parse_json(metrics).isNotNull() & finite, metrics)
