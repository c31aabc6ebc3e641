"""URL filters: listed rules first, then association rules mined from labelled URLs. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from headrow.plans.lineage import cut

_BLOCK_ITEM = "label=block"


@dataclass(frozen=True)
class UrlRule:
    """A listed rule for a host, its subdomains and the paths below path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or no ://."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The struct (name, verdict) of the longest fitting rule, else null. The list is a parameter, not a table."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, words of the host, path words, query keys and whether it has a fragment.

    Numbers are one token whatever their digits. A null URL or one without :// has no tokens.
    """
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    number = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x)
    some = lambda a, kind: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(kind), number(x)))
    parts = F.concat(
        some(F.array(_ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), "scheme="),
        some(F.split(host, "[.-]"), "host="),
        some(F.split(path, "[/._-]"), "path="),
        some(F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1)), "key="),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def has_host_word(url: Column, words: Sequence[str]) -> Column:
    """Whether one of the words, between dots and hyphens, is in the host; false for null and for a URL without ://."""
    return F.arrays_overlap(F.split(url_host(url), "[.-]"), F.array(*map(F.lit, words))) if words else F.lit(False)


def mine_rules(labelled: DataFrame, url_col: str, block_col: str, min_support: float = 0.001, min_confidence: float = 0.7, least_sure: float = 0.5) -> DataFrame:
    """Token combinations that imply the label: (rule_id, antecedent, confidence, support), from FP-growth over all labelled rows.

    block_col is boolean; rows where it or the URL is null are left out, repeated rows count each. Rules keep at least min_support (the
    share of rows that have all tokens and are to block) and min_confidence, and the lower end of the confidence's 95 % interval (Wilson's) is at
    least least_sure, so that two or three rows by chance make no rule; a rule is pruned if a shorter one, with a subset of its tokens, is
    as confident, so one of equal confidence stays only in its shortest forms. No labels, or none that blocks, give no rules.
    """
    items = labelled.where(F.col(block_col).isNotNull() & F.col(url_col).isNotNull()).select(
        F.concat(url_tokens(F.col(url_col)), F.when(F.col(block_col), F.array(F.lit(_BLOCK_ITEM))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    items = cut(items)
    empty = "rule_id long, antecedent array<string>, confidence double, support double"
    if items.where(F.array_contains("items", _BLOCK_ITEM)).isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    held = F.col("support") * items.count() / F.col("confidence")  # rows that have all tokens
    c, z2 = F.col("confidence"), 1.96**2
    surely = (c + z2 / (2 * held) - F.sqrt(z2 * (c * (1 - c) / held + z2 / (4 * held * held)))) / (1 + z2 / held)
    rules = cut(
        found.where(F.array_contains("consequent", _BLOCK_ITEM) & (surely >= least_sure)).select(
            F.monotonically_increasing_id().alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
        )
    )
    token = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    shorter = rules.select(
        F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("less"), F.col("confidence").alias("as_sure")
    )
    beaten = token.join(shorter, "token").where(
        (F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0) & (F.col("as_sure") >= F.col("confidence"))
    )
    return cut(rules.join(beaten.select("rule_id"), "rule_id", "left_anti"))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs of which some rule has all its tokens: (url, n_rules).

    The inverted index has each rule once, under its rarest token among the URLs; a URL meets only rules whose index token it
    has, and then the other tokens are looked up in its own list. Null URLs, those without :// and those without a match have no row, repeated
    URLs have one; an empty table or no rules give an empty result.
    """
    distinct = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", url_tokens(F.col("url")).alias("tokens"))
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct()
    postings = distinct.select("url", "tokens", F.explode("tokens").alias("token"))
    df = postings.select("token").join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    each = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(df, "token")
    index = each.groupBy("rule_id", "antecedent").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    met = postings.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"))


def filter_urls(df: DataFrame, mined: DataFrame, rules: list[UrlRule], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule (name of the listed rule or null), mined_rules (how many association rules match) and verdict.

    The longest listed rule decides; other URLs are blocked if a mined rule matches, else allowed. Null URLs and those without :// have
    an empty host and path, no rule, and are allowed. Repeated rows are each judged; columns named like a new one are replaced; an empty
    table gives an empty one.
    """
    new = ("host", "path", "rule", "mined_rules", "verdict")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    rows = df.select(*(df[c].alias(f"__c{i}") for i, c in enumerate(kept)), df[url_col].alias("__url"))
    if not mined.isEmpty():
        matched = match_rules(df, mined, url_col).select(F.col("url").alias("__url"), "n_rules")
        rows = rows.join(matched, "__url", "left")
    else:
        rows = rows.withColumn("n_rules", F.lit(0).cast("long"))
    rows = rows.withColumn("host", url_host(F.col("__url"))).withColumn("path", url_path(F.col("__url")))
    rows = rows.withColumn("__rule", listed_rule(F.col("host"), F.col("path"), rules))
    count = F.coalesce("n_rules", F.lit(0))
    verdict = F.coalesce("__rule.verdict", F.when(count > 0, "block").otherwise("allow"))
    return rows.select(
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)), "host", "path", F.col("__rule.name").alias("rule"), count.alias("mined_rules"), verdict.alias("verdict")
    )
