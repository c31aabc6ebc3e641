"""Registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headrow.llm.alignment import align_tokenizers
from headrow.llm.byte_bpe import round_trip_digests
from headrow.llm.exact_dedup import exact_dedup, normal_sha256
from headrow.llm.html_text import extract_html
from headrow.llm.imatch import edited_fingerprints, lexicon
from headrow.llm.mixing import mix_sources
from headrow.llm.ngram_join import ngram_jaccard_components
from headrow.llm.quality import language_references, quality_rules
from headrow.llm.secrets import scan_secrets, span_digests, train_markov
from headrow.llm.sharding import shard_rows
from headrow.llm.spelling import spelling_variants, word_counts
from headrow.llm.token_counts import token_counts
from headrow.llm.url_rules import UrlRule, filter_urls, has_host_word, mine_rules, url_path

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTE_ENTRIES = "byte_bpe_50k.json"
# The listed URL rules (host, path, verdict), in no order.
URL_RULES = [
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
]
# Words of hosts that label a URL as one to block.
BLOCK_WORDS = (
    "adult", "ads", "advert", "bet", "bets", "betting", "casino", "dating", "gambling", "lottery", "loan", "loans", "pharma", "pharmacy", "pills", "poker",
    "porn", "sex", "spam", "tracker", "viagra", "warez", "xxx",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixing_levels() -> list[Column]:
    """Domain, language and source. The tables have no domain: sources whose number leaves the same rest by 4 share one."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.try_cast("int"), F.lit(4)).cast("string")))
    return [domain, F.col("lang"), F.col("source")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null, empty and textless pages have an empty one, an empty table gives no rows."""
    return extract_html(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 3-word shingles at 90 %; texts without words link with nothing, an empty table gives no rows."""
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document by PIECES; a null text has none, repeated rows are counted each."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), limit=4096, keep=["doc_id"])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens here are words; domains are source numbers modulo 4, see mixing_levels(). The whole budget is as many tokens as there are."""
    docs = _table(spark, sf_dir, "documents")
    return mix_sources(docs, mixing_levels(), budget_fraction=1.0, alpha=0.5, max_epochs=2, keep=["doc_id", "lang", "source"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents, dropped ones too; a null text counts as empty, equal ids keep one row."""
    docs = _table(spark, sf_dir, "documents").withColumn("text_sha256", normal_sha256(F.col("text")))
    return exact_dedup(docs, keep=["doc_id", "text_sha256"])


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of the pages whose document is labelled; a URL's path has the document's number.

    A URL is to block if its document is of low quality or toxic, or its host has one of BLOCK_WORDS. In the given tables the labels of
    documents have no relation to the other parts of a URL, so rules come from the words and what stands with them.
    """
    number = F.regexp_extract(url_path(F.col("url")), "/([0-9]+)", 1).try_cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) | has_host_word(F.col("url"), BLOCK_WORDS)
    return pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", F.coalesce(bad, F.lit(False)).alias("block"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the listed rules, then of rules mined from all labelled_urls()."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine_rules(labelled_urls(pages, _table(spark, sf_dir, "labels")), "url", "block")
    return filter_urls(pages, mined, URL_RULES, keep=["page_id"])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and random spans of every whole document, by models trained on them; a null text has none."""
    docs = _table(spark, sf_dir, "documents")
    return span_digests(scan_secrets(docs, train_markov(docs), keep=["doc_id"]))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document, against references of all of them; a null text has no words and fails."""
    docs = _table(spark, sf_dir, "documents")
    judged = quality_rules(docs, language_references(docs), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes with gapless slots; a null text has 16 bytes, repeated rows have a slot each."""
    placed = shard_rows(_table(spark, sf_dir, "documents"), shards=40, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and their decoding, as digests; a null text counts as empty."""
    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of six letters or more that occur five times or more; a run in 199 has lost a letter. No texts give no words."""
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents"), drop_every=199), times=5)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of BYTE_ENTRIES and PIECES in each document; null and empty texts have zeros."""
    docs = _table(spark, sf_dir, "documents")
    return align_tokenizers(docs, public_tokenizers.path(BYTE_ENTRIES), public_tokenizers.path(PIECES), public_tokenizers.PATTERN, keep=["doc_id"])


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of each document and of its edited text, by the lexicon of all documents; a null text counts as empty."""
    docs = _table(spark, sf_dir, "documents")
    return edited_fingerprints(docs, lexicon(docs), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_ngram_jaccard_join, op3_token_counts, op4_source_mixing, op5_exact_dedup,
        op6_url_filters, op7_secret_scans, op8_quality_rules, op9_sharding, op10_byte_bpe,
        op11_spelling_variants, op12_tokenizer_alignment, op13_document_fingerprints,
    )
}

_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
  FROM words),
sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * i >= 90 * (sa.n + sb.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sizes.doc_id) AS component_id FROM sizes
"""

_OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, sha256(x) AS text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept
FROM t WINDOW w AS (PARTITION BY x)
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": _OP2_SQL, "op5_exact_dedup": _OP5_SQL}
