"""Corpus pipeline: quality rules, exact dedup, n-gram near duplicates, mixing, byte-level BPE.

Every stage takes and, but for the last, returns the columns of documents, others are dropped. An empty table gives empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headrow.llm.byte_bpe import round_trip_digests
from headrow.llm.exact_dedup import exact_dedup
from headrow.llm.mixing import mix_sources
from headrow.llm.ngram_join import keep_one_per_component, ngram_jaccard_components
from headrow.llm.quality import language_references, quality_rules
from headrow.llm.queries import RANKS, mixing_levels
from headrow.plans.lineage import collecting, cut, discard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: ContextVar[list[str] | None] = ContextVar("left", default=None)  # tables of the stage before, of each thread its own


def stage(f: Stage) -> Stage:
    """A stage's own tables are deleted when the next stage begins: its result has been written and read again by then."""

    @functools.wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left.get() or [])
        own: list[str] = []
        _left.set(own)
        with collecting(own):
            return f(spark, docs, sf_dir)

    return begin


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close enough to their language's reference over these documents.

    Null and empty texts have too few words and go; a null language is compared with all rows; repeated rows are each judged.
    """
    return quality_rules(docs, language_references(docs), keep=COLUMNS).where("kept").select(*COLUMNS)


@stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest doc_id; a null text counts as empty, null ids come last.

    Exactly one row stays where rows repeat an id too.
    """
    return exact_dedup(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity of 0.8 or more): the smallest doc_id.

    Texts without words, and rows of null id, link with nothing and stay.
    """
    return keep_one_per_component(docs, ngram_jaccard_components(docs, k=5, num=80, den=100)).select(*COLUMNS)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of their domains, languages and sources; no document comes twice.

    A null language or source is a leaf of its own; texts without tokens go with the others.
    """
    return mix_sources(docs, mixing_levels(), budget_fraction=0.9, alpha=0.8, max_epochs=1, keep=COLUMNS).select(*COLUMNS)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of their decoding, beside each document's id, language and source; a null text counts as empty."""
    return round_trip_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality), ("exact dedup", dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixing), ("byte-level BPE", encode)]

ORACLE_SQL = None  # Jensen-Shannon rules, seeded hashes and BPE aren't SQL; tests/llm has the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again, and deleted when the next one's has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, step in STAGES[:-1]:
        made: list[str] = []
        result = step(spark, docs, sf_dir)
        with collecting(made):
            docs = cut(result)
        discard(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
