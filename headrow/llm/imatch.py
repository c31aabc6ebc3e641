"""I-Match fingerprints: distinct terms of a band of document frequencies, hashed over randomised subsets of the lexicon."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from headrow.llm.batches import free_name, map_text, slices, texts_of
from headrow.llm.sharding import find_splitters, places
from headrow.plans.lineage import cut

_TERM = re.compile(r"[^\W_]+").findall
_HELD_TERMS = 200_000  # counts that a task holds before it gives them on
SLOTS = 64  # subsets a level
_FULL = 16  # slots that hold terms at the level that a fingerprint is taken at

Lexicon = dict[str, int]


def terms_of(text: str) -> set[str]:
    """Distinct terms: maximal runs of letters and digits, lower-cased."""
    return set(_TERM(text.lower()))


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term)


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many rows each term is. Whole texts are read; a null text has no terms, repeated rows count each. Counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for text in texts_of(batch.column("text")):
                    held.update(terms_of(text))
                    if len(held) > _HELD_TERMS:
                        yield given()
        yield given()

    return df.select(df[text_col].cast("string").alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text_col: str = "text", least_idf: float = math.log(10), most_idf: float = math.log(1000)) -> Lexicon:
    """Hashes of the terms whose inverse document frequency, log(rows / rows with the term), is from least_idf to most_idf.

    All rows count. There can be at most exp(most_idf) times as many such terms as a row has distinct ones on average (1,000 times, by default), however many rows
    there are, so they fit the driver and every task. An empty table gives an empty lexicon.
    """
    total = df.count()
    band = F.col("n").between(total * math.exp(-most_idf), total * math.exp(-least_idf))
    found = document_frequencies(df, text_col).where(band).select("term").toArrow().column("term").to_pylist()
    return {t: term_hash(t) for t in found}


def band_terms(terms: set[str], text: str, known: Lexicon) -> list[int]:
    """Sorted hashes of the terms in the lexicon; if there are none, of all terms; if there are none, of the text."""
    return sorted([known[t] for t in terms if t in known] or map(term_hash, terms)) or [term_hash(text)]


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of hashes, by a multiplication and shifts a seed."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


class Fingerprints:
    """Fingerprints of many term lists: of each the digest of all its terms, a level, and hashes of its terms in SLOTS subsets at that level and the one above.

    A slot's subset at level l holds each term with a chance of 1 / 2^l, and lies inside its subset at level l - 1. The level of a text is the deepest at
    which at least a quarter of its slots hold a term, so that a slot has one or two terms whatever the text's length. 0 is an empty slot.
    """

    def __init__(self, lists: list[list[int]], seed: int = 0):
        sizes = np.array(list(map(len, lists)), np.int64)
        starts = np.cumsum(sizes) - sizes
        terms = np.fromiter((t for x in lists for t in x), np.uint64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(lists)), sizes)
        self.whole = [hashlib.blake2b(terms[a : a + n].tobytes(), digest_size=8).hexdigest() for a, n in zip(starts, sizes)]
        depths = np.empty((SLOTS, len(terms)), np.int8)
        deepest = np.zeros((SLOTS, len(lists)), np.int8)
        for s in range(SLOTS if len(lists) else 0):
            x = _mixed(terms, seed * SLOTS + s + 1) | np.uint64(1 << 62)
            depths[s] = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
            deepest[s] = np.maximum.reduceat(depths[s], starts)
        self.level = np.maximum(1, np.sort(deepest, axis=0)[-_FULL])
        self.slots = np.zeros((2, len(lists), SLOTS), np.uint16)
        weights = _mixed(terms, 0)
        for up in (0, 1):
            bar = (self.level - up)[doc]
            for s in range(SLOTS):
                held = np.flatnonzero(depths[s] >= bar)
                sums = np.zeros(len(lists), np.uint64)
                np.add.at(sums, doc[held], weights[held])
                short = np.maximum(1, _mixed(sums, 0) >> np.uint64(48)).astype(np.uint16)
                short[np.bincount(doc[held], minlength=len(lists)) == 0] = 0
                self.slots[up, :, s] = short

    def said(self) -> list[str]:
        """As text: the digest, the level, and the slots of both levels in hexadecimal."""
        both = (self.slots[u].astype(">u2").tobytes().hex() for u in (0, 1))
        low, up = both
        n = SLOTS * 4
        return [f"{w}:{k}:{low[i * n : i * n + n]}:{up[i * n : i * n + n]}" for i, (w, k) in enumerate(zip(self.whole, self.level.tolist()))]


def likeness(a: Fingerprints, b: Fingerprints, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """From 0 to 1, for fingerprints at_a of a and at_b of b: 1 for equal digests; else, at a level that both have, how many of the slots that hold terms in either are equal.

    Texts whose levels differ by 2 or more (one has some four times as many terms) get 0.
    """
    gap = a.level[at_a].astype(int) - b.level[at_b]
    x, y = a.slots[(gap > 0).astype(int), at_a], b.slots[(gap < 0).astype(int), at_b]
    share = ((x == y) & (x != 0)).sum(axis=1) / np.maximum(1, ((x != 0) | (y != 0)).sum(axis=1))
    same = np.array([a.whole[i] == b.whole[j] for i, j in zip(at_a, at_b)], bool)
    return np.where(same, 1.0, np.where(np.abs(gap) < 2, share, 0.0))


def fingerprints(df: DataFrame, known: Lexicon, text_col: str = "text", keep: list[str] | None = None, seed: int = 0, batch_bytes: int = 1 << 20) -> DataFrame:
    """Add fingerprint (string, see Fingerprints) for every row. known: the lexicon().

    A text without terms of the lexicon is taken by all its terms, one without terms by itself, so that equal texts have equal fingerprints. A null
    text counts as empty; whole texts of any length are read; repeated rows have equal ones; a column named fingerprint is replaced; an empty table gives an
    empty one.
    """
    held = df.sparkSession.sparkContext.broadcast(known)

    def make():
        return lambda texts: {"fingerprint": pa.array(Fingerprints([band_terms(terms_of(t), t, held.value) for t in texts], seed).said(), pa.string())}

    return map_text(df, text_col, make, "fingerprint string", batch_bytes, keep)


def _terms_of_edited(text: str, after: str) -> tuple[str, set[str], set[str]]:
    """The edited text, the terms of the text, and of the edited one. What both begin with is read once, up to a space."""
    end = len(text) - len(text) // 4
    edited = text[:end] + after[: len(text) // 4]
    same = text.rfind(" ", 0, end) + 1
    shared = terms_of(text[:same])
    return edited, shared | terms_of(text[same:]), shared | terms_of(edited[same:])


def edited_fingerprints(
    df: DataFrame, known: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 0, batch_bytes: int = 1 << 20
) -> DataFrame:
    """Add n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    A text is edited by putting as many code points of the next row's text (or all of them) in place of its last quarter (rounded down). Rows are in the order of
    an integer id, null ids last, and of a hash of their text where ids are equal; the first comes after the last. near_edited and near_next are the likeness()
    of the row's fingerprint to the edited text's and to the next row's.

    Rows are exchanged once, to ranges of ids of nearly equal bytes that find_splitters() found; the first row of each range goes to the range before it too. A null
    text counts as empty; repeated rows stand beside each other; columns named like a new one are replaced; an empty table gives an empty one.
    """
    new = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    own = {c: f"c{i}" for i, c in enumerate(kept)}
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    k1, k2 = F.coalesce(df[id_col].cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text)
    keys = cut(df.select(k1.alias("k1"), k2.alias("k2"), (F.octet_length(text) + 64).cast("long").alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    splitters = find_splitters(keys, [total * i // parts for i in range(1, parts)], [total // (20 * parts)] * (parts - 1)) if total else []
    firsts = keys.groupBy(places(splitters).alias("part")).agg(F.min(F.struct("k1", "k2")).alias("k")).orderBy("part").collect()  # at most one for each part
    table = {r.part: (r.k.k1, r.k.k2, firsts[i - 1].part) for i, r in enumerate(firsts)}
    first1, first2, before = (F.get(F.lit([table.get(p, (None,) * 3)[i] for p in range(parts)]).cast(t), F.col("part")) for i, t in enumerate(("array<long>", "array<long>", "array<int>")))
    copy = lambda part, extra: F.struct(part.alias("part"), F.lit(extra).alias("extra"))
    copies = F.array(copy(F.col("part"), False), F.when((F.col("k1") == first1) & (F.col("k2") == first2), copy(before, True)))

    name = free_name("text", own.values())
    rows = df.select(*(df[c].alias(n) for c, n in own.items()), text.alias(name), k1.alias("k1"), k2.alias("k2")).withColumn("part", places(splitters))
    rows = rows.select(*own.values(), name, "k1", "k2", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
    rows = rows.select(*own.values(), name, "k1", "k2", "c.part", "c.extra").repartitionById(parts, F.col("part")).sortWithinPartitions("extra", "k1", "k2").select(*own.values(), name, "extra")
    held = df.sparkSession.sparkContext.broadcast(known)

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows but the last, which is the next one of the last but one. Extra rows go."""
        words, texts = held.value, texts_of(batch.column(name))
        n = len(texts) - 1
        edits = [_terms_of_edited(a, b) for a, b in zip(texts, texts[1:])]
        of = Fingerprints([band_terms(terms, t, words) for (_, terms, _), t in zip(edits, texts)] + [band_terms(terms_of(texts[n]), texts[n], words)], seed)
        edited = Fingerprints([band_terms(terms, t, words) for t, _, terms in edits], seed)
        at = np.arange(n)
        columns = [
            pa.array(list(map(len, texts[:n])), pa.int64()), pa.array([hashlib.sha256(e[0].encode()).hexdigest() for e in edits], pa.string()), pa.array(of.said()[:n], pa.string()),
            pa.array(edited.said(), pa.string()), pa.array(likeness(of, edited, at, at)), pa.array(likeness(of, of, at, at + 1)),
        ]
        out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(0, n) for c in own.values()), *columns], names=[*own.values(), *new])
        return out.filter(pa.array([not x for x in batch.column("extra").slice(0, n).to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for batch in slices(whole, name, batch_bytes):
                joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                if len(joined) > 1:
                    yield made(joined)
                last = joined.slice(len(joined) - 1)
        pa.default_memory_pool().release_unused()  # the worker lives on

    schema = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in own.items()), *(f"{c} {t}" for c, t in new.items())])
    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in own.items()), *new)
