"""Spelling variants: words of one error from each other, found by bit-sliced position indexes over blocks of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from headrow.llm.batches import slices, texts_of
from headrow.plans.lineage import cut

_HELD_WORDS = 200_000  # counts that a task holds before it gives them on
_CHUNK = 512  # queries that go through the recurrences together


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = "A-Za-zÀ-ÿ", least_chars: int = 6, least_count: int = 5, drop_every: int = 0
) -> DataFrame:
    """(word, n): the maximal runs of letters in whole texts, with A-Z lower-cased, of least_chars code points or more, that occur least_count times or more.

    drop_every: a run loses one code point where this divides h, the crc32 of "id:run" in UTF-8; it is the one at h modulo the run's length (0: never).
    A null text has no runs, a null id counts as an empty one, repeated rows count each, an empty table gives an empty one. Counts are summed in
    each task first, for at most 200,000 words at a time.
    """
    runs = re.compile(f"[{letters}]{{{least_chars},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for doc, text in zip(batch.column("id").to_pylist(), texts_of(batch.column("text"))):
                    found = Counter(runs(text.encode().lower().decode()))  # of bytes only A-Z are lower-cased
                    if not drop_every:
                        held.update(found)
                        continue
                    begun = zlib.crc32(f"{doc or ''}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), begun)
                        if h % drop_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_chars:
                                continue
                        held[run] += n
                    if len(held) > _HELD_WORDS:
                        yield given()
        yield given()

    texts = df.select(df[id_col].cast("string").alias("id"), df[text_col].cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bits(rows: np.ndarray, entries: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bit sets of entries, one a row."""
    out = np.zeros((n_rows, width), np.uint64)
    np.bitwise_or.at(out, (rows, entries >> 6), np.uint64(1) << (entries & 63).astype(np.uint64))
    return out


class PositionIndex:
    """Bit sets over a block of word parts, one for each (position, letter), and one for each group of parts that may be near.

    Parts have s letters, or s + 1 where longer is set. Two parts are near if they stand in one group and either are of s letters and differ in one, or one of
    them is the other with a letter put in. Where the group isn't last, the letter is not behind the shorter part's end: such a pair belongs to another group.
    """

    def __init__(self, parts: list[str], longer: np.ndarray, group: np.ndarray, last: np.ndarray, s: int):
        n = len(parts)
        self.s, self.longer, self.group, self.last, self.width = s, longer, group, last, -(-n // 64)
        text = np.array([p.ljust(s + 1, "\0") for p in parts], f"<U{s + 1}") if n else np.zeros(0, "<U1")
        self.codes = text.view(np.uint32).reshape(n, s + 1)
        at = np.arange(n)
        self.groups = _bits(group, at, int(group.max(initial=-1)) + 1, self.width)
        self.long = _bits(np.zeros(int(longer.sum()), int), at[longer], 1, self.width)[0]
        self.letters, self.sets = [], []
        for p in range(s + 1):
            letters, row = np.unique(self.codes[:, p], return_inverse=True)
            self.letters.append(letters)
            self.sets.append(np.vstack([_bits(row, at, len(letters), self.width), np.zeros((1, self.width), np.uint64)]))

    def _having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter, the parts that have it at position."""
        known = self.letters[position]
        row = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return self.sets[position][np.where(known[row] == letters, row, len(known))]

    def near(self, q: np.ndarray, longer: bool) -> np.ndarray:
        """Bit sets of the parts near the parts q, which are all longer or all not.

        equal: parts whose first j letters are the query's. replaced, inserted, deleted: parts that have come to the query's letter j with that one error, with
        the query's letters at the same position, one further on, and one back.
        """
        equal, codes = self.groups[self.group[q]], self.codes[q]
        only_last = np.where(self.last[q], np.uint64(0), ~np.uint64(0))[:, None]
        if not longer:
            replaced, inserted = np.zeros_like(equal), np.zeros_like(equal)
            for j in range(self.s):
                here = self._having(j, codes[:, j])
                replaced = (replaced & here) | (equal & ~here)
                inserted = (inserted | equal) & self._having(j + 1, codes[:, j])
                equal = equal & here
            return (replaced & ~self.long) | ((inserted | equal) & ~(equal & only_last) & self.long)
        deleted = np.zeros_like(equal)
        for j in range(self.s + 1):
            deleted = (deleted & self._having(j - 1, codes[:, j]) if j else deleted) | equal
            before, equal = equal, equal & self._having(j, codes[:, j])
        return deleted & ~(before & only_last) & ~self.long

    def counts_and_first(self) -> tuple[np.ndarray, np.ndarray]:
        """For each part, how many are near it, and the first of them in the order of the block (-1 if none)."""
        n = len(self.codes)
        count, first = np.zeros(n, np.int64), np.full(n, -1)
        for longer in (False, True):
            of = np.flatnonzero(self.longer == longer)
            for q in (of[i : i + _CHUNK] for i in range(0, len(of), _CHUNK)):
                found = self.near(q, longer)
                some = np.flatnonzero(found.any(axis=1))
                found, q = found[some], q[some]
                count[q] = np.bitwise_count(found).sum(axis=1)
                word = (found != 0).argmax(axis=1)
                low = found[np.arange(len(q)), word]
                first[q] = word * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
        return count, first


def _block(table: pa.Table) -> pa.Table:
    """(word, near, best, best_n) of a block's entries that have near words in their group."""
    table = table.sort_by([("n", "descending"), ("word", "ascending")])  # so that the first near word is the best
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    spans = list(zip(*(table.column(c).to_pylist() for c in ("l", "a", "b"))))
    ends = [len(w) - max(length - b, 0) for w, (length, _, b) in zip(words, spans)]
    sizes = np.array([min(b, length) - a for length, a, b in spans])
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        keys = [(*spans[i], words[i][: spans[i][1]], words[i][ends[i] :]) for i in at]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        index = PositionIndex(
            [words[i][spans[i][1] : ends[i]] for i in at], np.array([len(words[i]) > spans[i][0] for i in at]), np.array([number[k] for k in keys]),
            np.array([spans[i][2] > spans[i][0] for i in at]), int(s),
        )
        count, first = index.counts_and_first()
        some = np.flatnonzero(count)
        got.append((at[some], count[some], at[first[some]]))
    word, count, best = (np.concatenate(x) if got else np.zeros(0, int) for x in (zip(*got) if got else [()] * 3))
    names = np.array(words, object)
    return pa.table({"word": pa.array(names[word], pa.string()), "near": pa.array(count, pa.int64()), "best": pa.array(names[best], pa.string()), "best_n": pa.array(n[best], pa.int64())})


def _halves(length: Column, a: Column, b: Column) -> Column:
    """The two parts of the positions from a up to b."""
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(length.alias("l"), a.alias("a"), middle.alias("b")), F.struct(length.alias("l"), middle.alias("a"), b.alias("b")))


def near_words(words: DataFrame, group_letters: int = 1 << 14, block_letters: int = 1 << 14) -> DataFrame:
    """(word, near, best, best_n) of (word, n) for every word that differs from others by exactly one inserted, deleted or replaced code point.

    near is how many words do; best is the one of the largest n (ties: the smallest in code-point order). words have distinct non-empty words.

    An error lies at some position of the shorter word, of length l. Positions from 0 to l (behind its end) are cut in two halves: two near words
    agree in all letters outside the half that has their error, so each word goes into the groups of its letters outside each half, as the shorter (l is its length) and as
    the longer one (l is its length - 1). A group with more than group_letters letters inside its half is cut in halves again, down to a single position, where no
    group can have more than the alphabet's letters and pairs of letters. Each pair meets in one group. Groups are dealt to blocks by hash, and
    each block is a PositionIndex; no pairs are emitted.
    """
    size = F.length("word")
    spans = F.flatten(F.transform(F.array(size, size - 1), lambda x: F.when(x > 0, _halves(x, F.lit(0), x + 1)).otherwise(F.array())))
    opened, leaves = words.select("word", "n", F.explode(spans).alias("s")).select("word", "n", "s.*"), None
    key = ["l", "a", "b", "pre", "suf"]
    while True:
        keyed = opened.select("*", F.expr("substring(word, 1, a)").alias("pre"), F.expr("right(word, l - b)").alias("suf"))
        groups = cut(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        keyed = cut(keyed.join(groups, key))
        wide = (F.col("m") * (F.col("b") - F.col("a")) > group_letters) & (F.col("b") - F.col("a") > 1)
        small = keyed.where(~wide).drop("m")
        leaves = leaves.unionByName(small) if leaves else small
        if groups.where(wide).isEmpty():
            break
        opened = keyed.where(wide).select("word", "n", F.explode(_halves(F.col("l"), F.col("a"), F.col("b"))).alias("s")).select("word", "n", "s.*")
    letters = leaves.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0] or 0
    block = F.pmod(F.xxhash64(*key), F.lit(max(1, letters // block_letters)))
    found = leaves.select("word", "n", "l", "a", "b", block.alias("block")).groupBy("block").applyInArrow(_block, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", "b.best", (-F.col("b.less")).alias("best_n"))


def spelling_variants(words: DataFrame, times: int = 5, group_letters: int = 1 << 14, block_letters: int = 1 << 14) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): which words are variants of a near word that occurs times as often or more.

    form is the near word of the largest n (ties: the smallest in code-point order) if its n reaches times the word's, else null, and form_n its n. root is
    where forms lead in the end, the word itself if it has none. n_near is how many words are near. A row of a null or empty word is left out, rows
    of one word are summed, other columns are dropped, an empty table gives an empty one. times is over 1, so that forms don't come round; they are followed by
    pointer jumping, as often as the logarithm of the longest chain, which itself grows with the logarithm of the largest n.
    """
    if times <= 1:
        raise ValueError("times has to be over 1")
    words = cut(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    near = words.join(near_words(words, group_letters, block_letters), "word", "left")
    formed = F.col("best_n") >= times * F.col("n")
    found = cut(near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots, moved = cut(found.where("form is not null").select("word", F.col("form").alias("root"))), True
    while moved:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
