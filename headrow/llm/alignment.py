"""Cross-tokenizer alignment: groups of two tokenizers' tokens by pointer jumping, and how many documents link each pair of ids."""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from headrow.llm.batches import free_name, map_text
from headrow.llm.byte_bpe import byte_table
from headrow.llm.token_counts import LONE_SPACE, lone_space_is_safe
from headrow.plans.lineage import cut


class Pieces:
    """Ids of pieces of texts, each encoded once while it is remembered, as packed unsigned 32-bit integers; b"" where the tokens' bytes aren't the piece's."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: list[bytes], before: bytes = b"", remember: int = 300_000):
        self.encode, self.bytes_of, self.before, self.remember, self.known = encode, bytes_of, before, remember, {}

    def packed(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut in pieces; b"" for a text with a piece that its tokens don't give back."""
        if len(self.known) > self.remember:
            self.known.clear()
        new = [p for p in set().union(*texts) if p not in self.known]
        for p, ids in zip(new, self.encode(new)):
            whole = b"".join(map(self.bytes_of.__getitem__, ids)) == self.before + p.encode()
            self.known[p] = struct.pack(f"<{len(ids)}I", *ids) if whole else b""
        found = [[self.known[p] for p in ps] for ps in texts]
        return [b"".join(x) if all(x) else b"" for x in found]


class Tokenizers:
    """Ids and bytes of a byte-level tokenizers .json file (A) and a sentencepiece .model file (B)."""

    def __init__(self, a_path: str, b_path: str, a_pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_padding()
        self.a.no_truncation()
        back = {c: b for b, c in enumerate(byte_table())}
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_split = regex.compile(a_pattern).findall if a_pattern else lambda t: [t]
        self.b_split = LONE_SPACE.split if lone_space_is_safe(self.b) else lambda t: [t]
        self.said = [f"{i}{s}".encode() for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(x)) for s in ends]

    def memories(self) -> tuple[Pieces, Pieces]:
        a = lambda pieces: [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        return Pieces(a, self.a_bytes), Pieces(lambda pieces: self.b.encode(pieces, num_threads=1), self.b_bytes, b" ")


@functools.lru_cache(maxsize=1)
def _tokenizers(a_path: str, b_path: str, a_pattern: str | None) -> Tokenizers:
    return Tokenizers(a_path, b_path, a_pattern)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, the end of its group. Ends ascend and both sides cover the same bytes, so that the last ends agree.

    A token points to the token of the other side that overlaps it farthest to the right, if that ends behind it, else to itself. Pointers are
    doubled until none moves: then each token points to the last one of its group, whose end is an end on both sides.
    """
    n = len(a_ends)
    ends = np.concatenate([a_ends, b_ends])
    to_b = n + np.searchsorted(b_ends, a_ends)  # the token that holds the last byte
    to_a = np.searchsorted(a_ends, b_ends)
    next_ = np.concatenate([to_b, to_a])
    next_ = np.where(ends[next_] > ends, next_, np.arange(len(ends)))
    while True:
        further = next_[next_]
        if np.array_equal(further, next_):
            return ends[next_[:n]], ends[next_[n:]]
        next_ = further


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of an A token and a B token whose byte ranges overlap."""
    a_starts = np.concatenate([[0], a_ends[:-1]]) if len(a_ends) else a_ends
    first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_ends, a_ends)
    n = last - first + 1
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _aligned(tok: Tokenizers, memories: tuple[Pieces, Pieces], texts: list[str]) -> dict[str, pa.Array]:
    """What align_tokenizers() has of each text by itself, with its distinct pairs of ids (a * size of B's vocabulary + b) and how often it links each."""
    a = memories[0].packed([tok.a_split(" " + t) if t else [] for t in texts])
    b = memories[1].packed([tok.b_split(t) if t else [] for t in texts])
    a, b = [x if y else b"" for x, y in zip(a, b)], [y if x else b"" for x, y in zip(a, b)]
    a_ids, b_ids = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
    n_a, n_b = (np.array(list(map(len, x)), np.int64) // 4 for x in (a, b))
    a_ends, b_ends = np.cumsum(tok.a_sizes[a_ids]), np.cumsum(tok.b_sizes[b_ids])  # one line of bytes for all texts: a group never goes over a text's end
    a_last, b_last = terminals(a_ends, b_ends)
    a_doc, b_doc = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    n_groups = np.bincount(a_doc[a_ends == a_last], minlength=len(texts))

    # the digest's text: tokens by group, side and place, each with what stands behind it
    code_a = a_ids * 2 + (a_ends == a_last)
    code_b = b_ids * 2 + (b_ends == b_last)
    order = np.argsort(np.concatenate([a_last * 2, b_last * 2 + 1]), kind="stable")
    code = np.concatenate([code_a, code_b + 2 * len(tok.a_bytes)])[order]
    stops = np.cumsum(n_a + n_b).tolist()
    words = list(map(tok.said.__getitem__, code.tolist()))
    digest = [hashlib.sha256(b"".join(words[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *stops], stops)]

    x, y = overlaps(a_ends, b_ends)
    n_links = np.bincount(a_doc[x], minlength=len(texts))
    span = len(tok.a_bytes) * len(tok.b_bytes)
    pairs, times = np.unique(a_doc[x] * span + a_ids[x] * len(tok.b_bytes) + b_ids[y], return_counts=True)
    at = np.searchsorted(pairs, np.arange(len(texts) + 1) * span).astype(np.int32)
    lists = lambda v: pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int64()))
    long = lambda v: pa.array(v, pa.int64())
    return {
        "n_a": long(n_a), "n_b": long(n_b), "n_groups": long(n_groups), "n_links": long(n_links), "groups_sha256": pa.array(digest, pa.string()),
        "pairs": lists(pairs % span), "times": lists(times),
    }


def _common_sums(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Replace the columns pairs and times by n_best and count_sum of the common pairs, and the rest of either."""
    for batch in batches:
        keys, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        doc = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("pairs")).to_numpy())
        at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
        known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)

        def sums(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(batch), np.int64)
            np.add.at(out, doc[known], values)
            return pa.array(out)

        sizes = np.bincount(doc[~known], minlength=len(batch))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known], pa.int64())) for x in (keys, times)]
        made = {"pairs": rest[0], "times": rest[1], "n_best": sums(times[known] * best[at[known]]), "count_sum": sums(times[known] * counts[at[known]])}
        kept = [c for c in batch.schema.names if c not in made]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.values()], names=[*kept, *made])


def align_tokenizers(
    df: DataFrame,
    a_path: str,
    b_path: str,
    a_pattern: str | None = None,
    text_col: str = "text",
    keep: list[str] | None = None,
    common_pairs: int = 1 << 17,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 for every row.

    a_path: a byte-level tokenizers .json file, which gets a space and the text; a_pattern: the regular expression by which that file cuts texts, if it is known,
    so that a piece which comes again isn't encoded again; b_path: a sentencepiece .model file that puts the space before a text itself. Special tokens aren't added, their strings in a text are ordinary text. Offsets where tokens of both sides end cut them into groups.
    n_links counts the pairs of an A and a B token whose bytes overlap. A pair of ids counts in how many rows hold it linked: count_sum is the
    sum of the counts over the links, n_best how many links have a pair whose count is the highest of its A id over all rows. groups_sha256 is of A's and B's ids
    ("a1,a2|b1;a3|b2,b3").

    A null or empty text, and one that the tokens of either side don't give back byte for byte, has zeros and an empty groups_sha256. Whole texts of any length are
    encoded; repeated rows count each; input columns named like a new one are replaced; an empty table gives an empty one.

    The texts are encoded once; ids and counts of each row's distinct pairs are written to the shared folder. The common_pairs pairs with the most rows
    go to every task (16 bytes each); the other ones meet their counts in an exchange.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    own = {c: f"c{i}" for i, c in enumerate(kept)}
    text = free_name("text", own.values())
    source = df.select(*(df[c].alias(n) for c, n in own.items()), df[text_col].cast("string").alias(text))

    def make():
        tok = _tokenizers(a_path, b_path, a_pattern)
        memories = tok.memories()
        return lambda texts: _aligned(tok, memories, texts)

    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    rows = cut(map_text(source, text, make, schema, batch_bytes, list(own.values())).withColumn("row", F.monotonically_increasing_id()))

    b_size = _vocabulary_size(b_path)
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # an A id has at most as many pairs as B has pieces
    top = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / b_size)))
    counts = cut(counts.select("pair", "n", (F.col("n") == top).cast("long").alias("best")))
    common = counts.orderBy(F.desc("n"), "pair").limit(common_pairs).toArrow().sort_by("pair")
    held = rows.sparkSession.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n", "best")))
    kinds = StructType([*(f for f in rows.schema if f.name not in ("pairs", "times")), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(LongType())), StructField("n_best", LongType()), StructField("count_sum", LongType())])
    told = cut(rows.mapInArrow(lambda batches: _common_sums(batches, *held.value), kinds))
    rest = told.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = told.drop("pairs", "times").join(rest, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), *new[:5], more("n_best", "more_best"), more("count_sum", "more_sum"))


def _vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
