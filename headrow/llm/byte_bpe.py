"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headrow.llm.batches import map_text


def byte_table() -> list[str]:
    """The printable character that stands for each byte: Latin-1 characters with a glyph for themselves, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge makes token: what is left when merges of lower rank have been applied to its bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    top = ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, top) for a, b in zip(parts, parts[1:])]
        low = min(joined)
        if low >= top:
            return None
        i = joined.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe:
    """Encoder and decoder of one rank file. Callers hold the bounded memory of encoded pieces, so that it ends with their task."""

    def __init__(self, path: str, pattern: str, remember: int = 150_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tokenizers

        ranks = read_ranks(path)
        self.chars = byte_table()
        self.map = {b: ord(c) for b, c in enumerate(self.chars)}
        shown = lambda b: "".join(self.chars[x] for x in b)
        order = sorted(ranks, key=ranks.get)
        pairs = [p for t in order if len(t) > 1 and (p := last_merge(t, ranks))]
        model = tokenizers.models.BPE({shown(t): ranks[t] for t in order}, [(shown(a), shown(b)) for a, b in pairs])
        self.tok = tokenizers.Tokenizer(model)
        self.tok.pre_tokenizer = tokenizers.pre_tokenizers.Split(" ", "removed")  # no byte is shown as a space
        self.split = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(self.chars)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.tok.get_vocab().items()}
        self.lengths = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        self.lengths[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.remember = remember

    def learn(self, pieces: set[str], known: dict[str, bytes]) -> None:
        """Encode pieces that aren't known yet, byte for byte through the character table, many to an input."""
        if len(known) > self.remember:
            known.clear()
        new = [p for p in pieces if p not in known]
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        shown = [" ".join([p.encode().decode("latin-1").translate(self.map) for p in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch(shown, add_special_tokens=False)):
            ids, words = np.array(e.ids, "<u4"), np.array(e.word_ids)
            ends = np.searchsorted(words, np.arange(len(g)), "right") * 4
            packed = ids.tobytes()
            known.update(zip(g, (packed[a:b] for a, b in zip([0, *ends], ends))))

    def packed(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; known holds pieces of earlier texts."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces), known)
        return [b"".join([known[p] for p in ps]) for ps in pieces]

    def encode(self, texts: list[str], known: dict[str, bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text and, for each id, the byte offset at which its bytes start."""
        ids = [np.frombuffer(x, "<u4").tolist() for x in self.packed(texts, known)]
        return ids, [self.starts(x) for x in ids]

    def starts(self, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            out.append(at)
            at += len(self.bytes_of[i])
        return out

    def broken(self, text: str, ids: np.ndarray) -> int:
        """How many of a text's ids start inside a character."""
        if text.isascii():
            return 0
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        return int(np.count_nonzero((raw[ends[:-1]] & 0xC0) == 0x80))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids; characters split over several ids come together here, ids unknown to the vocabulary raise KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_bytes_bpe(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, batch_bytes: int = 1 << 20
) -> DataFrame:
    """Add ids (array of int) and starts (byte offset of each id in the UTF-8 text) for every row.

    Each match of pattern is encoded separately, by ranks, without special tokens. A null or empty text has empty
    arrays; whole texts of any length are encoded; repeated rows are encoded each; columns named ids or starts are replaced; an empty table gives
    an empty one.
    """

    def make():
        codec, known = _codec(ranks_path, pattern), {}

        def work(texts):
            ids, starts = codec.encode(texts, known)
            return {"ids": pa.array(ids, pa.list_(pa.int32())), "starts": pa.array(starts, pa.list_(pa.int64()))}

        return work

    return map_text(df, text_col, make, "ids array<int>, starts array<bigint>", batch_bytes, keep)


def decode_bytes_bpe(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded (binary: the bytes of ids) and decoded_text (its UTF-8 text; bytes that are no whole character become U+FFFD).

    Null ids give null in both, no ids give empty ones; ids outside the vocabulary fail the task. Repeated rows are decoded each; columns
    named decoded or decoded_text are replaced; an empty table gives an empty one.
    """
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    kept = [c for c in (df.columns if keep is None else keep) if c not in ("decoded", "decoded_text")]
    names = list(dict.fromkeys([*kept, ids_col]))
    source = df.select(*names)
    out = StructType([*(source.schema[c] for c in kept), StructField("decoded", BinaryType()), StructField("decoded_text", StringType())])

    def run(batches):
        for batch in batches:
            codec = _codec(ranks_path, pattern)
            raw = [None if x is None else codec.decode(x) for x in batch.column(ids_col).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=[*kept, "decoded", "decoded_text"]
            )

    return source.mapInArrow(run, out)


def round_trip_digests(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, batch_bytes: int = 1 << 20
) -> DataFrame:
    """Add n_tokens, n_split (tokens that start inside a character, by their offsets), ids_sha256 (ids as little-endian unsigned 32-bit) and
    decoded_sha256 (the decoded bytes) for every row.

    Encoding and decoding happen in the same task, so neither ids nor bytes leave it. Null counts as empty; whole texts of any length are
    encoded; repeated rows are encoded each; columns named like a new one are replaced; an empty table gives an empty one.
    """

    def make():
        codec, known = _codec(ranks_path, pattern), {}
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(texts):
            packed = codec.packed(texts, known)
            return {
                "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                "n_split": pa.array([codec.broken(t, np.frombuffer(x, "<u4")) for t, x in zip(texts, packed)], pa.int64()),
                "ids_sha256": pa.array([sha(x) for x in packed], pa.string()),
                "decoded_sha256": pa.array([sha(codec.decode(np.frombuffer(x, "<u4").tolist())) for x in packed], pa.string()),
            }

        return work

    return map_text(df, text_col, make, "n_tokens long, n_split long, ids_sha256 string, decoded_sha256 string", batch_bytes, keep)
