"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from headrow.llm.batches import map_text

_MARK = "▁"  # stands for a space inside pieces
LONE_SPACE = re.compile(f"(?<=[^ {_MARK}]) (?=[^ {_MARK}])")


def split_safely(text: str, size: int) -> list[str]:
    """Pieces of about size characters, cut only at a lone space between two other characters (the space goes)."""
    out, start = [], 0
    while len(text) - start > size:
        found = LONE_SPACE.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.end()
    out.append(text[start:])
    return out


def lone_space_is_safe(sp) -> bool:
    """True if no piece holds a space mark behind another character, so that no merge crosses a lone space.

    The next part then starts with the mark that the model puts before every input.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return not any(_MARK in p.lstrip(_MARK) for p in pieces) and sp.encode("a b") == sp.encode("a") + sp.encode("b")


def _counter(path: str, size: int) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        cut = (lambda t: split_safely(t, size)) if lone_space_is_safe(sp) else (lambda t: [t])

        def lengths(texts: list[str]) -> list[int]:
            return [len(x) for x in sp.encode(texts, num_threads=1)]

    else:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        cut = lambda t: [t]

        def lengths(texts: list[str]) -> list[int]:
            return [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        parts, ends = [], []
        for t in texts:
            parts += cut(t)
            ends.append(len(parts))
        sizes = lengths(parts)
        return [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]

    return count


def token_counts(
    df: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    limit: int = 4096,
    keep: list[str] | None = None,
    batch_bytes: int = 1 << 20,
    split_chars: int = 256,
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    tokenizer_path: a sentencepiece .model or a tokenizers .json file that every executor can open. Whole texts are
    counted, without special tokens, truncation or padding; special strings inside texts get the library's default.
    Batches are balanced by bytes; long texts are split where no merge can cross, after a check of the vocabulary,
    and are left whole where that check fails. A null or empty text has 0 bytes and 0 tokens; repeated rows
    are counted each; columns of the input named like a new column are replaced; an empty table gives an empty one.
    """

    def make():
        count = _counter(tokenizer_path, split_chars)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            n = count(texts)
            return {
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            }

        return work

    return map_text(df, text_col, make, "n_bytes long, n_tokens long, over_limit boolean", batch_bytes, keep)
