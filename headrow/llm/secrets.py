"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headrow.llm.batches import map_text, slices, texts_of

KINDS = ("assign", "access", "hex", "random")
# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more; a longer run always begins at its first AKIA
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LEAST = 16
_ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_N = len(_ALPHABET)
_CODE = {c: i for i, c in enumerate(_ALPHABET)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _secret_part(text: str, span: tuple[int, int, str]) -> str:
    return _ASSIGN.match(text, span[0])[2] if span[2] == "assign" else text[span[0] : span[1]]


def _outside(start: int, end: int, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of start to end of 16 or more characters that no span touches; spans are sorted by start."""
    for a, b, _ in spans:
        if a >= end:
            break
        if a - start >= _LEAST:
            yield start, a
        start = max(start, b)
    if end - start >= _LEAST:
        yield start, end


def _pairs(s: str) -> list[tuple[int, int]]:
    codes = [_CODE[c] for c in s if c in _CODE]
    return list(zip([_N, *codes], codes))


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of this partition's labelled strings: one row for each seen (label, from, to)."""
    from collections import Counter

    held: Counter = Counter()
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            for text in texts_of(batch.column("text")):
                spans = base_spans(text)
                inside = [(a, b) for a, b, _ in spans]
                for s in spans:
                    held.update((1, a, b) for a, b in _pairs(_secret_part(text, s)))
                for m in _ORDINARY.finditer(text):
                    if not any(a < m.end() and m.start() < b for a, b in inside):
                        held.update((0, a, b) for a, b in _pairs(m[0]))
                        held.update((0, a, b) for a, b in _pairs(m[0].upper()))  # as names of constants have it
    rows = list(held.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(3)] + [pa.array([n for _, n in rows], pa.int64())], names=["label", "a", "b", "n"]
    )


def _shapes(seed: int, each: int) -> Iterator[tuple[int, str]]:
    """Labelled strings of known kinds, each of them each times: random ones (1) of the usual alphabets, and ordinary ones (0) that look like none of a language's words."""
    rnd = random.Random(seed)
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    pick = lambda letters, n: "".join(rnd.choices(letters, k=n))
    number = lambda *sizes: pick(digits, rnd.choice(sizes))
    date = lambda mark: mark.join([f"{rnd.randrange(1990, 2040)}", f"{rnd.randrange(1, 13):02}", f"{rnd.randrange(1, 29):02}"])
    clock = lambda mark: mark.join(f"{rnd.randrange(n):02}" for n in (24, 60, 60))
    word = lambda: rnd.choice(["commit", "release", "build", "version", "report", "backup", "invoice", "image", "order", "final", "draft", "page", "abc", "test"])
    for _ in range(each):
        for letters in (lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", upper + "234567", lower + upper, lower + digits, "0123456789ABCDEF", upper + digits):
            yield 1, pick(letters, rnd.randrange(16, 48))
        yield 1, pick(lower + upper + digits + "+/", rnd.randrange(20, 44)) + "=" * rnd.randrange(3)
        yield 0, number(6, 8, 10, 12, 16, 20, 24)
        yield 0, "-".join(number(2, 3, 4, 5) for _ in range(rnd.randrange(3, 7)))
        yield 0, f"+{number(1, 2, 3)}-{number(2, 3, 4)}-{number(6, 7, 8)}-{number(1, 2, 3)}"
        yield 0, f"{rnd.choice(['ISBN', 'ISSN', 'DOI', 'RFC', 'ISO', 'CVE', 'EAN'])}-{number(3, 4)}-{number(1, 2, 3)}-{number(5, 6)}-{number(1, 2)}"
        yield 0, date(rnd.choice(["-", "", "/", "_"])) + rnd.choice(["", "T", "-", "_", "T"]) + rnd.choice(["", clock("-"), clock(""), clock("-")])
        yield 0, f"v{rnd.randrange(30)}-{rnd.randrange(30)}-{rnd.randrange(30)}-{rnd.choice(['rc', 'beta', 'alpha', 'b', 'x86_64', 'linux', 'amd64'])}{rnd.randrange(10)}"
        yield 0, rnd.choice("_-").join([word(), date(""), word()])
        yield 0, rnd.choice("_-").join([word(), number(3, 4, 8), word(), number(2, 4)])
        yield 0, rnd.choice("-=_+/") * rnd.randrange(16, 80)
        yield 0, "".join(rnd.choices("-=_+/", k=2)) * rnd.randrange(8, 40)
        yield 0, rnd.choice(lower + upper + digits) * rnd.randrange(16, 40)


def train_markov(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4096, seed: int = 7, backoff: float = 8.0, shapes: int = 400
) -> list[list[float]]:
    """Log-likelihood ratios of character transitions, random strings against ordinary ones.

    The labelled sample: in at most sample_rows rows, those with the smallest seeded hash of id_col, what the base
    patterns mark is a random string and the other runs of token characters (words, names, numbers), as they are and in capitals, are ordinary; repeated rows count each. To them come strings of known
    kinds, shapes of each: random ones of the usual alphabets, and numbers, dates, versions, commit names and rules of one character as ordinary ones. A transition's
    probability backs off, with a weight of backoff counts, to that of its second character alone, which starts from one count; without
    rows and shapes the ratios are zero. Other columns are left alone. At most 2 * 69 * 68 counts reach the driver.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    cut = df.select(key.alias("k")).orderBy("k").limit(sample_rows).agg(F.max("k")).first()[0]
    rows = df.where(key <= F.lit(cut if cut is not None else 0)).select(F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_training_counts, "label int, a int, b int, n long")
    count = [[[0] * _N for _ in range(_N + 1)] for _ in range(2)]
    for r in made.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        count[r.label][r.a][r.b] += r.n
    for label, string in _shapes(seed, shapes):
        for a, b in _pairs(string):
            count[label][a][b] += 1

    def probabilities(m: list[list[int]]) -> list[list[float]]:
        seen = [1 + sum(row[b] for row in m) for b in range(_N)]
        alone = [x / sum(seen) for x in seen]
        return [[(n + backoff * alone[b]) / (sum(row) + backoff) for b, n in enumerate(row)] for row in m]

    ordinary, random_ = map(probabilities, count)
    return [[math.log(random_[a][b] / ordinary[a][b]) for b in range(_N)] for a in range(_N + 1)]


def scan_secrets(
    df: DataFrame,
    ratios: list[list[float]],
    text_col: str = "text",
    keep: list[str] | None = None,
    least_ratio: float = 2.0,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Add spans (array of start, end, kind in code points; end exclusive) for every row.

    Base patterns give the kinds assign, access and hex. Of each run of token characters, what stands outside the base
    spans is a candidate where it has 16 or more; one whose mean log-likelihood ratio per transition reaches least_ratio,
    times sqrt(20 / length) under 20 characters, is a span of kind random. Whole texts are scanned. A null or empty text has no spans; repeated rows are each scanned; an input column named spans is
    replaced; an empty table gives an empty one.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def make():
        def spans_of(text):
            found = base_spans(text)
            more = []
            for m in _CANDIDATE.finditer(text):
                for a, b in _outside(*m.span(), found):
                    pairs = _pairs(text[a:b])
                    bar = least_ratio * max(1.0, math.sqrt(20 / len(pairs)))
                    if sum(ratios[x][y] for x, y in pairs) / len(pairs) >= bar:
                        more.append((a, b, "random"))
            return sorted(found + more, key=lambda s: (s[0], KINDS.index(s[2])))

        def work(texts):
            return {"spans": pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t)] for t in texts], pa.list_(kind))}

        return work

    return map_text(df, text_col, make, "spans array<struct<start:bigint,end:bigint,kind:string>>", batch_bytes, keep)


def span_digests(df: DataFrame) -> DataFrame:
    """Replace spans by n_assign, n_access, n_hex, base_sha256 and spans as text (kind:start:end, comma-joined)."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    rest = [c for c in df.columns if c not in ("spans", "n_assign", "n_access", "n_hex", "base_sha256")]
    return df.select(*rest, n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
