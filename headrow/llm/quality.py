"""Quality rules: base counts per text and Jensen-Shannon distances to language references."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from headrow.llm.batches import free_name, map_text, slices, texts_of
from headrow.plans.lineage import cut

_SYMBOLS = b"#*$%&|<>"  # fixed values: the symbols that are counted
# The first UTF-8 bytes of the blocks of Unicode, from the one named up to the next.
_BLOCKS = {
    "signs": 0xC2, "latin": 0xC3, "phonetic": 0xCA, "greek": 0xCE, "cyrillic": 0xD0, "armenian": 0xD4, "hebrew": 0xD6, "arabic": 0xD8, "syriac": 0xDC, "indic": 0xE0,
    "georgian": 0xE1, "dashes": 0xE2, "kana": 0xE3, "han": 0xE4, "hangul": 0xEA, "forms": 0xEE, "supplementary": 0xF0,
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "control", *_BLOCKS)


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes get the extra last class, which isn't counted.

    A character outside ASCII has the class of its first byte, so its script, or nearly, counts.
    """
    out = np.full(256, len(CLASSES))
    for name, b in _BLOCKS.items():
        out[b:] = CLASSES.index(name)
    for b in range(128):
        c = chr(b)
        name = (
            "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if b in b" \t\n\v\f\r"
            else "symbol" if b in _SYMBOLS else "punctuation" if 33 <= b <= 126 else "control"
        )
        out[b] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)
    return out


_CLASS_OF = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    """Code points of each character class."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(_CLASS_OF, weights=seen, minlength=len(CLASSES) + 1)[:-1]


def base_counts(raw: bytes, words: list[bytes], window: int = 5) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of one UTF-8 text, whose words are given."""
    chars = sum(len(w) for w in words)
    if not raw.isascii():
        joined = np.frombuffer(b"".join(words), np.uint8)
        chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    symbols = sum(raw.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS)))
    dup_lines = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\v\f")]
        dup_lines = len(lines) - len(set(lines))
    repeat = 0
    n = len(words)
    if n > window:
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        ids = code[: n - 1] * len(number) + code[1:]  # pairs, exactly; then pairs of numbered pairs
        for step in range(2, window):
            _, ids = np.unique(ids, return_inverse=True)
            ids = ids[: n - step].astype(np.int64) * len(number) + code[step:]
        _, back, times = np.unique(ids, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            edge[:-window] += twice
            edge[window:] -= twice
            repeat = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return chars, symbols, dup_lines, repeat


def _distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 where one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def _histograms(batches: Iterator[pa.RecordBatch], held_words: int = 50_000, held_bytes: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Partial counts of character classes and words by language; what is held is passed on when it grows large."""
    words: defaultdict[str | None, Counter] = defaultdict(Counter)
    others: defaultdict[str | None, Counter] = defaultdict(Counter)
    read = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for held, kind_of in ((words, lambda k: "word"), (others, lambda k: "class" if k else "total")):
            for lang, counts in held.items():
                keys, n = pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())
                kinds = pa.array(map(kind_of, counts), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), kinds, keys, n], names=["lang", "kind", "key", "n"])
            held.clear()

    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            texts = [t.encode() for t in texts_of(batch.column("text"))]
            by_lang: defaultdict[str | None, list[bytes]] = defaultdict(list)
            for t, lang in zip(texts, batch.column("lang").to_pylist()):
                by_lang[lang].append(t)
            for lang, found in by_lang.items():
                raw = b"\n".join(found)
                read += len(raw)
                for name, n in zip(CLASSES, class_counts(raw)):
                    others[lang][name.encode()] += int(n)
                found = raw.lower().split()
                others[lang][b""] += len(found)
                words[lang].update(found)
            if read > held_bytes or sum(map(len, words.values())) + 9 * len(others) > held_words:
                yield from flush()
                read = 0
    yield from flush()


class References(dict):
    """{lang: {"classes": [...], "words": {word: n}, "total": n}}, and None for all rows; rest has the other languages.

    rest is None, or a DataFrame of one row a language: lang, ref (classes, words, counts, total).
    """

    rest: DataFrame | None = None


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 100, languages: int = 64) -> References:
    """Histograms over all rows by language, and over all rows.

    Common words are the most frequent `common` ones, lower-cased in A-Z. Every language has a reference of its own:
    those of the `languages` most frequent ones and of all rows reach the driver, at most (languages + 1) * (common + 9)
    counts; those of the others stay a table of one row a language, rest. Rows of null language count in all rows only.
    An empty table gives {} without rest.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    made = rows.mapInArrow(_histograms, "lang string, kind string, key string, n long")
    sums = made.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # "*" is all rows; a language's own name stands behind "="
    both = sums.select(F.explode(F.array_compact(F.array(F.concat(F.lit("="), "lang"), F.lit("*")))).alias("ref"), "kind", "key", "n")
    both = both.groupBy("ref", "kind", "key").agg(F.sum("n").alias("n"))
    # two steps, so that no language's words meet in one task
    part = Window.partitionBy("ref", "kind", F.pmod(F.hash("key"), F.lit(64))).orderBy(F.desc("n"), "key")
    most = Window.partitionBy("ref", "kind").orderBy(F.desc("n"), "key")
    top = both.withColumn("r", F.row_number().over(part)).where(f"r <= {common} or kind <> 'word'")
    top = top.withColumn("r", F.row_number().over(most)).where(f"r <= {common} or kind <> 'word'")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("r", "key", "n"))))
    total = F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("total")
    one = top.groupBy("ref").agg(of("class").alias("c"), of("word").alias("w"), total)
    held = cut(one.select("ref", F.map_from_arrays("c.key", "c.n").alias("classes"), F.col("w.key").alias("words"), F.col("w.n").alias("counts"), "total"))
    first = held.orderBy(F.col("ref") != "*", F.desc("total"), "ref").limit(languages + 2).collect()
    out = References()
    for r in first[: languages + 1]:
        out[None if r.ref == "*" else r.ref[1:]] = {"classes": [r.classes[c] for c in CLASSES], "words": dict(zip(r.words, r.counts)), "total": r.total}
    if len(first) > languages + 1:
        classes = F.array(*(F.col("classes")[c] for c in CLASSES)).alias("classes")
        rest = held.where(~F.col("ref").isin("*", *("=" + k for k in out if k is not None)))
        out.rest = rest.select(F.substr("ref", F.lit(2)).alias("lang"), F.struct(classes, "words", "counts", "total").alias("ref"))
    return out


def quality_rules(
    df: DataFrame,
    references: dict[str | None, dict],
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    least_words: int = 10,
    most_repeated: int = 20,
    guard_words: int = 50,
    class_limit: float = 0.32,
    word_limit: float = 0.55,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed and kept.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: fewer than least_words words, or more than most_repeated percent of
    them in 5-word windows that occur twice or more. The method: Jensen-Shannon distance of the text's character-class
    histogram, and of its common-word histogram (with the rest as one more bin), to the reference of its language.
    A text of at least guard_words words over class_limit or word_limit fails; shorter ones are left to the base
    rules, their distances are null. kept is false if base_failed or the method fails. A null or empty text has no words and fails;
    a null or unknown language is compared with all rows; languages in references.rest are joined with their documents; without references the distances are 0. Repeated rows are each judged;
    columns named like a new one are replaced; an empty table gives an empty one.
    """
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"
    lang, ref, glue = (free_name(n, df.columns) for n in ("__lang", "__ref", "__both"))
    kept = [c for c in (df.columns if keep is None else keep)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.withColumn(lang, F.col(lang_col).cast("string"))
    rest = getattr(references, "rest", None)

    def make():
        def built(classes, words, counts, total):
            index = {w.encode(): i for i, w in enumerate(words)}
            return np.array(classes, float), index, np.array([*counts, max(0, total - sum(counts))], float)

        known = {k: built(r["classes"], r["words"], list(r["words"].values()), r["total"]) for k, r in local.items()}
        default = known.get(None)

        @lru_cache(256)
        def reference(head: str):
            said = json.loads(head)
            return built(**said["ref"]) if "ref" in said else known.get(said.get("lang"), default)

        def judge(both: str):
            head, _, text = both.partition("\n")
            raw = text.encode()
            words = raw.split()
            base = base_counts(raw, words)
            ref = reference(head)
            if len(words) < guard_words or ref is None:
                return len(words), *base, *((None, None) if len(words) < guard_words else (0.0, 0.0))
            seen = Counter(map(ref[1].get, raw.lower().split()))
            other = seen.pop(None, 0)
            hist = np.zeros(len(ref[2]))
            for i, n in seen.items():
                hist[i] = n
            hist[-1] = other
            return len(words), *base, _distance(class_counts(raw), ref[0]), _distance(hist, ref[2])

        def work(texts):
            columns = zip(*map(judge, texts))
            return {k.split()[0]: pa.array(v, pa.float64() if "double" in k else pa.int64()) for k, v in zip(names.split(", "), columns)}

        return work

    new = [k.split()[0] for k in names.split(", ")]
    passed = [c for c in kept if c not in (*new, "base_failed", "kept")]
    local = dict(references)

    def judged(rows: DataFrame, head: str) -> DataFrame:
        """A JSON line before each text names its language or has its reference."""
        glued = rows.withColumn(glue, F.concat(F.to_json(F.struct(F.col(head).alias("lang" if head == lang else "ref"))), F.lit("\n"), text))
        return map_text(glued, glue, make, names, batch_bytes, passed)

    if rest is None:
        out = judged(source, lang)
    else:
        near = F.coalesce(F.col(lang).isin([k for k in local if k is not None]), F.lit(True))
        far = source.where(~near).join(rest.select(F.col("lang").alias(lang), F.col("ref").alias(ref)), lang, "left")
        out = judged(source.where(near), lang).unionByName(judged(far, ref))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)
