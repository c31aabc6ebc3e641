"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from headrow.llm import queries as q
from headrow.llm.alignment import Tokenizers, align_tokenizers, overlaps, terminals
from headrow.llm.imatch import Fingerprints, edited_fingerprints, fingerprints, lexicon, likeness
from headrow.llm.spelling import near_words, spelling_variants, word_counts

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def documents(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


# ---- spelling variants


def brute_near(words):
    near, by = {w: set() for w in words}, defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            if (d := w[:i] + w[i + 1 :]) in near:
                near[w].add(d)
                near[d].add(w)
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    return near


@pytest.mark.parametrize("group, block, letters, n, longest", [(1 << 14, 1 << 14, "abc", 2000, 9), (6, 50, "abé", 900, 9), (1, 1, "a", 20, 20)])
def test_near_words_equal_brute_force(spark, group, block, letters, n, longest):
    """Words of two or three letters have many neighbours, found at several positions; small limits cut every group down to single positions."""
    rnd = random.Random(n)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest))): rnd.randrange(1, 99) for _ in range(n)}
    got = {r.word: (r.near, r.best, r.best_n) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group, block).collect()}
    near = brute_near(words)
    best = {w: min(s, key=lambda x: (-words[x], x)) for w, s in near.items() if s}
    assert got == {w: (len(near[w]), b, words[b]) for w, b in best.items()}


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_spelling_query_equals_brute_force(spark, sf):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in q.op11_spelling_variants(spark, sf).collect()}
    assert got == brute_variants(documents(sf)) and any(v[0] for v in got.values())


def test_spelling_odd_rows(spark):
    """Null texts and ids, repeated rows, a very long run, ties, clashing names, chains of forms, no rows."""
    text = "ABCDEF abcdef " * 5 + "w" * 50_000 + " ÀÉÎÕÜß"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, ""), (3, "", "")], "doc_id long, text string, word string")
    assert {r.word: r.n for r in word_counts(df, least_count=3).collect()} == {"abcdef": 30, "w" * 50_000: 3, "ÀÉÎÕÜß": 3}
    chain = [("aaaaab", 1), ("aaaabb", 5), ("aaabbb", 25), ("aabbbb", 200), ("zaaaab", 0), (None, 3), ("", 4), ("aabbbb", 50), ("bbaabb", 125), ("bbaabbb", 125), ("baabb", 25)]
    rows = spark.createDataFrame([(w, n, "c") for w, n in chain], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling_variants(rows).collect()}
    assert got["aaaaab"] == ("aaaabb", "aabbbb", 1, 2) and got["aabbbb"] == (None, "aabbbb", 250, 1) and got["baabb"] == ("bbaabb", "bbaabb", 25, 1)
    assert got["zaaaab"] == ("aaaaab", "aabbbb", 0, 1) and len(got) == 8
    assert spelling_variants(word_counts(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(rows, times=1)


# ---- tokenizer alignment

ODD = ["", None, " \t\n", "a", "x y", "é à b", "same  text", "long " * 3000, "word" * 2000, "<s> ▁ a▁ b  c", "line\nline\nline", "<|endoftext|> x", "<0x41> 漢字 😀 \x00 \u0085", "日本語  x", "  lead", "trail  "]


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    made, count = {}, Counter()
    for i, t in rows:
        a, b, groups, links = [], [], [], []
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t, num_threads=1)
            bytes_ = [[bytes(back[c] for c in ta.id_to_token(x)) for x in a], [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in b]]
            if not b"".join(bytes_[0]) == (" " + t).encode() == b"".join(bytes_[1]):
                a, b, bytes_ = [], [], [[], []]
            ends = [np.cumsum(list(map(len, x))).tolist() if x else [] for x in bytes_]
            at = [0, 0]
            for end in sorted({*ends[0]} & {*ends[1]}):
                of = []
                for side in (0, 1):
                    start = at[side]
                    while at[side] < len(ends[side]) and ends[side][at[side]] <= end:
                        at[side] += 1
                    of.append(range(start, at[side]))
                groups.append(",".join(str(a[k]) for k in of[0]) + "|" + ",".join(str(b[k]) for k in of[1]))
                begins = lambda s, k: ends[s][k] - len(bytes_[s][k])
                links += [(a[x], b[y]) for x in of[0] for y in of[1] if max(begins(0, x), begins(1, y)) < min(ends[0][x], ends[1][y])]
        count.update({*links})
        made[i] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return {i: (na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), d) for i, (na, nb, ng, ls, d) in made.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common", [1 << 17, 50, 0])
def test_alignment_equals_brute_force(spark, common):
    """Whatever part of the pairs is told to all tasks."""
    rows = [*enumerate(ODD), *((100 + i, t) for i, t in documents()[:80])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    out = align_tokenizers(df, A, B, P.PATTERN, common_pairs=common)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()} == brute_alignment(rows)
    assert "text" in out.columns and out.columns.count("n_a") == 1


def test_alignment_query_repeated_rows_and_no_rows(spark):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in q.op12_tokenizer_alignment(spark, SF).collect()}
    assert got == brute_alignment(documents())
    twice = spark.createDataFrame([(1, "naïve thing"), (1, "naïve thing"), (None, "naïve")], "doc_id long, text string")
    rows = align_tokenizers(twice, A, B, keep=["doc_id"]).collect()
    one = brute_alignment([(0, "naïve thing"), (1, "naïve thing"), (2, "naïve")])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(one.values())
    assert align_tokenizers(twice.limit(0), A, B).count() == 0


def test_pieces_cut_every_character_as_the_library_does():
    tok = Tokenizers(A, B, P.PATTERN)
    pieces = tok.memories()[0]
    texts = [f" a{c}{c}1 {c}b 2{c} {c} '{c}" for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000, 7)])]
    for i in range(0, len(texts), 10_000):
        part = texts[i : i + 10_000]
        want = [np.array(e.ids, "<u4").tobytes() for e in tok.a.encode_batch_fast(part, add_special_tokens=False)]
        assert pieces.packed([tok.a_split(t) for t in part]) == want


def test_terminals_and_overlaps_of_random_cuts():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randrange(1, 60)
        a, b = (np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randrange(1, n + 1))})) for _ in "ab")
        common = np.array(sorted({*a.tolist()} & {*b.tolist()}))
        x, y = terminals(a, b)
        assert x.tolist() == common[np.searchsorted(common, a)].tolist() and y.tolist() == common[np.searchsorted(common, b)].tolist()
        starts = [[0, *e[:-1].tolist()] for e in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])]
        assert list(zip(*(v.tolist() for v in overlaps(a, b)))) == want


# ---- fingerprints


def plain_terms(text):
    return {t.lower() for t in re.findall(r"[^\W_]+", text)}


def test_lexicon_equals_plain_counts(spark):
    rows = [t or "" for _, t in documents()]
    n = Counter(t for x in rows for t in plain_terms(x))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert {*lexicon(df, least_idf=1.0, most_idf=4.0)} == {t for t, k in n.items() if len(rows) * np.exp(-4) <= k <= len(rows) * np.exp(-1)}


def test_fingerprint_query(spark):
    """Edits, equal texts, and the likeness of edited and of other texts."""
    rows = [(i, t or "") for i, t in documents()]
    got = {r.doc_id: r for r in q.op13_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    by = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after, r, end = rows[(k + 1) % len(rows)][1], got[i], len(t) - len(t) // 4
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[:end] + after[: len(t) // 4]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (t != after or r.near_next == 1)
        by[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({f for x in by.values() for f in x}) == len(by)
    near, other = np.array([[r.near_edited, r.near_next] for r in got.values()]).T
    assert np.median(near) > 0.45 and np.mean(near > 0.2) > 0.9 and np.mean(other < 0.1) > 0.95


def test_likeness_follows_shared_terms():
    """Against the share of common terms: the slots are subsets of one or two terms."""
    rnd = np.random.default_rng(3)
    for size in (40, 400, 4000):
        whole = rnd.integers(0, 1 << 63, 2 * size, np.uint64).tolist()
        lists = [sorted(whole[: size])] + [sorted(whole[k : size + k]) for k in (0, size // 20, size // 4, size)]
        f = Fingerprints(lists)
        got = likeness(f, f, np.zeros(5, int), np.arange(5))
        assert got[0] == got[1] == 1 and got[2] > 0.7 and 0.2 < got[3] < 0.8 and got[4] < 0.1, got


def test_fingerprints_odd_rows(spark):
    """Null and empty texts, no terms, null and repeated ids, one row, no rows, clashing names, very long texts, more ranges than rows."""
    texts = [None, "", "?!", "?!", "a b", "long words " * 20_000, "x" * 100_000, "A B"]
    df = spark.createDataFrame([([None, 1, 2, 2, 3, None, 5, 6][i], t, "c", i) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, c0 int")
    known = lexicon(df)
    rows = {r.c0: r for r in edited_fingerprints(df, known).collect()}
    assert len(rows) == 8 and rows[2].fingerprint == rows[3].fingerprint != rows[1].fingerprint == rows[0].fingerprint and rows[4].fingerprint == rows[7].fingerprint
    assert rows[2].near_next == 1.0 == rows[3].near_edited and rows[7].n_chars == 3 and rows[5].n_chars == 220_000
    order = [1, 2, 3, 4, 6, 7]  # then the null ids, by a hash of their texts
    for a, b in zip(order, order[1:]):
        t, k = texts[a], len(texts[a]) // 4
        assert rows[a].edited_sha256 == hashlib.sha256((t[: len(t) - k] + texts[b][:k]).encode()).hexdigest()
    same = {r.c0: r.fingerprint for r in fingerprints(df, known).collect()}
    assert same == {k: r.fingerprint for k, r in rows.items()}
    one = edited_fingerprints(df.where("c0 = 4"), known).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b").hexdigest() and one.near_next == 1.0
    assert edited_fingerprints(df.limit(0), lexicon(df.limit(0))).count() == 0
