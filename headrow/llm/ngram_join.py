"""N-gram Jaccard join: a grouped prefix join over word shingles, exact, without all pairs of a group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from headrow.llm.batches import slices, texts_of
from headrow.llm.hot import with_counts, with_group
from headrow.operators.components import connected_components
from headrow.plans.lineage import collecting, cut, discard

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingler(k: int, remember: int = 100_000) -> Callable[[str], np.ndarray]:
    """A function from a text to its distinct k-word shingles as sorted signed 64-bit hashes.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; fewer than k words are one shingle, none give none.
    """
    import xxhash

    known: dict[bytes, int] = {}

    def shingles(text: str) -> np.ndarray:
        words = text.encode().lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.int64)
        if len(known) > remember:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        size = min(k, n)
        with np.errstate(over="ignore"):
            h = np.full(n - size + 1, size, np.uint64)
            for j in range(size):
                h = _mix((h + ids[j : n - size + 1 + j]) * _MULTIPLIER)
        return np.unique(h.view(np.int64))

    return shingles


def least_overlap(n: Column, num: int, den: int) -> Column:
    """Smallest number of shared shingles that a set of n can have with any set it links with: ceil(n * num / den)."""
    return F.floor((n * num + (den - 1)) / den)


def _sketches(df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, n, sig, ext): size of the set, its 128-bit digest, and its smallest hashes, a quarter more and 8 more than a prefix has."""
    schema = "id long, n int, sig binary, ext array<bigint>"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make = shingler(k)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [make(t) for t in texts_of(batch.column("text"))]
                size = [n + n // 4 + 8 for n in (len(s) - -(-len(s) * num // den) + 1 for s in sets)]
                ext = [s[:m] for s, m in zip(sets, size)]
                ends = np.cumsum([0, *map(len, ext)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ext, np.empty(0, np.int64)]), pa.int64())),
                    ],
                    names=["id", "n", "sig", "ext"],
                )

    return source.mapInArrow(run, schema)


def _sets(df: DataFrame, id_col: str, text_col: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, set): the whole sorted shingle sets of the documents in ids (id)."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler(k)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [make(t) for t in texts_of(batch.column("text"))]
                ends = np.cumsum([0, *map(len, sets)])
                values = pa.array(np.concatenate([*sets, np.empty(0, np.int64)]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "set"])

    return source.mapInArrow(run, "id long, set array<bigint>")


class _Join:
    """One run of the join; holds the inputs that its steps share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, light: int):
        self.df, self.id_col, self.text_col = df, id_col, text_col
        self.k, self.num, self.den, self.light = k, num, den, light

    def size_fits(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def prefixes(self, reps: DataFrame) -> DataFrame:
        """(id, n, prefix): prefixes in the order "tokens that are not frequent by hash, then frequent tokens by hash".

        A token is frequent if more than `light` sketches have it, or more than `light` whole sets of the documents
        whose sketches are so full of frequent tokens that they don't hold a prefix. The whole sets of these documents, and
        of those that come to lack a prefix by the second rule, are fetched, so the order is the same for all.
        """
        size = (F.col("n") - least_overlap(F.col("n"), self.num, self.den) + 1).cast("int")
        none = F.array().cast("array<bigint>")
        # array_except and array_intersect keep the order of the sorted sketch or set
        good = F.array_except("ext", "bad")
        enough = (F.size(good) >= size) | (F.size("ext") == F.col("n"))

        def marked(rows: DataFrame, column: str, frequent: DataFrame) -> DataFrame:
            """rows with bad: the frequent tokens of column."""
            hits = rows.select("id", F.explode(column).alias("token")).join(frequent, "token").groupBy("id").agg(F.collect_set("token").alias("bad"))
            return rows.join(hits, "id", "left").withColumn("bad", F.coalesce("bad", none))

        def often(rows: DataFrame, column: str) -> DataFrame:
            counts = rows.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
            return cut(counts.where(F.col("c") > self.light).select("token"))

        def whole_sets(rows: DataFrame) -> DataFrame:
            sets = _sets(self.df, self.id_col, self.text_col, rows.select("id").distinct(), self.k)
            return sets.join(rows.select("id", "n").distinct(), "id").where(F.size("set") == F.col("n"))

        def sketched(rows: DataFrame) -> DataFrame:
            return rows.select("id", "n", F.slice(F.concat(good, F.array_intersect("ext", "bad")), F.lit(1), size).alias("prefix"))

        spark, used = reps.sparkSession, []
        with collecting(used):
            frequent = often(reps, "ext")
            rows = cut(marked(reps, "ext", frequent))
            short = rows.where(~enough)
            out = sketched(rows)
            if not short.isEmpty():
                whole = cut(whole_sets(short))
                frequent = cut(frequent.unionByName(often(whole, "set")).distinct())
                rows = cut(marked(rows.where(enough).drop("bad"), "ext", frequent))
                late = rows.where(~enough)
                if not late.isEmpty():
                    whole = cut(whole.unionByName(whole_sets(late)))
                ordered = F.concat(F.array_except("set", "bad"), F.array_intersect("set", "bad"))
                fetched = marked(whole, "set", frequent).select("id", "n", F.slice(ordered, F.lit(1), size).alias("prefix"))
                out = sketched(rows.where(enough)).unionByName(fetched)
        out = cut(out)
        discard(spark, used)
        return out

    def screen(self, pairs: DataFrame, sketches: DataFrame, slack: bool = False) -> DataFrame:
        """Drop pairs (a, b) whose sketches alone differ in more shingles than linked sets may.

        Below the smaller of two sketches' largest hashes both sets are known completely; each hash there that only one has
        counts against the (den - num) / (den + num) of both sizes that may differ. With slack, a and b stand for groups
        where the columns ma and mb say so, whose members may differ from them by as much again.
        """
        left, right = (sketches.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("ext").alias("e" + c)) for c in "ab")
        top = F.least(F.when(F.size("ea") < F.col("na"), F.element_at("ea", -1)), F.when(F.size("eb") < F.col("nb"), F.element_at("eb", -1)))
        known = lambda c: F.size(F.filter(c, lambda x: F.col("top").isNull() | (x <= F.col("top"))))
        met = pairs.join(left, "a").join(right, "b").withColumn("top", top)
        differ = known(F.col("ea")) + known(F.col("eb")) - 2 * known(F.array_intersect("ea", "eb"))
        may = F.col("na") + F.col("nb")
        if slack:
            may = may + 2 * F.col("na") * F.col("ma").cast("int") + 2 * F.col("nb") * F.col("mb").cast("int")
        fits = self.size_fits(F.col("na"), F.col("nb")) & (differ * (self.den + self.num) <= may * (self.den - self.num))
        return met.where(fits).select("a", "b").distinct()

    def measure(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, either) of each pair, from the whole sets."""
        pairs = cut(pairs)
        if pairs.isEmpty():
            return pairs.select("a", "b", F.lit(0).alias("shared"), F.lit(1).alias("either"))
        used: list[str] = []
        with collecting(used):
            ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
            sets = cut(_sets(self.df, self.id_col, self.text_col, ids, self.k))
        left, right = (sets.select(F.col("id").alias(c), F.col("set").alias("s" + c)) for c in "ab")
        shared = F.size(F.array_intersect("sa", "sb"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("sum"))
        out = cut(met.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("either")))
        discard(pairs.sparkSession, used)
        return out

    def linked(self) -> Column:
        return F.col("shared") * self.den >= F.col("either") * self.num


def _link(j: _Join, some: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, component) of the classes' first documents that link; steps 2 to 5 of ngram_jaccard_components()."""
    num, den, light = j.num, j.den, j.light
    pre = j.prefixes(reps)

    # groups of one size and prefix
    marked = pre.withColumn("p1", F.xxhash64("prefix")).withColumn("p2", F.xxhash64(F.lit(1), "prefix"))  # 128 bits stand for a prefix
    pre = cut(with_group(marked, ["n", "p1", "p2"], "id", {"gid": F.min("id")}, {"gid": F.min("gid")}).select("id", "n", "prefix", "gid"))
    member = cut(pre.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b")).distinct())
    within = j.measure(j.screen(member, reps))
    inner = within.where(j.linked()).select("a", "b").distinct()
    stray = member.join(inner, ["a", "b"], "left_anti").select(F.col("b").alias("id"))
    heads = pre.where("id = gid").select("id", "n", "prefix").distinct().unionByName(pre.join(stray, "id", "left_semi").select("id", "n", "prefix"))

    # buckets of groups by prefix token; kind: sets of one size that may link stand in the same or in adjoining classes
    ratio = math.log(den / num) * 1.0001 if den > num else 1.0
    heads = cut(heads)
    places = heads.select("id", "n", F.posexplode("prefix").alias("pos", "token"), F.floor(F.log("n") / ratio).cast("int").alias("kind"))
    held = cut(heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    buckets = cut(with_counts(places, "token", "id", held, held.agg(F.sum("held")).first()[0] or 0))
    small, large = buckets.where(F.col("held") <= light), buckets.where(F.col("held") > light)

    def meet(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
        """Pairs (a, b) of rows of two buckets that may link; extra says which rows of a token meet."""
        x, y = left.alias("x"), right.alias("y")
        # what two sets can share, if this token is the first that they share
        rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        able = rest * (den + num) >= (F.col("x.n") + F.col("y.n")) * num
        on = (F.col("x.token") == F.col("y.token")) & j.size_fits(F.col("x.n"), F.col("y.n")) & able & extra
        return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    near = cut(meet(small, small, F.col("x.id") < F.col("y.id")))
    hubs = large.groupBy("token").agg(*(F.min_by(F.struct("id", "n", "pos"), F.struct(F.col("pos"), F.xxhash64(F.lit(s), F.col("id")))).alias(f"h{s}") for s in range(3)))
    hubs = hubs.select("token", F.explode(F.array("h0", "h1", "h2")).alias("h")).select("token", "h.*").distinct()
    # each hub goes to the salts that its bucket has, so a bucket's rows are dealt to many tasks
    hubs = hubs.join(large.select("token", "__salt").distinct(), "token")
    far = meet(hubs, large, (F.col("x.__salt") == F.col("y.__salt")) & (F.col("x.id") != F.col("y.id")))
    first = j.measure(j.screen(near.unionByName(far).distinct(), reps))
    links = inner.unionByName(first.where(j.linked()).select("a", "b"))
    twice = some.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    links = links.unionByName(some.join(twice, "id").join(classes, ["n", "sig"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(links)

    def component(of: str) -> DataFrame:
        return parts.select(F.col("node").alias(of), F.col("component").alias("c" + of))

    # what is left of the large buckets: groups of different components
    own = large.join(component("id"), "id", "left").withColumn("cid", F.coalesce("cid", "id"))
    ends = {"lo": F.min("cid"), "hi": F.max("cid")}
    own = cut(with_group(own.drop("__salt"), ["token"], "id", ends, {"lo": F.min("lo"), "hi": F.max("hi")}).where("lo <> hi").drop("lo", "hi"))
    again = near.limit(0)
    if not own.isEmpty():
        near_kinds = own.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)))
        open_pair = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.cid") != F.col("y.cid"))
        again = cut(meet(near_kinds, own, open_pair))
        second = j.measure(j.screen(again.join(first, ["a", "b"], "left_anti"), reps))
        if not second.isEmpty():
            links = links.unionByName(second.where(j.linked()).select("a", "b"))
            parts = connected_components(links)

    # members of groups that could link though their first members don't
    inner = cut(inner)
    if not inner.isEmpty():
        many = inner.groupBy("a").agg(F.lit(True).alias("m")).select(F.col("a").alias("id"), "m")
        open_ = near.unionByName(again).distinct()
        for c in "ab":
            open_ = open_.join(many.select(F.col("id").alias(c), F.col("m").alias("m" + c)), c, "left").join(component(c), c, "left")
            open_ = open_.withColumn("m" + c, F.coalesce("m" + c, F.lit(False))).withColumn("c" + c, F.coalesce("c" + c, c))
        open_ = cut(j.screen(open_.where("(ma or mb) and ca <> cb"), reps, slack=True))
        if not open_.isEmpty():
            everyone = inner.unionByName(inner.select("a", F.col("a").alias("b")).distinct())
            for c in "ab":
                of = everyone.select(F.col("a").alias(c), F.col("b").alias("member"))
                open_ = open_.join(of, c, "left").withColumn(c, F.coalesce("member", c)).drop("member")
            third = j.measure(j.screen(open_.distinct(), reps))
            links = links.unionByName(third.where(j.linked()).select("a", "b"))
            parts = connected_components(links)
    return parts


def ngram_jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, light: int = 16
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row; component_id is the smallest id reachable by links.

    Two documents link when den * shared >= num * either over their sets of distinct k-word shingles (see shingler()).

    1. Documents with equal sets are one class, of which one stands for all.
    2. Prefixes: in a common order of shingles, linked sets share one of their first n - ceil(n * num / den) + 1.
       Shingles that more than `light` sketches have come last in that order, so shared passages stay out of prefixes.
    3. Classes of one size and prefix are one group. Its members are verified against its first; those that don't
       link with it stand for themselves.
    4. Groups that share a prefix token are filtered by size and position, then by their sketches, and verified by their first
       members on whole sets. Buckets are dealt out by token and a salt, and what meets all of a bucket by token and class of size. In a bucket of more than `light` groups, the others are first compared with only three of them, whose prefixes have the
       fewest rarer tokens, so that a family of near copies meets those nearest to its core; then just groups of different
       components meet.
    5. Where members of a pair of groups could still link and their components differ, members are expanded and
       verified. No pair of different components that could link is left out.

    A text without words (or null) has 0 shingles and its own id as component; a null id is compared with nothing and has a
    null component. Rows that repeat an id are one document, which links if one of its rows does. Other columns, clashing
    names among them, aren't returned; an empty table gives an empty one.
    """
    j, spark = _Join(df, id_col, text_col, k, num, den, light), df.sparkSession
    first: list[str] = []
    with collecting(first):
        rows = cut(_sketches(df, id_col, text_col, k, num, den))
    keys = cut(rows.select("id", "n", "sig"))
    some = keys.where("n > 0 and id is not null")
    classes = cut(some.groupBy("n", "sig").agg(F.min("id").alias("rep")))
    used: list[str] = []
    with collecting(used):
        reps = rows.join(classes.select("n", "sig", F.col("rep").alias("id")), ["id", "n", "sig"]).select("id", "n", "ext")
        reps = cut(reps.groupBy("id", "n", "ext").agg(F.lit(0)).select("id", "n", "ext"))
        discard(spark, first)
        parts = _link(j, some, classes, reps)
    parts = cut(parts)
    discard(spark, used)
    known = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "sig", F.coalesce("component", "rep").alias("component_id"))
    out = some.join(known, ["n", "sig"]).select("id", "n", "component_id")
    alone = keys.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_per_component(df: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of df but those whose component has a smaller id. components: ngram_jaccard_components() of df."""
    gone = components.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti")
