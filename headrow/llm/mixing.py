"""Mixing sources to target weights: hierarchical budgets, and seeded token-prefixes of each leaf."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from headrow.llm.hot import HOT_KEYS, SALTS
from headrow.plans.lineage import cut

_CELL_BITS = 14
_BLOCK_BITS = 7  # cells are summed in blocks first
_SHARE = 1 << 60  # weights are whole shares of the heaviest sibling's, so that sums don't depend on the order of adding


def word_tokens(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def share_out(budget: int, weights: list[float], limits: list[int]) -> list[int]:
    """Split budget by weights, none over its limit; what one can't take goes to the others by their weights.

    Whole numbers throughout, so that share_out_spread() shares out alike to the token.
    """
    given = [0] * len(weights)
    open_ = [i for i, (w, m) in enumerate(zip(weights, limits)) if w > 0 and m > 0]
    top = max((weights[i] for i in open_), default=1.0)
    shares = {i: max(1, int(weights[i] / top * _SHARE)) for i in open_}
    left = min(budget, sum(limits[i] for i in open_))
    while open_:
        total = sum(shares[i] for i in open_)
        parts = {i: left * shares[i] // total for i in open_}
        full = [i for i in open_ if parts[i] >= limits[i]]
        for i in full:
            given[i] = limits[i]
            left -= limits[i]
        open_ = [i for i in open_ if parts[i] < limits[i]]
        if not full:
            spare = left - sum(parts.values())  # fewer than there are open ones: one each to the first of them
            for place, i in enumerate(open_):
                given[i] = parts[i] + (place < spare)
            break
    return given


def budgets(
    available: dict[tuple, int], budget: int, max_epochs: int, weight_of: Callable[[tuple, int], float]
) -> dict[tuple, int]:
    """Tokens for each leaf of a tree whose leaves are paths (domain, language, source).

    Budgets go down the tree by weight_of(path prefix, its available tokens). A node takes at most max_epochs times what it
    has; a shortage goes to its siblings first, and only what all of them can't take goes up to the parent's siblings.
    """
    depth = len(next(iter(available), ()))
    sums: dict[tuple, int] = {}
    children: dict[tuple, set[tuple]] = {}
    for path, n in available.items():
        for d in range(depth + 1):
            sums[path[:d]] = sums.get(path[:d], 0) + n
            if d:
                children.setdefault(path[: d - 1], set()).add(path[:d])
    given = {(): min(budget, max_epochs * sums.get((), 0))}
    for d in range(depth):
        for node in [x for x in given if len(x) == d]:
            kids = sorted(children[node], key=lambda p: (zlib.crc32(p[-1].encode()) % SALTS, p[-1]))
            parts = share_out(given[node], [weight_of(k, sums[k]) for k in kids], [max_epochs * sums[k] for k in kids])
            given.update(zip(kids, parts))
    return {p: given.get(p, 0) for p in available}


def share_out_spread(nodes: DataFrame, keys: list[str], name: str, given: DataFrame) -> DataFrame:
    """share_out() for the children of many parents at once: (keys, name, given) of each node that gets any.

    nodes: keys (of the parent; none for the root), name, w, m (limit); given: keys, given. Each round sums, for each parent, the limits
    of the nodes that are full at its rate and the weights of the others, and raises the rate by what the full ones leave; it ends when
    no more become full. Children are dealt out by a salt, so those of one parent, however many, never meet in one task.
    """
    salted = lambda t: t.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = nodes.where("w > 0 and m > 0").withColumn("__salt", F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(SALTS)).cast("int"))
    nodes = cut(nodes.select(*keys, name, "w", "m", "__salt"))
    share = F.greatest(F.lit(1).cast("long"), (F.col("w") / F.col("top") * F.lit(float(_SHARE))).cast("long")).cast("decimal(19,0)")
    part = F.call_function("div", F.col("left").cast("decimal(19,0)") * share, F.col("open"))
    full = F.col("open").isNull() | (part >= F.col("m"))
    tops = nodes.join(salted(given), [*keys, "__salt"]).groupBy(*keys).agg(F.max("given").alias("given"), F.max("w").alias("top"))
    rates = tops.select(*keys, "given", "top", F.lit(0).cast("long").alias("left"), F.lit(1).cast("decimal(29,0)").alias("open"), F.lit(-1).cast("long").alias("n_full"))
    while True:
        met = nodes.join(salted(rates), [*keys, "__salt"]).withColumn("full", full)
        sums = met.groupBy(*keys).agg(
            F.max("given").alias("given"), F.max("top").alias("top"), F.coalesce(F.sum(F.when(F.col("full"), F.col("m"))), F.lit(0)).alias("taken"),
            F.sum(F.when(~F.col("full"), share)).alias("open"), F.count_if("full").alias("n"), F.max("n_full").alias("before"),
        )
        rates = cut(sums.select(*keys, "given", "top", F.greatest(F.lit(0), F.col("given") - F.col("taken")).alias("left"), "open", F.col("n").alias("n_full"), "before"))
        if rates.where("n_full > before").isEmpty():
            break
    met = nodes.join(salted(rates), [*keys, "__salt"]).withColumn("full", full)
    parts = cut(met.select(*keys, name, "__salt", "full", F.when(F.col("full"), F.col("m")).otherwise(part).cast("long").alias("given"), F.col("given").alias("whole")))
    # the tokens that rounding left go, one each, to the first of the nodes that aren't full
    blocks = parts.groupBy(*keys, "__salt").agg(F.max("whole").alias("whole"), F.sum("given").alias("spent"), F.count_if(~F.col("full")).alias("n"))
    parent = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(parent.orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    blocks = blocks.select(*keys, "__salt", before, (F.col("whole") - F.sum("spent").over(parent)).alias("over"))
    nth = F.count_if(~F.col("full")).over(Window.partitionBy(*keys, "__salt").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    one = (~F.col("full") & (nth + F.col("before") <= F.col("over"))).cast("long")
    return parts.drop("whole").join(blocks, [*keys, "__salt"]).select(*keys, name, (F.col("given") + one).alias("given"))


def budgets_spread(
    leaves: DataFrame, level: list[str], budget: int, max_epochs: int, alpha: float, weights: dict[tuple, float]
) -> DataFrame:
    """budgets() as jobs: leaves (level, n) with given, for trees of any size; weights is a parameter, not a table."""
    spark = leaves.sparkSession
    given = spark.range(1).select(F.lit(budget).cast("long").alias("given"))
    for d in range(1, len(level) + 1):
        keys, name = level[: d - 1], level[d - 1]
        nodes = leaves.groupBy(*keys, name).agg(F.sum("n").alias("n"))
        w = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
        chosen = [(*p, float(x)) for p, x in weights.items() if len(p) == d]
        if chosen:
            table = spark.createDataFrame(chosen, ", ".join([*(f"{c} string" for c in level[:d]), "chosen double"]))
            nodes, w = nodes.join(table, level[:d], "left"), F.coalesce("chosen", w)
        given = cut(share_out_spread(nodes.withColumn("w", w).withColumn("m", F.col("n") * max_epochs), keys, name, given))
    return leaves.join(given, level, "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long")))


def mix_sources(
    df: DataFrame,
    levels: list[Column],
    budget_fraction: float = 0.8,
    alpha: float = 0.5,
    max_epochs: int = 1,
    weights: dict[tuple, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    keep: list[str] | None = None,
    max_leaves: int = 100_000,
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Select rows so that the leaves of a tree have their budgets of tokens; adds epoch and mix_tokens.

    levels: columns from root to leaf, such as domain, language and source (null counts as ''). The whole budget is
    budget_fraction of all tokens. A node's weight among its siblings is weights[path], else its tokens to the power alpha.
    Budgets and shortages: budgets(). A leaf takes its rows in a seeded order, epoch after epoch (each with an order
    of its own), while the running sum of tokens stays within its budget; a row of a full epoch comes once for that epoch.

    Texts are read twice: once to count tokens into a narrow table of the rows (leaf, id, hash of the text, tokens), and once to give the
    chosen rows. The prefix is found on the narrow table without gathering a leaf in one task: tokens are summed in 16,384 cells of the seeded
    order, those in 128 blocks, and only rows of the cell at the boundary are summed one by one; each leaf then has one last place in its
    order. A tree of at most max_leaves leaves whose names take at most broadcast_bytes reaches the driver and is
    broadcast to the rows. A larger one stays a table: its budgets are found level by level (budgets_spread()), alike to the token,
    and joined to the rows by exchange, where rows of leaves with more than one in 2,000 of all rows are dealt to many tasks. Rows without tokens
    go with the others, and once where their leaf has no tokens at all; the order hashes id and text, so rows of one id, or of none, are spread, and
    only repeated rows tie: where the budget ends between rows of one place, as many of them as it allows are taken.
    Columns named epoch or mix_tokens are replaced; an empty table gives an empty one.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("epoch", "mix_tokens")]
    level = [f"__l{i}" for i in range(len(levels))]
    names = [f"__c{i}" for i in range(len(kept))]
    counted = tokens if tokens is not None else word_tokens(df[text_col])
    rows = df.select(
        *(df[c].alias(n) for c, n in zip(kept, names)),
        *(F.coalesce(x.cast("string"), F.lit("")).alias(n) for x, n in zip(levels, level)),
        F.coalesce(df[id_col].cast("string"), F.lit("")).alias("__id"),
        F.xxhash64(df[text_col].cast("string")).alias("__bytes"),
        F.coalesce(counted, F.lit(0)).cast("long").alias("mix_tokens"),
    )
    narrow = cut(rows if text_col not in kept else rows.select(*level, "__id", "__bytes", "mix_tokens"))
    if text_col not in kept:
        rows = narrow
    leaves = cut(narrow.groupBy(*level).agg(F.sum("mix_tokens").alias("n"), F.count(F.lit(1)).alias("c")))
    bytes_ = sum((F.octet_length(c).cast("long") + 64 for c in level), F.lit(0).cast("long"))
    facts = leaves.agg(F.count(F.lit(1)).alias("leaves"), F.sum(bytes_).alias("held"), F.sum("n").alias("n"), F.sum("c").alias("c")).first()
    small = facts.leaves <= max_leaves and (facts.held or 0) <= broadcast_bytes
    budget, chosen, spark = int((facts.n or 0) * budget_fraction), weights or {}, df.sparkSession

    def of_leaves(table: list[tuple], numbers: str) -> DataFrame:
        return spark.createDataFrame(table, ", ".join([*(f"{c} string" for c in level), numbers]))

    if small:
        nodes = leaves.rollup(*level).agg(F.sum("n").alias("n"), F.grouping_id().alias("up"))
        nodes = [(tuple(r[: len(level) - r.up.bit_count()]), r.n, r.w) for r in nodes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha)))).collect()]
        available = {p: n for p, n, _ in nodes if len(p) == len(level)}
        natural = {p: w for p, _, w in nodes}
        goal = budgets(available, budget, max_epochs, lambda p, n: chosen.get(p, natural[p]))
        goal = {p: divmod(g, available[p]) if available[p] else (1, 0) for p, g in goal.items()}
        plan = of_leaves([(*p, *g) for p, g in goal.items()], "__full long, __rest long")
    else:
        some = F.col("n") > 0
        full, rest = F.when(some, F.expr("given div n")).otherwise(1), F.when(some, F.col("given") % F.col("n")).otherwise(0)
        plan = cut(budgets_spread(leaves, level, budget, max_epochs, alpha, chosen).select(*level, full.cast("long").alias("__full"), rest.cast("long").alias("__rest")))
        crowded = cut(leaves.where(F.col("c") * HOT_KEYS > facts.c).select(*level))  # fewer than HOT_KEYS

    def tell(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
        """rows with the names of table for their leaf; null where it has none."""
        if small:
            return rows.join(F.broadcast(table), level, "left")
        fact = F.struct(*names)
        hot = table.join(F.broadcast(crowded), level, "left_semi").select(*level, fact.alias("__hot"))
        cold = table.join(F.broadcast(crowded), level, "left_anti").select(*level, F.lit(-1).alias("__key"), fact.alias("__cold"))
        # a row of a crowded leaf looks for no other: a key of its own spreads it
        told = rows.join(F.broadcast(crowded.withColumn("__crowd", F.lit(True))), level, "left").join(F.broadcast(hot), level, "left")
        told = told.withColumn("__key", F.when(F.col("__crowd"), F.pmod(F.xxhash64("__id", "__bytes"), F.lit(1 << 20)).cast("int")).otherwise(-1))
        told = told.join(cold.hint("merge"), [*level, "__key"], "left").withColumn("__fact", F.coalesce("__hot", "__cold"))
        return told.select(*rows.columns, *(F.col(f"__fact.{n}").alias(n) for n in names))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__order", F.xxhash64(F.lit(seed), F.col("__full"), F.col("__id"), F.col("__bytes")))

    keyed = placed(tell(narrow, plan, ["__full", "__rest"])).where("__rest > 0").withColumn("__cell", F.shiftright("__order", 64 - _CELL_BITS))
    cells = cut(keyed.groupBy(*level, "__rest", "__cell").agg(F.sum("mix_tokens").alias("n")))
    cells = cells.withColumn("__block", F.shiftright("__cell", _CELL_BITS - _BLOCK_BITS))

    def boundary(sums: DataFrame, by: str, before: Column) -> DataFrame:
        """The first part of each leaf at which the running sum passes the budget, and the sum before it."""
        run = Window.partitionBy(*level).orderBy(by)
        upto = sums.withColumn("__upto", before + F.sum("n").over(run)).where("__upto > __rest")
        first = upto.groupBy(*level).agg(F.min_by(F.struct(by, (F.col("__upto") - F.col("n")).alias("__before")), by).alias("e"))
        return first.select(*level, "e.*")

    block = boundary(cells.groupBy(*level, "__rest", "__block").agg(F.sum("n").alias("n")), "__block", F.lit(0))
    edge = boundary(cells.join(block, [*level, "__block"]), "__cell", F.col("__before"))
    edge = edge.select(*level, F.col("__cell").cast("long").alias("__edge"), "__before")
    edge = of_leaves([tuple(r) for r in edge.collect()], "__edge long, __before long") if small else cut(edge)

    # the last place of each leaf's order within its budget, how many rows have it, and how many of them the budget allows
    running = Window.partitionBy(*level).orderBy("__order", "__id", "__bytes").rowsBetween(Window.unboundedPreceding, 0)
    near = tell(keyed, edge, ["__edge", "__before"]).where("__cell = __edge")
    near = near.withColumn("__fits", F.col("__before") + F.sum("mix_tokens").over(running) <= F.col("__rest"))
    places = near.groupBy(*level, "__edge", "__order").agg(F.count_if("__fits").alias("__some"), F.count(F.lit(1)).alias("__all"))
    last = F.max(F.when(F.col("__some") > 0, F.struct("__order", "__some", "__all")))
    ends = cut(places.groupBy(*level, "__edge").agg(last.alias("e")).select(*level, "__edge", "e.*"))
    before_cell = F.shiftleft("__edge", 64 - _CELL_BITS)  # every earlier cell's places are smaller
    split = F.coalesce(F.col("__some") < F.col("__all"), F.lit(False))
    ends = ends.select(*level, F.coalesce("__order", before_cell).alias("__last"), (F.col("__order").isNotNull() & ~split).alias("__with"), F.when(split, F.col("__some")).alias("__some"))
    if small:
        found = {tuple(r[: len(level)]): tuple(r[len(level) :]) for r in ends.collect()}
        ends = of_leaves([(*p, *g, *found.get(p, (None, None, None))) for p, g in goal.items()], "__full long, __rest long, __last long, __with boolean, __some long")
        ties = any(some is not None for _, _, some in found.values())
    else:
        ends = cut(plan.join(ends, level, "left"))
        ties = not ends.where("__some is not null").isEmpty()

    own = [F.col(n).alias(c) for n, c in zip(names, kept)]
    ended = placed(tell(rows, ends, ["__full", "__rest", "__last", "__with", "__some"]))
    inside = (F.col("__order") < F.col("__last")) | (F.col("__with") & (F.col("__order") == F.col("__last")))
    epochs = ended.withColumn("__n", F.col("__full") + F.coalesce(inside, F.lit(False)).cast("long")).where("__n > 0")
    out = epochs.select(*own, "mix_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("epoch"))
    if ties:
        nth = F.row_number().over(Window.partitionBy(*level).orderBy("__id", "__bytes"))
        tied = ended.where("__some is not null and __order = __last").withColumn("__nth", nth).where("__nth <= __some")
        out = out.unionByName(tied.select(*own, "mix_tokens", F.col("__full").alias("epoch")))
    return out.select(*kept, "epoch", "mix_tokens")
