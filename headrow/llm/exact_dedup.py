"""Exact deduplication by distributed radix partitioning, most significant bytes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headrow.llm.hot import HOT_KEYS, with_group
from headrow.plans.lineage import cut

_FIRST_DIGIT = 32  # bytes; each later digit has GROWTH times as many
_GROWTH = 16
_BUCKETS, _BITS = 2048, 32768  # bitmaps of bitmap_construct_agg: 8 MB in all, whatever the number of rows


def normal_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text with each run of [\\x20\\x09-\\x0D] as one space; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.encode(F.regexp_replace(whole, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ").alias("t"), "UTF-8")


def _digit(raw: Column, offset: int, size: int) -> Column:
    return F.substring(raw, offset + 1, size)


def _with_shared(base: DataFrame, heads: DataFrame) -> DataFrame:
    """base with __shared: true where the length and first digit are in heads, and for few others while heads are far fewer than bits."""
    spot = lambda: F.pmod(F.xxhash64("__len", "__digit"), F.lit(_BUCKETS * _BITS))
    bits = heads.groupBy(F.floor(spot() / _BITS).alias("__bucket")).agg(F.bitmap_construct_agg(spot() % _BITS).alias("__bits"))  # at most _BUCKETS rows of 4 KB
    at = base.withColumn("__spot", spot()).withColumn("__bucket", F.floor(F.col("__spot") / _BITS)).withColumn("__spot", (F.col("__spot") % _BITS).cast("int"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__spot", 3) + 1, F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.expr("(__byte >> (__spot % 8)) & 1") == 1, F.lit(False))
    return at.join(F.broadcast(bits), "__bucket", "left").withColumn("__byte", byte).withColumn("__shared", shared).drop("__bucket", "__bits", "__spot", "__byte")


def _split(rows: DataFrame, digits: list[str], total: int) -> DataFrame:
    """Split each group (gid), of __of rows so far, by its digit: adds n (rows of the new group) and first (its smallest row key).

    Counts and minima are aggregated before the exchange. Rows of the at most HOT_KEYS groups that have more than their share of total are dealt to
    many tasks.
    """
    key = F.struct(F.col("__null_id"), F.col("__id"), F.col("__row"))
    facts = {"__n": F.count(F.lit(1)), "__first": F.min(key)}
    hot = F.col("__of") * HOT_KEYS > total
    cold = rows.where(~hot)
    groups = cold.groupBy(*digits).agg(*(c.alias(n) for n, c in facts.items()))
    spread = with_group(rows.where(hot), digits, "__row", facts, {"__n": F.sum("__n"), "__first": F.min("__first")})
    return cold.join(groups, digits).unionByName(spread.drop("__salt")).drop("__of")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add keep_id (the smallest id among equal texts), group_size and kept for every row.

    Texts are equal when identical after normal_bytes(). The string that is split is the text's length followed by
    its bytes: groups are split by successive digits (runs of bytes, 32 and then 16 times as many each round) until
    they are singletons or ended; rows of an ended group are equal by comparison of every byte, and no digest is used.
    A text that is unique in length and first bytes leaves before the first exchange (a few of them after it), by a
    bitmap of the heads that several rows share; only the others carry their bytes on. The number of rounds grows with the logarithm of the longest repeated text.

    A null text counts as empty; null ids sort last. Where rows repeat an id, exactly one row of the group is kept, the
    others aren't, though their keep_id is their own id. keep names the columns passed through (all by default);
    columns named keep_id, group_size or kept are replaced. An empty table gives an empty one.
    """
    made = ("keep_id", "group_size", "kept")
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    carried = [df[c].alias(f"c{i}") for i, c in enumerate(kept)]
    names = [f"c{i}" for i in range(len(kept))]
    base = df.select(*carried, df[id_col].alias("__id"), df[id_col].isNull().alias("__null_id"), normal_bytes(df[text_col]).alias("__raw"))
    base = base.withColumn("__len", F.octet_length("__raw")).withColumn("__digit", _digit(F.col("__raw"), 0, _FIRST_DIGIT))
    # lengths and first digits that several rows share; the at most HOT_KEYS of them with the most rows are told to all tasks
    heads = cut(base.groupBy("__len", "__digit").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    shared = heads.agg(F.sum("__n")).first()[0] or 0
    hot = heads.where(F.col("__n") * HOT_KEYS > shared).withColumnRenamed("__n", "__hot")
    cold = heads.where(F.col("__n") * HOT_KEYS <= shared).select(F.col("__len").alias("__key"), "__digit", "__n")
    met = _with_shared(base, heads)
    told = met.where("__shared").drop("__shared").withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(hot), ["__len", "__digit"], "left")
    # a hot row looks for no cold key: a negative one spreads it, by its place, since ids can repeat
    told = told.withColumn("__key", F.when(F.col("__hot").isNotNull(), -1 - F.pmod(F.xxhash64("__place"), F.lit(1 << 20)).cast("int")).otherwise(F.col("__len")))
    # an exchange at every size: what is broadcast would grow with the rows
    first = told.join(cold.hint("merge"), ["__key", "__digit"], "left").withColumn("__n", F.coalesce("__hot", "__n", F.lit(1).cast("long")))
    alone = F.col("__n") == 1
    rows = first.select(
        *names, "__id", "__null_id", "__len", "__digit", "__n", F.when(~alone, F.col("__raw")).alias("__raw")
    ).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows)
    own = [F.col(c).alias(k) for c, k in zip(names, kept)]
    single = [*own, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    out = met.where("not __shared").select(*single).unionByName(rows.where("__n = 1").select(*single))

    # the first digit again, among those that share it, names the groups
    live = _split(rows.where("__n > 1").withColumnRenamed("__n", "__of"), ["__len", "__digit"], shared).drop("__digit")
    offset, size = _FIRST_DIGIT, _FIRST_DIGIT * _GROWTH
    while True:
        live = cut(live.withColumn("__done", (F.col("__n") == 1) | (F.col("__len") <= offset)))
        done = live.where("__done")
        is_first = F.struct("__null_id", "__id", "__row") == F.col("__first")
        out = out.unionByName(done.select(*own, F.col("__first.__id").alias("keep_id"), F.col("__n").alias("group_size"), is_first.alias("kept")))
        rest = live.where("not __done")
        if rest.isEmpty():
            return out
        rest = rest.select(
            *names, "__id", "__null_id", "__row", "__len", "__raw", F.col("__n").alias("__of"), F.col("__first.__row").alias("__gid"), _digit(F.col("__raw"), offset, size).alias("__digit")
        )
        live = _split(rest, ["__gid", "__digit"], shared).drop("__gid", "__digit")
        offset, size = offset + size, size * _GROWTH


def normal_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of normal_bytes()."""
    return F.sha2(normal_bytes(text), 256)
