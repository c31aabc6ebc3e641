"""Sharding by histogram sort: exact counts below probes, refined until splitters meet the tolerance, one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headrow.plans.lineage import cut

_MOST_BITS = 12  # of the key that a round of probes looks at
_MOST_CELLS = 1 << 16  # counts that reach the driver in a round
_KEY_BITS = 64
_LOW = -(1 << 63)


def _leading(key: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit key, in the key's order."""
    return F.shiftright(key, _KEY_BITS - bits)


def find_splitters(rows: DataFrame, targets: list[int], tolerances: list[int]) -> list[tuple[int, int]]:
    """Keys (k1, k2), one for each target: the bytes of all rows below it are within its tolerance of the target.

    rows: (k1, k2, size), k1 and k2 signed 64-bit, read as one 128-bit key; targets ascend. Each round counts, exactly and over all partitions,
    bytes in the cells below each open interval of keys (4,096, or fewer where many are open), and narrows every splitter to one cell of
    it. A splitter is settled when a boundary is within its tolerance, or at the nearer side of the one row on which the target falls. At
    most 65,536 counts reach the driver in a round, or two for each open splitter, whatever the input.
    """
    spark = rows.sparkSession
    settled: dict[int, tuple[int, int]] = {}
    # an open interval: the key bits fixed so far (of k1, then of k2), bytes below it, the splitters that look into it
    open_: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(len(targets))))} if targets else {}
    done = 0
    while open_:
        column, used = ("k1", done) if done < _KEY_BITS else ("k2", done - _KEY_BITS)
        width = max(1, min(_MOST_BITS, (_MOST_CELLS // len(open_)).bit_length() - 1))
        bits = min(used + width, _KEY_BITS)
        cell = _leading(F.col(column), bits).alias("cell")
        if done == 0:
            held = rows.select(F.lit(0).alias("at"), cell, "size")
        elif done <= _KEY_BITS:
            known = spark.createDataFrame([(p[0], i) for i, p in enumerate(open_)], "parent long, at int")
            held = rows.withColumn("parent", _leading(F.col("k1"), done)).join(F.broadcast(known), "parent").select("at", cell, "size")
        else:
            known = spark.createDataFrame([(*p, i) for i, p in enumerate(open_)], "k1 long, parent long, at int")
            held = rows.withColumn("parent", _leading(F.col("k2"), used)).join(F.broadcast(known), ["k1", "parent"]).select("at", cell, "size")
        counts: dict[int, list[tuple[int, int, int]]] = {}
        for r in held.groupBy("at", "cell").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["at"], []).append((r["cell"], r["b"], r["n"]))
        last = column == "k2" and bits == _KEY_BITS
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for i, (prefix, (below, splitters)) in enumerate(open_.items()):
            cells = sorted(counts.get(i, []))
            start = lambda c, prefix=prefix: (c << (_KEY_BITS - bits), _LOW) if column == "k1" else (prefix[0], c << (_KEY_BITS - bits))
            n, at = 0, below  # targets ascend, so each looks on from where the one before it stopped
            for s in splitters:
                while n < len(cells) - 1 and at + cells[n][1] <= targets[s]:
                    at += cells[n][1]
                    n += 1
                if not cells:
                    settled[s] = (_LOW, _LOW)
                    continue
                c, b, n_rows = cells[n]
                short, over = targets[s] - at, at + b - targets[s]
                after = start(cells[n + 1][0]) if n + 1 < len(cells) else None
                if short <= tolerances[s] or (n_rows == 1 or last) and (short <= over or not after and last):
                    settled[s] = start(c)
                elif after and (over <= tolerances[s] or n_rows == 1 or last):
                    settled[s] = after
                else:
                    following.setdefault((c,) if column == "k1" else (prefix[0], c), (at, []))[1].append(s)
        open_, done = following, done + bits - used
    return [settled[s] for s in range(len(targets))]


def places(splitters: list[tuple[int, int]]) -> Column:
    """How many of the ascending splitters a row's key (k1, k2) has reached, by binary search."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    a, b = (F.lit([s[i] for s in splitters]) for i in (0, 1))
    k1, k2 = F.col("k1"), F.col("k2")

    def step(found: Column, stride: Column) -> Column:
        i = found + stride - 1
        x = F.get(a, i)
        reached = (x < k1) | ((x == k1) & (F.get(b, i) <= k2))
        return F.when((i < n) & reached, found + stride).otherwise(found)

    strides = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    return F.aggregate(strides, F.lit(0), step)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, tolerance: float = 0.001, keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard, in the order of keys) for every row.

    size is the text's UTF-8 bytes (null: none) plus 16; shards have nearly equal bytes: each splitter is within
    tolerance of a shard's share, or as near as whole rows allow. Rows are sorted by a 64-bit hash of the text and then by a hash of the id,
    so equal texts lie together and a group of copies is cut only where a splitter falls into it; a hot group is
    spread over as many shards as its bytes fill. find_splitters() cuts each shard into parts too (as many parts in all as there are shuffle
    partitions, or one a shard, within a twentieth of a part); rows are exchanged once, each to the partition of its part, and a slot is the
    row's place there behind the rows of the shard's parts before it, which were counted.

    Null ids sort with a hash of their own; repeated rows each have a slot; columns named like a new one are replaced; an empty
    table gives an empty one.
    """
    new = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"c{i}" for i in range(len(kept))]
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = cut(
        df.select(
            *(df[c].alias(n) for c, n in zip(kept, names)),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("k1"),
            F.xxhash64(df[id_col].cast("string")).alias("k2"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    each = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // shards)
    parts = shards * each
    targets = [total * i // parts for i in range(1, parts)]
    near = [int(total / shards * tolerance) if i % each == 0 else total // (20 * parts) for i in range(1, parts)]
    keys = rows.select("k1", "k2", "size")
    placed = rows.withColumn("part", places(find_splitters(keys, targets, near) if total else []))

    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most parts rows
    before = [sum(counts.get(p, 0) for p in range(q - q % each, q)) for q in range(parts)]
    sorted_ = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("k1", "k2")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    return sorted_.select(
        *(F.col(n).alias(c) for n, c in zip(names, kept)), "size", "text_crc32", F.floor(F.col("part") / each).cast("int").alias("shard"),
        (index + F.get(F.lit(before).cast("array<long>"), F.col("part"))).alias("slot"),
    )
