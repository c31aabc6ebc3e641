"""Facts of a group beside each of its rows, where one group may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32
HOT_KEYS = 2000


def with_counts(rows: DataFrame, key: str, spread: str, counts: DataFrame, total: int) -> DataFrame:
    """rows whose key is in counts (key, held), with held and __salt (of the column spread; 0 where the key isn't hot).

    The keys that have more than one in HOT_KEYS of total rows, at most HOT_KEYS of them, are broadcast, and only the other rows are exchanged by key.
    """
    hot = F.col("held") * HOT_KEYS > total
    told = rows.join(F.broadcast(counts.where(hot).withColumnRenamed("held", "__hot")), key, "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    few = told.where("__hot is null").drop("__hot").join(counts.where(~hot), key).withColumn("__salt", F.lit(0))
    return told.where("__hot is not null").withColumnRenamed("__hot", "held").withColumn("__salt", salt).unionByName(few)


def with_group(rows: DataFrame, keys: list[str], spread: str, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """rows with __salt and the facts of their group.

    partial are aggregates over rows; final are aggregates over their results, under the same names. Rows are exchanged by keys and a salt (of the
    column spread), so a hot group is dealt to as many tasks as there are salts. What is exchanged by keys alone has at most that many rows a group.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    groups = parts.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))
    return salted.join(parts.select(*keys, "__salt").join(groups, keys), [*keys, "__salt"])
