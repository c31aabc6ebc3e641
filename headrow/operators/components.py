"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from headrow.plans.lineage import cut


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each end of the edges (a, b) of one task reaches."""
    to: dict = {}

    def root(x):
        path = []
        while (up := to.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            to[y] = x
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            to[max(a, b)] = min(a, b)
    if to:
        nodes = list(to)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["n", "p"])


def _jump(parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("n").alias("p"), F.col("p").alias("pp"))
    return parent.join(up, "p").select("n", F.col("pp").alias("p"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, small: int = 50_000) -> DataFrame:
    """Label each node of an undirected edge list with the smallest node of its component.

    Returns (node, component). Nodes are any orderable type; edges with a null end are ignored, loops only make
    their node known. An empty edge list gives an empty result. Each round points every node at the smallest of itself and
    its neighbours, follows the pointers to their roots by jumping, and contracts each tree to its root. A tree has two
    nodes at least, so nodes halve each round; jumping doubles its reach, so a long chain takes a logarithmic number of
    steps too. As soon as at most small edges between contracted nodes are left, one task finishes them. Raises RuntimeError if edges are left
    after max_rounds.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    live = cut(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        left = live.count()
        if not left:
            return labels
        if left <= small:
            kind = live.schema["a"].dataType
            roots = live.coalesce(1).mapInArrow(_roots, StructType([StructField("n", kind), StructField("p", kind)]))
            to = roots.select(F.col("n").alias("component"), F.col("p").alias("np"))
            return cut(labels.join(to, "component", "left").select("node", F.coalesce("np", "component").alias("component")))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("p")))
        while True:
            far = _jump(parent)  # two jumps a write
            up = far.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            jumped = cut(far.join(up, "p").select("n", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            parent = jumped.select("n", "p")
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("n").alias("component"), F.col("p").alias("np"))
        labels = cut(labels.join(to, "component", "left").select("node", F.coalesce("np", "component").alias("component")))
        pa, pb = (parent.select(F.col("n").alias(c), F.col("p").alias("p" + c)) for c in "ab")
        moved = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
