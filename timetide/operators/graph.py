"""Graph operators over edge tables: components, reachability, closure of cause and effect."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.operators.lineage import cut


#: Edges that one task contracts before labels travel between tasks.
PER_PART = 50_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: every node with the least node that these edges lead it to."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    names = None
    for batch in batches:
        names = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if names is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), names.field(0).type), pa.array([root(x) for x in up], names.field(0).type)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) of every node of edges (a, b).

    Tasks first contract the edges that they hold, `PER_PART` on average. Where that takes more than one task, rounds
    follow: a node takes the smallest label of itself and its neighbours, then the label of that label, so labels travel
    twice as far each time, until no label changes. Nothing but one flag comes to the driver. Labels meet in sums over
    each task first, and the join on a hub is one that Spark can split.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = cut(edges.select("a", "b").filter("a <> b"))
    parts = max(1, edges.count() // PER_PART)
    stars = cut(edges.coalesce(parts).mapInArrow(_contracted, f"a {kind}, b {kind}"))
    if parts == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = cut(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "l", F.lit(None).cast(kind).alias("old"))
        near = told.unionByName(labels.withColumn("old", F.col("l"))).groupBy("node").agg(F.min("l").alias("l"), F.max("old").alias("old"))
        up = near.select(F.col("node").alias("l"), F.col("l").alias("up"))
        after = cut(near.join(up, "l", "left").select("node", F.least("l", F.coalesce("up", "l")).alias("l"), "old").coalesce(2 * parts))
        if after.filter("l <> old").isEmpty():
            return after.select("node", F.col("l").alias("component"))
        labels = after.select("node", "l")


def reachable_kinds(edges: list[tuple[str, str, DataFrame]], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """By kind: node, hops (the fewest) of every node that directed edges reach from sources (node); a source is 0 hops off.

    edges: (kind of a, kind of b, a table of a, b). Nodes of one kind have one type. Only the nodes that the last round has
    found are joined, and only to the edges that leave their kind, so a table of edges is read as often as it leads on.
    """
    found: dict[str, list[DataFrame]] = {}
    frontier, hops = dict(sources), 0
    while frontier:
        after: dict[str, DataFrame] = {}
        for kind, nodes in frontier.items():
            new = nodes.select("node").distinct()
            for known in found.get(kind, []):
                new = new.join(known.select(F.col("node").alias("__known")), F.col("node").eqNullSafe(F.col("__known")), "left_anti")
            new = cut(new)
            if hops and new.isEmpty():
                continue
            found.setdefault(kind, []).append(new.withColumn("hops", F.lit(hops)))
            for start, end, own in edges:
                if start == kind:
                    step = own.select("a", "b").join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"))
                    after[end] = after[end].unionByName(step) if end in after else step
        frontier, hops = after, hops + 1
    return {kind: reduce(DataFrame.unionByName, parts) for kind, parts in found.items()}


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, hops of every node that directed edges (a, b) of one kind reach from sources (node)."""
    return reachable_kinds([("", "", cut(edges.select("a", "b")))], {"": sources})[""]
