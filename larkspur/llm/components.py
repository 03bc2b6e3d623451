"""Connected components of links between integer nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut

#: Distinct edges up to which one task finishes the components.
FEW_EDGES = 1 << 16


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """node and label for every node of edges (a, b longs): nodes with equal labels are connected, the others aren't.

    While there are more than few distinct edges, every node points to the neighbour (or itself) of the least hash, with
    another hash each round, and the edges are contracted to what is pointed to. A share of the nodes is expected to go each
    round, however the nodes are numbered, so that the rounds are logarithmic in their number. What is left then
    is bounded, and one task joins it. Nothing is kept on the driver. A node with a very large number of links is
    pre-aggregated, since only a minimum is taken of them.
    """
    few = FEW_EDGES if few is None else few
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    turn = 0
    while edges.count() > few:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn += 1
        first = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(first("b")).alias("m")).select("a", F.least("m", first("a"))["node"].alias("m"))
        step = cut(least)
        labels = _followed(labels, step)
        edges = edges.join(step.select("a", F.col("m").alias("x")).hint("merge"), "a").join(step.select(F.col("a").alias("b"), F.col("m").alias("y")).hint("merge"), "b")
        edges = cut(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    last = edges.repartition(1).mapInArrow(_joined, "a long, m long")
    return _followed(labels, last)


def _followed(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """The labels after a step from a to m."""
    fresh = step.select(F.col("a").alias("node"), F.col("m").alias("label"))
    if labels is None:
        return cut(fresh)
    onward = step.select(F.col("a").alias("label"), "m").hint("merge")
    return cut(labels.join(onward, "label", "left").select("node", F.coalesce("m", "label").alias("label")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bounded number of edges and the least node it is connected with."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    ends = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in zip(at[: len(ends[0])].tolist(), at[len(ends[0]) :].tolist(), strict=True):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        root[max(a, b)] = min(a, b)
    top = np.array(root, dtype=np.int64)
    while len(top) and (top[top] != top).any():
        top = top[top]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[top] if len(nodes) else nodes)], names=["a", "m"])
