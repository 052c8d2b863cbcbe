"""Connected components of an undirected graph of long ids by alternating star contraction.

Every round rewires each node's larger neighbours, then its smaller ones, to the smallest id in reach;
the edges converge to one star for each component. Aggregates combine before the shuffle, and the joins
can be split by adaptive execution where a node has very many neighbours. Before the first round each
task contracts the edges it happens to hold. Lineage is cut in the shared checkpoint folder every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


def contract(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Replaces the edges of each task by stars (union-find over at most ``most`` edges at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def stars() -> pa.RecordBatch:
            nodes = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge to another but the roots; a root is the smallest node of its component.

    Edges (a, b) may repeat and go either way; loops are dropped. An empty table gives no rows.
    """
    now = cut(contract(edges.where("a <> b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = cut(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("components did not converge")


