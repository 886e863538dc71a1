"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, freeing, materialise

#: Edges (16 bytes each) that one task joins up by itself; a larger table goes through rounds of shuffles.
TASK_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: of each node of the task's edges but the smallest of its part, that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(c.to_numpy().tolist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = np.array([(x, root(x)) for x in list(parent)], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, longs): root is the component's smallest node.

    Edges are first joined up within each task. What is left, if up to ``task_edges``, is joined up in one task, else in alternating large-star and small-star
    rounds: each is one min aggregation and one join on a node, so no task or driver gathers a component. Every round is written to the shared scratch
    folder, the one before it removed. Loops, repeated edges and an empty table are allowed. The rounds that a component takes grow with the logarithm
    of its size; not to have converged after ``max_rounds`` is an error."""
    e = edges.where("a <> b").select("a", "b").mapInArrow(freeing(_forest), "u long, v long").distinct()
    e, before = materialise(e, "edges"), None
    small = e.count() <= task_edges
    if small:
        e, old = materialise(e.coalesce(1).mapInArrow(freeing(_forest), "u long, v long"), "edges"), e
        discard(old)
    for _ in range(0 if small else max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = materialise(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges"), e
        discard(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    else:
        if not small:
            raise RuntimeError(f"components have not converged after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
