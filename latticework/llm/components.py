"""Connected components: union-find within tasks of bounded size, alternating star rounds across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

EDGES_PER_TASK = 1_000_000
#: Each round shortens the longest way to a component's smallest id by a factor; an unfinished answer is never returned.
ROUNDS = 100


def _contract(batches):
    """The edges of one task to a star per component of these edges: (id, smallest id)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, component): the smallest id reachable, for every id with an edge.

    A task takes a bounded number of edges and replaces them by stars. While several tasks are
    needed, a large-star and a small-star round follow, which rewire nodes that occur in
    several tasks to smaller ids; each round is written to the shared folder. No edge: no row.
    """
    edges = edges.where("a <> b").select("a", "b")
    last, before = None, None
    for _ in range(ROUNDS):
        edges = C.stage(edges, "components")
        C.unstage(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
        tasks = -(-now[0] // EDGES_PER_TASK)
        edges = edges.coalesce(max(1, tasks)).mapInArrow(_contract, "a long, b long")
        if tasks <= 1:
            edges = C.stage(edges, "components")
            C.unstage(before)
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    else:
        raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
