"""Connected components: forests in every task, then alternating large-star and small-star rounds.

Edges point from a vertex to a smaller one. First each task replaces its edges by
stars of what they connect. If few are left (`ONE_TASK`), one task joins them. If
not, a large star connects the larger neighbours of each vertex to the smallest
neighbour, a small star connects the smaller ones and the vertex itself; after a
number of rounds that grows with the logarithm of the number of vertices every
vertex points at the smallest of its component. Minima are aggregated before they
are shuffled, so a hub is no burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import Workspace

#: Edges that one task joins, and vertices that a task holds at most.
ONE_TASK = 200_000
HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of the edges (u, v) with the smallest that they connect it to, in one star as long as a task can hold all."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, find(x)) for x in list(parent)]
        parent.clear()
        found = [(x, y) for x, y in found if x != y]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over edges (u, v) with u > v."""
    near = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least.hint("merge"), "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(work: Workspace, links: DataFrame, name: str = "edges", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    edges, turn = work.table(pairs.mapInArrow(_forest, "u long, v long"), f"{name}-0"), 0
    while edges.count() > one_task:
        turn += 1
        edges = work.table(_star(_star(edges, large=True), large=False), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        # done when the graph is a set of stars: no centre points at a smaller vertex
        centres = edges.select(F.col("v").alias("u")).distinct()
        if edges.join(centres.hint("merge"), "u", "left_semi").isEmpty():
            break
    else:
        edges = work.table(edges.coalesce(1).mapInArrow(_forest, "u long, v long"), f"{name}-joined")
        work.drop(f"{name}-{turn}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
