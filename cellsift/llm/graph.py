"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import part_of, spread_join, written

#: Edges that a task holds at a time.
HELD = 1 << 20


def components(edges: DataFrame, forest: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """node, root: the least node each node is connected with; only nodes that have edges.

    forest: what was found for the edges before; edges are added to it. Every task first contracts the edges
    it has. Then come alternating large and small stars: every node hands its least neighbour on to its
    larger ones, then to its smaller ones, until only stars are left, in a number of rounds that grows with
    the logarithm of the longest path. Neighbourhoods are never gathered, only their minimum is, and a node's
    edges are dealt to several tasks, so a node may have any number.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if forest is not None:
        now = now.union(forest.select(F.col("node").alias("u"), F.col("root").alias("v")))
    now = kept(now, held)
    while not stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", part_of("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(large.where("u <> v").distinct(), "edges")
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(now, least, "u", part_of("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = kept(small, held)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())


def kept(edges: DataFrame, held: int) -> DataFrame:
    """Edges (u > v) with the same components, written; each run of about `held` edges of a task as stars."""

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[pa.RecordBatch] = []
        for batch in batches:
            run += [batch.slice(i, held) for i in range(0, batch.num_rows, held)]
            if sum(x.num_rows for x in run) >= held:
                yield starred(run)
                run = []
        if run:
            yield starred(run)

    return written(edges.where("u <> v").distinct().mapInArrow(contracted, "u long, v long").distinct(), "edges")


def stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down or only edges up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()


def starred(run: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Stars around the least node of each component of the edges."""
    u, v = (np.concatenate([x.column(c).to_numpy() for x in run]) for c in ("u", "v"))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root < np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["u", "v"])
