"""Connected components of a graph given as edges, by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import drop_stored, stored


#: Edges of a task that reduces them to a forest, and that a worker takes in at a time.
TASK, TAKEN = 1_000_000, 1_000_000


def _reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find: each node with the smallest node it reaches, roots left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # hook larger roots to smaller ones, then flatten
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges; a worker holds that forest and TAKEN edges more."""
    u = v = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > TAKEN:
            u, v = _reduced(np.concatenate([u, *(x for x, _ in held)]), np.concatenate([v, *(y for _, y in held)]))
            held = []
    if held:
        u, v = _reduced(np.concatenate([u, *(x for x, _ in held)]), np.concatenate([v, *(y for _, y in held)]))
    for at in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(v[at : at + 100_000])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    Tasks first reduce their edges to forests, then as many tasks as there are millions of edges left do so again; if that is
    one, it has found the components. Else each round hangs a node's smaller neighbours on the smallest of
    them, and each node on its neighbour's own smallest one, until nothing changes (a few rounds more than the logarithm
    of the longest path). Edges are joined on their larger end, and on the smaller one only with nodes that have a
    smaller neighbour, which a root, the centre of a large star, has not: so no task gets a star. Rounds are stored in
    the shared folder, so no lineage grows and no lost executor breaks a later round; a round's folder goes when the next
    one stands. Only a count of a round gets to the driver.
    """
    named = edges.select(F.col(f"`{a}`").cast("long").alias("u"), F.col(f"`{b}`").cast("long").alias("v")).where("u <> v")
    kinds = "u long, v long"
    first = stored(named.mapInArrow(_forest, kinds), "edges")
    tasks = max(1, -(-first.count() // TASK))
    again = first.coalesce(tasks).mapInArrow(_forest, kinds)
    now = stored(again if tasks == 1 else again.distinct(), "edges")
    drop_stored(first)
    while tasks > 1:
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        hung = now.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (F.col("v") != F.col("m")).alias("new"))
        hung = hung.union(least.select("u", F.col("m").alias("v"), F.lit(False).alias("new")))
        hung = hung.groupBy("u", "v").agg(F.max("new").alias("new"))
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        higher = hung.select("v").distinct().join(least.withColumnRenamed("u", "v"), "v")
        jumped = hung.join(higher, "v", "left").select("u", F.coalesce("m", "v").alias("v"), (F.col("new") | F.col("m").isNotNull()).alias("new"))
        last, now = now, stored(jumped.groupBy("u", "v").agg(F.max("new").alias("new")), "edges")
        drop_stored(last)
        if not now.where("new").limit(1).count():
            break
        now = _kept(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _kept(now: DataFrame) -> DataFrame:
    """A round's edges without their marks."""
    out = now.select("u", "v")
    out.stored_at = now.stored_at
    return out
