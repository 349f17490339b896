"""Similarity graphs: pairs of vectors whose cosine reaches a threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block; a task multiplies two blocks at a time.
BLOCK = 1024


def edges(vectors: DataFrame, threshold: float, label: str | None = "label", doc_id: str = "doc_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """([label,] src, dst, weight): src < dst, in the same cluster (or anywhere, if label is None), weight >= threshold.

    A cluster's vectors are cut into blocks; each goes to the pairs of its block with every other, where one matrix
    product finds the pairs that pass. So only passing pairs are rows, a task holds two blocks however large a cluster
    is, and a vector is copied once for each block. Rows without a label or a vector are left out.
    """
    by = ["label"] if label else []
    own = vectors.select(*([F.col(label).alias("label")] if label else []), F.col(doc_id).alias("doc_id"), F.col(vector).alias("v"))
    own = own.where(" and ".join(f"{c} is not null" for c in [*by, "v", "doc_id"]))
    if label:
        sizes = own.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        own = own.join(sizes, "label")
    else:
        own = own.withColumn("blocks", F.lit(max(1, -(-own.count() // block))))
    dealt = own.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*by, "doc_id", "v", "i", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))

    def multiply(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        v = np.array(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        at, x, y = table.column("i").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(at == x), np.flatnonzero(at == y)
        sims = v[left] @ v[right].T
        r, c = np.nonzero(sims >= threshold)
        a, b, w = ids[left[r]], ids[right[c]], sims[r, c]
        if x == y:
            once = a < b
            a, b, w = a[once], b[once], w[once]
        out = {"src": np.minimum(a, b), "dst": np.maximum(a, b), "weight": w}
        if by:
            kind = table.schema.field("label").type
            out = {"label": pa.array([table.column("label")[0].as_py()] * len(a), kind)} | out
        return pa.table(out)

    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"label {kinds['label']}" for _ in by), f"src {kinds['doc_id']}", f"dst {kinds['doc_id']}", "weight double"])
    return dealt.groupBy(*by, "x", "y").applyInArrow(multiply, schema)


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    back = {"src": "dst", "dst": "src"}
    return pairs.unionAll(pairs.select(*[F.col(back.get(c, c)).alias(c) for c in pairs.columns]))


def at_least(pairs: DataFrame, threshold: float) -> DataFrame:
    """The graph at a higher threshold: no vector is compared again."""
    return pairs.where(F.col("weight") >= threshold)


def counts(nodes: DataFrame, pairs: DataFrame, label: str = "label") -> DataFrame:
    """(label, n_nodes, n_edges) of every cluster, also those without edges."""
    n = nodes.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_nodes"))
    e = pairs.groupBy("label").agg(F.count("*").alias("n_edges"))
    return n.join(e, "label", "left").select("label", "n_nodes", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their 1-based rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
