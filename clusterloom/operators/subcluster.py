"""K-Means inside clusters, and the medoids of the parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vectors import dot, sum_vectors
from clusterloom.operators.graph import top
from clusterloom.storage import stored

#: Clusters of more documents go to Spark's own K-Means.
MAX_DOCS = 200_000


def centroids(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by..., centroid): the mean vector of each group."""
    n = vectors.groupBy(*by).agg(F.count("*").alias("n"))
    return sum_vectors(vectors, by).join(n, by).select(*by, F.expr("transform(total, x -> x / n)").alias("centroid"))


def nearest_to_centroid(vectors: DataFrame, by: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(by..., doc_id, sim): the document with the largest product with its group's mean; ties go to the smaller id."""
    both = vectors.join(centroids(vectors, by), by).withColumn("sim", dot(F.col("embedding"), F.col("centroid")))
    return top(both, by, [F.round("sim", 10).desc(), F.col(doc_id)], 1).select(*by, doc_id, "sim")


def _lloyd(v: np.ndarray, k: int, seed: int, starts: int, most: int = 300) -> np.ndarray:
    best, least = np.zeros(len(v), np.int64), np.inf
    squares = (v * v).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(starts):
        chosen = [int(rng.integers(len(v)))]
        far = np.maximum(0, squares + squares[chosen[0]] - 2 * v @ v[chosen[0]])
        while len(chosen) < k:
            weight = far.sum()
            i = int(rng.choice(len(v), p=far / weight)) if weight > 0 else next(i for i in range(len(v)) if i not in chosen)
            chosen.append(i)
            far = np.minimum(far, np.maximum(0, squares + squares[i] - 2 * v @ v[i]))
        c, of = v[chosen], None
        for _ in range(most):
            d = squares[:, None] + (c * c).sum(axis=1)[None, :] - 2 * v @ c.T
            new = d.argmin(axis=1)
            if of is not None and (new == of).all():
                break
            of = new
            for j in range(k):
                own = of == j
                if own.any():
                    c[j] = v[own].mean(axis=0)
                else:  # an empty part takes the document that is worst off
                    i = int(d[np.arange(len(v)), of].argmax())
                    c[j], of[i] = v[i], j
        cost = float((squares[:, None] + (c * c).sum(axis=1)[None, :] - 2 * v @ c.T)[np.arange(len(v)), of].sum())
        if cost < least - 1e-12:
            best, least = of, cost
    return best


def kmeans(vectors: DataFrame, c: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """(label, doc_id, embedding, subcluster_id): parts of each cluster, as many as it has documents if fewer than c.

    vectors: (label, doc_id, embedding). The best of ``starts`` runs counts, whatever a cluster's size: clusters of up to
    MAX_DOCS documents are parted in one task, larger ones by Spark's distributed K-Means, which takes each in turn.
    """
    own = vectors.select("label", "doc_id", "embedding").where("label is not null and embedding is not null")
    kinds = dict(own.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        v = np.array(table.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        return table.append_column("subcluster_id", pa.array(_lloyd(v, min(c, len(v)), seed, starts), pa.int32()))

    large = own.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > MAX_DOCS).select("label")
    schema = f"label {kinds['label']}, doc_id {kinds['doc_id']}, embedding {kinds['embedding']}, subcluster_id int"
    out = own.join(large, "label", "left_anti").select("label", "doc_id", "embedding").groupBy("label").applyInArrow(run, schema)
    for r in large.toLocalIterator():
        out = out.unionByName(_distributed(own.where(F.col("label") == r["label"]), c, seed, starts))
    return out


def _distributed(part: DataFrame, c: int, seed: int, starts: int) -> DataFrame:
    """The best of several runs of Spark's K-Means on one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = stored(part.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))), "vectors")
    models = [KMeans(k=c, seed=seed + i, featuresCol="features", predictionCol="subcluster_id").fit(rows) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("features")


def subcluster_medoids(vectors: DataFrame, docs: DataFrame | None = None, c: int = 4, seed: int = 42) -> DataFrame:
    """(label, subcluster_id, doc_id[, text]): the document nearest to each part's mean; c = 1 is the whole cluster."""
    if c == 1:
        found = nearest_to_centroid(vectors, ["label"]).withColumn("subcluster_id", F.lit(0))
    else:
        found = nearest_to_centroid(kmeans(vectors, c, seed), ["label", "subcluster_id"])
    found = found.select("label", "subcluster_id", "doc_id")
    return found.join(docs.select("doc_id", "text"), "doc_id", "left").select("label", "subcluster_id", "doc_id", "text") if docs is not None else found
