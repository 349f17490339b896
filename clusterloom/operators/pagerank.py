"""Weighted PageRank inside every cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.graph import symmetric, top
from clusterloom.storage import drop_stored, stored

#: Clusters of more nodes or edges than this don't go into one task.
MAX_NODES, MAX_EDGES = 100_000, 5_000_000


def _kernel(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float, tol: float | None, most: int) -> np.ndarray:
    n = len(nodes)
    a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    out = np.bincount(a, w, n)
    lost = out == 0
    share = w / np.where(lost, 1, out)[a]
    x = np.full(n, 1 / n)
    for _ in range(most):
        new = alpha * np.bincount(b, share * x[a], n) + (alpha * x[lost].sum() + 1 - alpha) / n
        change, x = np.abs(new - x).sum(), new
        if tol is not None and change < n * tol:
            break
    return x


def _grouped(nodes: DataFrame, pairs: DataFrame, alpha: float, tol: float | None, most: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        if not len(ids):
            return left.select(["label", "doc_id"]).append_column("pagerank_score", pa.array([], pa.float64()))
        x = _kernel(ids[order], *(right.column(c).to_numpy() for c in ("src", "dst", "weight")), alpha, tol, most)
        return left.select(["label", "doc_id"]).take(pa.array(order)).append_column("pagerank_score", pa.array(x))

    kinds = dict(nodes.dtypes)
    schema = f"label {kinds['label']}, doc_id {kinds['doc_id']}, pagerank_score double"
    return nodes.groupBy("label").cogroup(pairs.groupBy("label")).applyInArrow(run, schema)


def by_dataframes(nodes: DataFrame, pairs: DataFrame, alpha: float = 0.85, tol: float | None = 1e-6, most: int = 1000) -> DataFrame:
    """The same recurrence as joins and sums over all clusters at once, for clusters of any size.

    Each step shuffles ranks by node; the mass of nodes without edges is summed by cluster. Each step's ranks are
    stored, since the next one reads them several times, and dropped once the next step's are; clusters that have
    converged keep their ranks. Only whether any cluster still moves gets to the driver.
    """
    both = symmetric(pairs)
    out = both.groupBy("label", "src").agg(F.sum("weight").alias("out"))
    moves = stored(both.join(out, ["label", "src"]).select("label", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "moves")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    bare = out.select("label", F.col("src").alias("doc_id"), F.lit(False).alias("lost"))
    ranks = nodes.join(sizes, "label").join(bare, ["label", "doc_id"], "left").select("label", "doc_id", "n", F.coalesce("lost", F.lit(True)).alias("lost"), (1 / F.col("n")).alias("x"), F.lit(False).alias("still"))
    ranks = stored(ranks, "ranks")
    for _ in range(most):
        sent = moves.join(ranks.select("label", F.col("doc_id").alias("src"), "x"), ["label", "src"]).groupBy("label", F.col("dst").alias("doc_id")).agg(F.sum(F.col("share") * F.col("x")).alias("got"))
        lost = ranks.groupBy("label").agg(F.sum(F.when(F.col("lost"), F.col("x")).otherwise(0.0)).alias("mass"))
        new = alpha * F.coalesce("got", F.lit(0.0)) + (alpha * F.col("mass") + 1 - alpha) / F.col("n")
        moved = ranks.join(sent, ["label", "doc_id"], "left").join(lost, "label").select("label", "doc_id", "n", "lost", F.when(F.col("still"), F.col("x")).otherwise(new).alias("x"), "still", F.abs(new - F.col("x")).alias("change"))
        if tol is not None:
            done = moved.groupBy("label").agg((F.sum("change") < F.first("n") * tol).alias("done"))
            moved = moved.join(done, "label").withColumn("still", F.col("still") | F.col("done"))
        last, ranks = ranks, stored(moved.select("label", "doc_id", "n", "lost", "x", "still"), "ranks")
        drop_stored(last)
        if tol is not None and ranks.where("not still").isEmpty():
            break
    drop_stored(moves)
    return ranks.select("label", "doc_id", F.col("x").alias("pagerank_score"))


def pagerank(nodes: DataFrame, pairs: DataFrame, alpha: float = 0.85, tol: float | None = 1e-6, most: int = 1000) -> DataFrame:
    """(label, doc_id, pagerank_score): ranks sum to 1 in each cluster. nodes: (label, doc_id); pairs: edges().

    Starts from 1/n; a node without edges gives its rank to all alike; ends once the changes of a cluster sum to less
    than n * tol, after ``most`` steps at the latest; tol None: after just as many. Clusters that fit a task are ranked
    in one; larger ones by joins.
    """
    nodes = nodes.select("label", "doc_id").where("label is not null and doc_id is not null")
    pairs = stored(pairs, "pairs")  # read for the sizes and for the ranks; comparing vectors once is enough
    n = nodes.groupBy("label").agg(F.count("*").alias("n")).join(pairs.groupBy("label").agg(F.count("*").alias("e")), "label", "left")
    large = n.where((F.col("n") > MAX_NODES) | (F.col("e") > MAX_EDGES)).select("label")
    if large.isEmpty():
        return _grouped(nodes, pairs, alpha, tol, most)
    fits = [df.join(large, "label", "left_anti") for df in (nodes, pairs)]
    rest = [df.join(large, "label", "left_semi") for df in (nodes, pairs)]
    return _grouped(*fits, alpha, tol, most).unionByName(by_dataframes(*rest, alpha, tol, most))


def central(ranks: DataFrame, k: int) -> DataFrame:
    """(label, rank, doc_id, pagerank_score): the k best of each cluster; ties go to the smaller id."""
    return top(ranks, ["label"], [F.round("pagerank_score", 12).desc(), F.col("doc_id")], k).select("label", "rank", "doc_id", "pagerank_score")
