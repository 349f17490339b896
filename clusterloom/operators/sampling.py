"""Deterministic samples and splits: rows in the order of a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_key(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def sample(df: DataFrame, label: str, doc_id: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each cluster, uniformly without replacement; the same ones every time."""
    w = Window.partitionBy(label).orderBy(order_key(seed, F.col(doc_id)), doc_id)
    return df.where(F.col(label).isNotNull()).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= cap).drop("_at")


def first_of_others(df: DataFrame, label: str, doc_id: str, k: int, order: Column) -> DataFrame:
    """(own_label, row's columns): for each cluster, the first k rows of all others by an order.

    No cluster needs more than k rows of any other, nor more than 2k in all, of which at most k are its own: so the
    candidates are 2k rows, which are broadcast.
    """
    known = df.where(F.col(label).isNotNull())
    capped = known.withColumn("_o", order).withColumn("_at", F.row_number().over(Window.partitionBy(label).orderBy("_o", doc_id))).where(F.col("_at") <= k)
    few = capped.orderBy("_o", doc_id).limit(2 * k).drop("_at")
    labels = known.select(F.col(label).alias("own_label")).distinct()
    both = labels.join(F.broadcast(few), F.col("own_label") != F.col(label))
    w = Window.partitionBy("own_label").orderBy("_o", doc_id)
    return both.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).drop("_at", "_o")


def stratified_split(df: DataFrame, label: str, doc_id: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with a column split, dev or test: ceil(share * n) rows are test, in proportion to the clusters.

    A cluster gets the whole part of its share; what is left goes by largest remainder, ties by label. Rows without a
    label are left out.
    """
    known = df.where(F.col(label).isNotNull())
    sizes = known.groupBy(label).agg(F.count("*").alias("c"))
    whole = sizes.agg(F.sum("c").alias("n"))
    want = sizes.join(F.broadcast(whole)).withColumn("want", F.ceil(F.lit(test_share) * F.col("n")) * F.col("c") / F.col("n"))
    want = want.withColumns({"quota": F.floor("want").cast("long"), "rest": F.round(F.col("want") - F.floor("want"), 9)})
    left = F.ceil(F.lit(test_share) * F.col("n")) - F.sum("quota").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy().orderBy(F.col("rest").desc(), label))  # one row a cluster
    quotas = want.withColumns({"left": left, "at": order}).select(label, (F.col("quota") + (F.col("at") <= F.col("left")).cast("long")).alias("quota"))
    # Where each cluster's quota falls among 65,536 ranges of the order: whole ranges go to either side, and only the one
    # that the quota cuts is sorted. So no task sorts a cluster.
    key = order_key(seed, F.col(doc_id))
    placed = known.withColumns({"_key": key, "_range": F.substring(key, 1, 4)})
    upto = F.sum("c").over(Window.partitionBy(label).orderBy("_range"))
    ranges = placed.groupBy(label, "_range").agg(F.count("*").alias("c")).withColumn("upto", upto).join(quotas, label)
    cuts = ranges.where("quota > upto - c and quota <= upto").select(label, F.col("_range").alias("_cut"), (F.col("quota") - F.col("upto") + F.col("c")).alias("_left"))
    both = placed.join(cuts, label, "left")
    at = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_key", doc_id))
    inside = both.where(F.col("_range") == F.col("_cut")).withColumn("split", F.when(at <= F.col("_left"), "test").otherwise("dev"))
    outside = both.where(F.col("_cut").isNull() | (F.col("_range") != F.col("_cut"))).withColumn("split", F.when(F.col("_range") < F.col("_cut"), "test").otherwise("dev"))
    extra = ("_key", "_range", "_cut", "_left")
    return outside.drop(*extra).unionByName(inside.drop(*extra))
