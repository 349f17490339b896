"""Expressions over ARRAY<FLOAT> vectors; sums are in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine of unit vectors."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def sums(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by..., pos, total, n): element-wise sums of each group's vectors, a row for each place."""
    return df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))


def sum_vectors(df: DataFrame, by: list[str], vector: str = "embedding", name: str = "total") -> DataFrame:
    """(by..., name): the element-wise sum as one array."""
    return sums(df, by, vector).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"]).alias(name))
