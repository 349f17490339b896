"""Statistics as column expressions and grouped queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ideal_reciprocal(m: Column) -> Column:
    """H(m - 1) / (m - 1): the mean of reciprocal ranks when the other m - 1 members come first."""
    total = F.aggregate(F.sequence(F.lit(1), (m - 1).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    return F.when(m > 1, total / (m - 1))


def _series(count: Column, first: Column, ratio) -> Column:
    """Sum of count terms: first, then each the one before times ratio(its number from 1)."""
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    steps = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["total"] + a["term"]).alias("total")), lambda a: a["total"])


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r over n pairs, by Student's t with n - 2 degrees of freedom.

    The distribution's finite sums for whole degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4).
    """
    nu, s = n - 2, F.least(F.abs(r), F.lit(1.0))
    c2 = 1 - s * s
    even = 1 - s * _series(nu / 2, F.lit(1.0), lambda j: (2 * j - 1) / (2 * j) * c2)
    odd = 1 - 2 / math.pi * (F.asin(s) + s * _series((nu - 1) / 2, F.sqrt(c2), lambda j: (2 * j) / (2 * j + 1) * c2))
    return F.when(nu < 1, F.lit(None).cast("double")).when(s >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.when(nu % 2 == 0, even).otherwise(odd)))


def average_rank(by: list[str], value: str) -> Column:
    """1-based rank inside a group; ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlations(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by..., n, pearson_r, pearson_p, spearman_r, spearman_p) for each group.

    Pairs with a null are left out; so are groups of fewer than three pairs or with a constant side.
    """
    full = pairs.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(subset=["x", "y"])
    ranked = full.withColumns({"rx": average_rank(by, "x"), "ry": average_rank(by, "y")})
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.stddev_pop(c).alias(f"s_{c}") for c in ("x", "y", "rx", "ry")], F.covar_pop("x", "y").alias("c"), F.covar_pop("rx", "ry").alias("rc")
    ).where("n >= 3 and s_x > 0 and s_y > 0")
    # Not corr(), which fails on constant sides in ANSI mode before they can be left out.
    out = out.withColumns({"pearson_r": F.col("c") / (F.col("s_x") * F.col("s_y")), "spearman_r": F.col("rc") / (F.col("s_rx") * F.col("s_ry"))})
    return out.select(*by, "n", "pearson_r", p_value(F.col("pearson_r"), F.col("n")).alias("pearson_p"), "spearman_r", p_value(F.col("spearman_r"), F.col("n")).alias("spearman_p"))


def regression(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by..., slope, intercept) of the least-squares line; null if x is constant."""
    full = pairs.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(subset=["x", "y"])
    sums = full.groupBy(*by).agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.when(F.col("v") > 0, F.col("c") / F.col("v"))
    return sums.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def min_max(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] inside its group; a constant one is 0.5."""
    w = Window.partitionBy(*by)
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    return df.withColumns({c: F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).when(F.col(c).isNotNull(), F.lit(0.5)) for c in columns})
