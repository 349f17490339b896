"""The data behind charts, and tables for the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.text import shown

MEASURES = ("voorhees_nn", "overlap", "kl_divergence", "density", "nmrd")
#: Names to display; measures and metrics without one are shown as they are.
NAMES = {"voorhees_nn": "Voorhees", "overlap": "Overlap", "kl_divergence": "KL divergence", "density": "Density", "nmrd": "nMRD", "sem_sim": "Semantic similarity", "tok_f1": "Token F1"}
#: Colours of a corpus graph.
COLOURS = 20


def test_means(scored: DataFrame) -> DataFrame:
    """(dataset, sem_sim, tok_f1): the two bars of each dataset. scored: (dataset, label, sem_sim, tok_f1)."""
    return scored.groupBy("dataset").agg(F.avg("sem_sim").alias("sem_sim"), F.avg("tok_f1").alias("tok_f1"))


def score_strip(scored: DataFrame, by_score: bool = True) -> DataFrame:
    """(dataset, n, mean, position, label, sem_sim): a cell for each cluster, the best first, or in order of label."""
    order = [F.desc("sem_sim"), F.col("label")] if by_score else [F.col("label")]
    whole = Window.partitionBy("dataset")
    return scored.select("dataset", F.count("*").over(whole).alias("n"), F.avg("sem_sim").over(whole).alias("mean"), F.row_number().over(whole.orderBy(*order)).alias("position"), "label", "sem_sim")


def graph_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, label, text, colour): the nodes of a corpus graph; colours follow the sorted labels and repeat."""
    own = docs.select("doc_id", F.col("label").cast("string").alias("label"), "text").where("label is not null")
    names = own.select("label").distinct()
    colour = names.withColumn("colour", F.pmod(F.row_number().over(Window.orderBy("label")) - 1, F.lit(COLOURS)))  # a row for each label
    return own.join(F.broadcast(colour), "label").select("doc_id", "label", "text", "colour")


def _number(value: Column, form: str) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit("-")).otherwise(F.format_string(form, value))


def quality_table(quality: DataFrame) -> DataFrame:
    """(cluster, five measures) as text with four decimals, a missing one as a hyphen; last, the mean of those there are."""
    mean = quality.agg(*[F.avg(m).alias(m) for m in MEASURES]).select(F.lit("MEAN").alias("cluster"), F.lit(1).alias("last"), *MEASURES)
    rows = quality.select(F.col("cluster").cast("string").alias("cluster"), F.lit(0).alias("last"), *MEASURES).unionByName(mean)
    return rows.orderBy("last", "cluster").select("cluster", *[_number(F.col(m), "%.4f").alias(m) for m in MEASURES])


def correlation_lines(table: DataFrame, level: float = 0.05) -> DataFrame:
    """The correlation table as text in its order: signed r with a star where p is below the level."""

    def r(name: str) -> Column:
        return F.concat(_number(F.col(f"{name}_r"), "%+.3f"), F.when(F.col(f"{name}_p") < level, F.lit(" *")).otherwise(F.lit("")))

    parts = [x for n in ("pearson", "spearman") for x in (r(n).alias(f"{n}_r"), _number(F.col(f"{n}_p"), "%.4f").alias(f"{n}_p"))]
    return table.orderBy("dataset", "metric", "measure").select("dataset", shown(F.col("measure"), NAMES).alias("measure"), shown(F.col("metric"), NAMES).alias("metric"), "n", *parts)
