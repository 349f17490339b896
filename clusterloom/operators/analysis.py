"""Statistics over sweeps, splits and corpora: the data behind each report and chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions import text as T
from clusterloom.operators.graph import top

#: A sweep's flat row: dataset, threshold, top_k, alpha, sem_sim, tok_f1.
PARAMS = ("threshold", "top_k", "alpha")


def grid(spark: SparkSession, thresholds, top_ks, alphas) -> DataFrame:
    """(run, threshold, top_k, alpha): all combinations, the threshold outermost; run counts from 0."""
    rows = [(i, float(t), int(k), float(a)) for i, (t, k, a) in enumerate((t, k, a) for t in thresholds for k in top_ks for a in alphas)]
    return spark.createDataFrame(rows, "run int, threshold double, top_k int, alpha double")


def best_runs(sweep: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The best run of each dataset by sem_sim; of equals the first in the order given."""
    return top(sweep, ["dataset"], [F.col("sem_sim").desc(), *(F.col(c) for c in order or PARAMS)], 1, "_at").drop("_at")


def ranked(sweep: DataFrame) -> DataFrame:
    """Runs with their 1-based rank by sem_sim; ties by the parameters."""
    return sweep.withColumn("rank", F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("sem_sim").desc(), *PARAMS)))


def long_params(sweep: DataFrame) -> DataFrame:
    """(dataset, param, value, sem_sim, tok_f1): a row for each run and parameter."""
    return sweep.select("dataset", "sem_sim", "tok_f1", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in PARAMS])).alias("p")).select("dataset", "p.param", "p.value", "sem_sim", "tok_f1")


def effects(sweep: DataFrame) -> DataFrame:
    """(dataset, param, value, sem_sim, tok_f1): means over the runs with that value."""
    return long_params(sweep).groupBy("dataset", "param", "value").agg(F.avg("sem_sim").alias("sem_sim"), F.avg("tok_f1").alias("tok_f1"))


def variance_ratios(sweep: DataFrame) -> DataFrame:
    """(dataset, param, variance_ratio): variance of the means by value over that of all runs; none if that is 0."""
    total = sweep.groupBy("dataset").agg(F.var_samp("sem_sim").alias("total")).where("total > 0")
    between = effects(sweep).groupBy("dataset", "param").agg(F.var_samp("sem_sim").alias("between"))
    return between.join(total, "dataset").select("dataset", "param", (F.col("between") / F.col("total")).alias("variance_ratio"))


def pivoted(long: DataFrame, by: str, column: str, value: str, names: list[str]) -> DataFrame:
    return long.groupBy(by).pivot(column, names).agg(F.first(value))


def most_impactful(sweep: DataFrame) -> DataFrame:
    """(dataset, param, variance_ratio) of the largest ratio; ties by the parameters' usual order."""
    order = F.array_position(F.array(*[F.lit(p) for p in PARAMS]), F.col("param"))
    return top(variance_ratios(sweep), ["dataset"], [F.round("variance_ratio", 12).desc(), order], 1, "_at").drop("_at")


def spread(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("dataset").agg(F.min("sem_sim").alias("low"), F.max("sem_sim").alias("high"), F.stddev_samp("sem_sim").alias("std"), (F.max("sem_sim") - F.min("sem_sim")).alias("span"), F.count("*").alias("runs"))


def quartiles(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("dataset").agg(F.percentile("sem_sim", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select("dataset", *[F.get("q", i).alias(f"q{i + 1}") for i in range(3)])


def votes(sweep: DataFrame) -> DataFrame:
    """(param, value, votes): the value that most datasets' best runs have; ties go to the dataset first in order."""
    chosen = long_params(best_runs(sweep))
    counted = chosen.groupBy("param", "value").agg(F.count("*").alias("votes"), F.min("dataset").alias("first"))
    return top(counted, ["param"], [F.col("votes").desc(), F.col("first")], 1, "_at").select("param", "value", "votes")


def extremes(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(by..., best, best_value, worst, worst_value): ties go to the smaller key."""
    high = top(df, by, [F.col(value).desc(), F.col(key)], 1, "_at").select(*by, F.col(key).alias("best"), F.col(value).alias("best_value"))
    low = top(df, by, [F.col(value), F.col(key)], 1, "_at").select(*by, F.col(key).alias("worst"), F.col(value).alias("worst_value"))
    return high.join(low, by) if by else high.join(low)


def gaps(results: DataFrame) -> DataFrame:
    """(dataset, dev, test, gap, direction) from (dataset, dev, test)."""
    return results.select("dataset", "dev", "test", (F.col("dev") - F.col("test")).alias("gap"), F.when(F.col("dev") > F.col("test"), "overfit").otherwise("underfit").alias("direction"))


def label_comparison(dev: DataFrame, test: DataFrame) -> DataFrame:
    """(label, dev_label, test_label): dev labels with the test labels of the same clusters, a dash where none is."""
    return dev.select("label", F.col("generated").alias("dev_label")).join(test.select("label", F.col("generated").alias("test_label")), "label", "left").withColumn("test_label", F.coalesce("test_label", F.lit("—")))


def low_f1_advice(scored: DataFrame, limit: float = 0.1) -> DataFrame:
    return scored.agg(F.avg("tok_f1").alias("mean_f1")).withColumn("low", F.coalesce(F.col("mean_f1") < limit, F.lit(False)))


def find_run(sweep: DataFrame, config: DataFrame) -> DataFrame:
    """The sweep's first row with each configuration's parameters."""
    return sweep.join(config.select("dataset", *PARAMS), ["dataset", *PARAMS], "left_semi").dropDuplicates(["dataset", *PARAMS])


def deltas(sweep: DataFrame, baseline: DataFrame) -> DataFrame:
    """(n_subclusters, sem_sim, delta): means of each number of parts against the baseline's, a one-row table."""
    base = baseline.agg(F.avg("sem_sim").alias("base"))
    return sweep.groupBy("n_subclusters").agg(F.avg("sem_sim").alias("sem_sim")).join(F.broadcast(base)).select("n_subclusters", "sem_sim", (F.col("sem_sim") - F.col("base")).alias("delta"))


def _lengths(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"_words": T.word_count(F.col(text)), "_chars": F.char_length(F.col(text)).cast("long")})


def corpus_statistics(docs: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """One row: documents, clusters, imbalance (largest over smallest cluster), and mean, standard deviation, median,
    least and most words and characters."""
    sizes = docs.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.count("*").alias("n_clusters"), (F.max("count") / F.min("count")).alias("imbalance"))
    out = _lengths(docs, text).agg(F.count("*").alias("n_docs"), *[f(c).alias(f"{n}{c}") for c in ("_words", "_chars") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median), ("min", F.min), ("max", F.max))])
    return out.join(F.broadcast(sizes))


def cluster_statistics(docs: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """(label, n_docs, share, mean_words, std_words, min_words, max_words, mean_chars) of every cluster."""
    sized = _lengths(docs.where(F.col(label).isNotNull()), text)
    each = sized.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_docs"), F.avg("_words").alias("mean_words"), F.stddev_samp("_words").alias("std_words"), F.min("_words").alias("min_words"), F.max("_words").alias("max_words"), F.avg("_chars").alias("mean_chars"))
    total = each.agg(F.sum("n_docs").alias("all"))
    return each.join(F.broadcast(total)).withColumn("share", 100 * F.col("n_docs") / F.col("all")).drop("all")


def significant(table: DataFrame, p: str = "pearson_p", limit: float = 0.05) -> Column:
    return F.when(F.col(p) < limit, F.lit("*")).otherwise(F.lit(""))
