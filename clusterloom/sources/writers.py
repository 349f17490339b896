"""Sinks: tables as CSV, JSON and Parquet, and the store of vectors and runs keyed by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterloom.sources import readers


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def run_record(rows: DataFrame, config: dict) -> DataFrame:
    """(config, labels, metrics): one row, the record of a run. rows: (label, generated, sem_sim, tok_f1); the score maps
    also have the mean of all labels. Fields that config has not are null."""
    kinds = StructType.fromDDL(readers.RUN)
    fields = [F.lit(config.get(f.name)).cast(f.dataType).alias(f.name) for f in kinds["config"].dataType.fields]

    def scores(column: str) -> Column:
        each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", column))))
        return F.map_concat(each, F.create_map(F.lit(readers.MEAN), F.avg(column)))

    names = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("generated")))))
    own = rows.select(F.col("label").cast("string").alias("label"), "generated", "sem_sim", "tok_f1")
    return own.agg(F.struct(*fields).alias("config"), names.alias("labels"), F.struct(scores("sem_sim").alias("semantic_similarity"), scores("tok_f1").alias("token_overlap_f1")).alias("metrics"))


def write_results(runs: DataFrame, best: dict, test: DataFrame, path: str) -> None:
    """The record of a finished sweep as one JSON object: dev_sweep, best_config, best_dev_metrics, test_result. runs: (run,
    record) of the sweep, test: the test run's record, best: the chosen parameters' config fields. A sweep is a few dozen runs."""
    dev = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "record")), lambda x, y: x["run"] - y["run"]), lambda x: x["record"]).alias("dev_sweep"))
    is_best = [F.col(f"x.config.{k}") == F.lit(v) for k, v in best.items()]
    chosen = dev.select(F.explode("dev_sweep").alias("x")).where(reduce(Column.__and__, is_best)).limit(1).select(F.col("x.metrics").alias("best_dev_metrics"))
    whole = dev.join(chosen).join(test.select(F.struct("config", "labels", "metrics").alias("test_result")))
    named = F.struct(*[F.lit(v).alias(k) for k, v in best.items()]).alias("best_config")
    whole.select(F.to_json(F.struct("dev_sweep", named, "best_dev_metrics", "test_result")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def content_key(docs: DataFrame, model: str) -> str:
    """A name for what was embedded: it changes with any id, text or the model, not with the order of rows."""
    row = docs.agg(F.count("*"), F.bit_xor(F.xxhash64("doc_id", "text")), F.sum(F.xxhash64("text", "doc_id").cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.sha256(repr((model, *row)).encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_vectors(docs: DataFrame, model: str, folder: str, embed) -> DataFrame:
    """(doc_id, embedding) from the store if these texts were embedded by this model before; else embed(docs), stored."""
    path = f"{folder.rstrip('/')}/{content_key(docs, model)}"
    spark = docs.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        embed(docs).select("doc_id", "embedding").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_run(rows: DataFrame, path: str) -> None:
    """Adds a run's rows to the checkpoint of a sweep."""
    rows.write.mode("append").parquet(path)


def missing_runs(grid: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The configurations of the grid that the checkpoint has not; they are matched by value, never by position."""
    spark = grid.sparkSession
    if not _exists(spark, path):
        return grid
    return grid.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
