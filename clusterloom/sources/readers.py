"""Sources by name, and readers of each format. Every corpus is (doc_id, text, label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.text import is_not_blank
from clusterloom.storage import stored

#: Fields of the records that runs are kept in: fixed values, so that such files can be read.
_CONFIG = (
    "STRUCT<dataset: STRING, split: STRING, embedding_model: STRING, embedding_batch_size: INT, embedding_device: STRING, similarity_threshold: DOUBLE,"
    " chunk_size: INT, top_k: INT, pagerank_alpha: DOUBLE, labeling_model: STRING, max_doc_words: INT, cache_dir: STRING, use_cache: BOOLEAN, output_dir: STRING>"
)
_METRICS = "STRUCT<semantic_similarity: MAP<STRING, DOUBLE>, token_overlap_f1: MAP<STRING, DOUBLE>>"
_LABELS = "MAP<STRING, STRUCT<generated: STRING>>"
RUN = f"config {_CONFIG}, labels {_LABELS}, metrics {_METRICS}"
_RUN = f"STRUCT<config: {_CONFIG}, labels: {_LABELS}, metrics: {_METRICS}>"
RESULTS = f"dev_sweep ARRAY<{_RUN}>, best_config {_CONFIG}, best_dev_metrics {_METRICS}, test_result {_RUN}"
QUALITY = "MAP<STRING, STRUCT<voorhees_nn: DOUBLE, overlap: DOUBLE, kl_divergence: DOUBLE, density: DOUBLE, nmrd: DOUBLE>>"
#: The key under which score maps keep their mean.
MEAN = "__mean__"
#: Names of the integer labels of a four-topic news corpus, in order.
NEWS_TOPICS = ("World", "Sports", "Business", "Sci/Tech")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with doc_id: ids follow the given order without one task sorting everything, by counts of its ranges.

    Ranges are stored once, so that ids stay the same when a task runs again.
    """
    places = [f"_o{i}" for i in range(len(order))]
    placed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), *[F.col(c).alias(p) for c, p in zip(order, places)])
    # The driver samples the ranges' keys, so no long text is one.
    keys = [F.substring(p, 1, 64) if dict(placed.dtypes)[p] == "string" else F.col(p) for p in places]
    ranged = stored(placed.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*places))
    return ranged.withColumn("at", at).join(F.broadcast(before), "_p").withColumn("doc_id", (F.col("before") + F.col("at") - 1).cast("long")).select("doc_id", "row.*")


def read_csv(spark: SparkSession, path: str, null: str | None = "") -> DataFrame:
    """A CSV corpus with header; quoted texts may hold newlines and doubled quotes. ``null``: what stands for null."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue=null or "\x00", emptyValue="")


def read_text_tree(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, label): a row for each <label>/<name>.txt, in order of path; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    rows = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))
    return numbered(rows, "path").select("doc_id", "text", "label")


def read_parquet(spark: SparkSession, path: str, text: str = "text", label: str = "label", names: tuple[str, ...] = (), doc_id: str | None = None, drop_blank: bool = False) -> DataFrame:
    """(doc_id, text, label) of a table; names turns integer labels to words, unknown ones to null."""
    df = spark.read.parquet(path)
    named = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])[F.col(label).cast("int")] if names else F.col(label)
    own = df.select(*([F.col(doc_id).alias("doc_id")] if doc_id else []), F.col(text).alias("text"), named.alias("label"))
    own = own.where(is_not_blank(F.col("text"))) if drop_blank else own
    return own if doc_id else numbered(own, "label", "text").select("doc_id", "text", "label")


#: Lines of a post that quote another one, or introduce a quotation: fixed values, so that the same lines go.
QUOTED = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def without_headers(post: Column) -> Column:
    """What follows the first blank line; nothing if there is none."""
    at = F.locate("\n\n", post)
    return F.when(at > 0, F.substring(post, at + 2, F.length(post))).otherwise("")


def without_quotes(post: Column) -> Column:
    return F.array_join(F.filter(F.split(post, "\n"), lambda x: ~x.rlike(QUOTED)), "\n")


def without_footer(post: Column) -> Column:
    """The post up to its last line that is blank or of hyphens only, if that isn't the first: a signature follows there."""
    lines = F.split(F.regexp_replace(post, r"^\s+|\s+$", ""), "\n")
    breaks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"^\s*-*\s*$"))
    last = F.coalesce(F.array_max(breaks), F.lit(0))
    return F.when(last > 0, F.array_join(F.slice(lines, 1, last), "\n")).otherwise(post)


def read_posts(spark: SparkSession, path: str, subset: str = "all", strip: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, label) of a table of forum posts: text, label and, for subsets, subset (train or test). strip: without
    headers, quotations and footers. Posts of which nothing is left go."""
    if subset not in ("all", "train", "test"):
        raise ValueError(f"subset is all, train or test, not {subset}")
    df = spark.read.parquet(path)
    df = df if subset == "all" else df.where(F.col("subset") == subset)
    label = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])[F.col("label").cast("int")] if names else F.col("label")
    text = without_footer(without_quotes(without_headers(F.col("text")))) if strip else F.col("text")
    own = df.select(*(["doc_id"] if "doc_id" in df.columns else []), text.alias("text"), label.alias("label")).where(is_not_blank(F.col("text")))
    return own if "doc_id" in own.columns else numbered(own, "label", "text").select("doc_id", "text", "label")


Loader = Callable[[SparkSession, str], DataFrame]
#: Corpora by name; a user's own can be added.
LOADERS: dict[str, Loader] = {
    "csv_articles": lambda s, p: numbered(read_csv(s, p), "label", "text").select("doc_id", "text", "label"),
    "text_tree": read_text_tree,
    "forum_posts": read_posts,
    "news_topics": lambda s, p: read_parquet(s, p, names=NEWS_TOPICS),
    "intents": lambda s, p: read_parquet(s, p, label="label_text"),
    "parquet": read_parquet,
}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"no corpus is named {name}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has these columns and a row."""
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def _scores(column: str) -> Column:
    return F.map_filter(F.col(column), lambda k, v: k != MEAN)


def read_sweep(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """(dataset, threshold, top_k, alpha, sem_sim, tok_f1, sem_by_label, f1_by_label): a row for each run of a sweep's file."""
    runs = spark.read.schema(RUN).json(path, multiLine=True)
    sem, f1 = "metrics.semantic_similarity", "metrics.token_overlap_f1"
    return runs.select(
        (F.lit(dataset) if dataset else F.col("config.dataset")).alias("dataset"),
        F.col("config.similarity_threshold").alias("threshold"),
        F.col("config.top_k").alias("top_k"),
        F.col("config.pagerank_alpha").alias("alpha"),
        F.col(sem)[MEAN].alias("sem_sim"),
        F.col(f1)[MEAN].alias("tok_f1"),
        _scores(sem).alias("sem_by_label"),
        _scores(f1).alias("f1_by_label"),
    )


def by_label(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., label, sem_sim, tok_f1) of each run's maps; tok_f1 may be null."""
    return runs.select(*keys, "f1_by_label", F.explode("sem_by_label").alias("label", "sem_sim")).select(*keys, "label", "sem_sim", F.col("f1_by_label")[F.col("label")].alias("tok_f1"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The record of a finished sweep: dev_sweep, best_config, best_dev_metrics, test_result; None if there is no such file."""
    return spark.read.schema(RESULTS).json(path, multiLine=True) if _exists(spark, path) else None


def read_test_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """(label, sem_sim, tok_f1) of the test result; None if there is no such file."""
    whole = read_results(spark, path)
    if whole is None:
        return None
    r = whole.select(_scores("test_result.metrics.semantic_similarity").alias("sem_by_label"), _scores("test_result.metrics.token_overlap_f1").alias("f1_by_label"))
    return by_label(r)


def read_quality(spark: SparkSession, path: str) -> DataFrame | None:
    """(cluster, five measures), lower-is-better divergence negated; None if there is no such file."""
    if not _exists(spark, path):
        return None
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", QUALITY).alias("m")).select(F.explode("m").alias("cluster", "q"))
    return whole.select("cluster", "q.*").withColumn("kl_divergence", -F.col("kl_divergence"))
