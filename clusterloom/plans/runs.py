"""Whole runs: one configuration, a sweep with resume, all corpora, sub-clusters, and correlations."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions.stats import correlations
from clusterloom.operators import analysis, graph, labels, pagerank, sampling, subcluster
from clusterloom.sources import readers, writers
from clusterloom.storage import drop_stored, stored


@dataclass(frozen=True)
class Config:
    dataset: str = "csv_articles"
    split: str = ""
    embedding_model: str = "hashed"
    similarity_threshold: float = 0.5
    top_k: int = 10
    pagerank_alpha: float = 0.85
    labelling_model: str = "extractive"
    max_doc_words: int = 300
    cache_dir: str = "cache"
    use_cache: bool = True
    output_dir: str = "results"


#: Grids of the short and the full sweep.
SHORT = {"thresholds": (0.3, 0.5, 0.7), "top_ks": (5, 10, 15), "alphas": (0.85,)}
FULL = {"thresholds": (0.3, 0.5, 0.7), "top_ks": (3, 5, 10), "alphas": (0.5, 0.85, 0.95)}
MEASURES = ("voorhees_nn", "overlap", "kl_divergence", "density", "nmrd")
METRICS = ("sem_sim", "tok_f1")


def vectors_of(docs: DataFrame, cfg: Config, embedder: labels.Embedder | None = None) -> DataFrame:
    """(label, doc_id, embedding): embedded, or from the store."""
    embed = embedder or labels.hashed_embedder()
    fresh = lambda d: embed(d, "text")
    found = writers.cached_vectors(docs, cfg.embedding_model, cfg.cache_dir, fresh) if cfg.use_cache else fresh(docs).select("doc_id", "embedding")
    return docs.select("doc_id", "label").join(found, "doc_id")


def central_documents(docs: DataFrame, vectors: DataFrame, cfg: Config, pairs: DataFrame | None = None) -> DataFrame:
    """(label, rank, doc_id, text, pagerank_score)."""
    pairs = graph.edges(vectors, cfg.similarity_threshold) if pairs is None else graph.at_least(pairs, cfg.similarity_threshold)
    best = pagerank.central(pagerank.pagerank(vectors, pairs, cfg.pagerank_alpha), cfg.top_k)
    return best.join(docs.select("doc_id", "text"), "doc_id", "left").select("label", "rank", "doc_id", "text", "pagerank_score")


def name_clusters(central: DataFrame, cfg: Config, labeller: labels.Labeller | None = None) -> DataFrame:
    """(label, generated): by the labeller, or offline by the terms that mark the chosen documents."""
    if labeller is None:
        return labels.extractive(central)
    return labels.labelled(labels.prompts(central, cfg.max_doc_words, labels.TEMPLATE), labeller)


def run(spark: SparkSession, cfg: Config, docs: DataFrame | None = None, vectors: DataFrame | None = None, path: str | None = None, labeller: labels.Labeller | None = None, embedder: labels.Embedder | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(label, generated, sem_sim, tok_f1) of one configuration."""
    docs = readers.load(spark, cfg.dataset, path or cfg.dataset) if docs is None else docs
    vectors = vectors_of(docs, cfg, embedder) if vectors is None else vectors
    named = name_clusters(central_documents(docs, vectors, cfg, pairs), cfg, labeller)
    return named.withColumn("label", F.col("label").cast("string")).join(labels.scores(named, embedder), "label")


def fields(cfg: Config) -> dict:
    """A configuration under the names that records have."""
    named = asdict(cfg)
    return named | {"labeling_model": named.pop("labelling_model")}


def sweep(spark: SparkSession, cfg: Config, docs: DataFrame, vectors: DataFrame, folder: str, grid: dict = FULL, labeller=None, embedder=None, seed: int = 42) -> dict:
    """Scores every combination on the dev split, keeps each as it comes, scores the best one on the test split, and
    writes the whole as results.json in the folder.

    Similarities are compared once, at the lowest threshold. Finished combinations are known by their parameters, so a
    grid may change between calls. The result: dev (a row for each run), best (its Config), test (rows of run()).
    """
    split = sampling.stratified_split(docs, "label", "doc_id", 0.2, seed)
    dev, test = (split.where(F.col("split") == s).drop("split") for s in ("dev", "test"))
    on = {"dev": vectors.join(dev.select("doc_id"), "doc_id", "left_semi"), "test": vectors.join(test.select("doc_id"), "doc_id", "left_semi")}
    todo = analysis.grid(spark, **grid).withColumn("dataset", F.lit(cfg.dataset))
    keys, at = ["dataset", *analysis.PARAMS], f"{folder.rstrip('/')}/dev_sweep"
    pairs = None
    for r in writers.missing_runs(todo, at, keys).orderBy("run").collect():  # a row for each combination
        if pairs is None:
            pairs = stored(graph.edges(on["dev"], min(grid["thresholds"])), "pairs")
        one = replace(cfg, split="dev", similarity_threshold=r["threshold"], top_k=r["top_k"], pagerank_alpha=r["alpha"])
        record = writers.run_record(run(spark, one, dev, on["dev"], labeller=labeller, embedder=embedder, pairs=pairs), fields(one))
        config = {"dataset": cfg.dataset, "threshold": r["threshold"], "top_k": r["top_k"], "alpha": r["alpha"]}
        mean = lambda m: F.col(f"metrics.{m}")[readers.MEAN]
        means = (mean("semantic_similarity").alias("sem_sim"), mean("token_overlap_f1").alias("tok_f1"))
        writers.append_run(record.select(*[F.lit(v).alias(k) for k, v in config.items()], *means, F.struct("config", "labels", "metrics").alias("record")), at)
    if pairs is not None:
        drop_stored(pairs)
    done = spark.read.parquet(at).join(todo.select("run", *keys), keys)
    best = analysis.best_runs(done.drop("record"), ["run"]).first()
    chosen = replace(cfg, split="test", similarity_threshold=best["threshold"], top_k=best["top_k"], pagerank_alpha=best["alpha"])
    tested = stored(run(spark, chosen, test, on["test"], labeller=labeller, embedder=embedder), "test")
    named = {"similarity_threshold": best["threshold"], "top_k": best["top_k"], "pagerank_alpha": best["alpha"]}
    writers.write_results(done.select("run", "record"), named, writers.run_record(tested, fields(chosen)), f"{folder.rstrip('/')}/results.json")
    return {"dev": done.drop("record"), "best": chosen, "test": tested}


def full_sweep(spark: SparkSession, cfg: Config, corpora: dict[str, tuple[DataFrame, DataFrame]], folder: str, **how) -> dict[str, dict]:
    """sweep() of each corpus; runs that a folder has already are not done again."""
    return {name: sweep(spark, replace(cfg, dataset=name), docs, vectors, f"{folder.rstrip('/')}/{name}", **how) for name, (docs, vectors) in corpora.items()}


def subcluster_run(docs: DataFrame, vectors: DataFrame, cfg: Config, counts=(4,), labeller=None, embedder=None, seed: int = 42) -> DataFrame:
    """(n_subclusters, label, generated, sem_sim, tok_f1) with the parts' medoids as context, for each number of parts."""
    out = None
    for c in counts:
        found = subcluster.subcluster_medoids(vectors, docs, c, seed).withColumn("rank", F.col("subcluster_id") + 1)
        named = name_clusters(found, cfg, labeller)
        one = named.withColumn("label", F.col("label").cast("string")).join(labels.scores(named, embedder), "label").withColumn("n_subclusters", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def correlation_table(quality: DataFrame, scored: DataFrame) -> DataFrame:
    """(dataset, measure, metric, n, pearson_r, pearson_p, spearman_r, spearman_p). quality: (dataset, cluster, five
    measures), scored: (dataset, cluster, sem_sim, tok_f1); rounded to 3 and 4 decimals as reported."""
    both = quality.join(scored, ["dataset", "cluster"])
    long = both.select("dataset", *METRICS, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES])).alias("m"))
    long = long.select("dataset", "m.measure", "m.x", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in METRICS])).alias("y"))
    table = correlations(long.select("dataset", "measure", "y.metric", "x", "y.y"), ["dataset", "measure", "metric"])
    table = table.orderBy("dataset", "metric", "measure")  # as it is reported; a row for each dataset, measure and metric
    return table.select("dataset", "measure", "metric", "n", *[F.bround(c, 3 if c.endswith("_r") else 4).alias(c) for c in ("pearson_r", "pearson_p", "spearman_r", "spearman_p")])


def as_row(spark: SparkSession, cfg: Config) -> DataFrame:
    return spark.createDataFrame([asdict(cfg)])
