"""Command line: python -m clusterloom COMMAND --help. Run it with spark-submit on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clusterloom.operators import analysis, graph, quality
from clusterloom.plans import reports, runs
from clusterloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="clusterloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, corpus: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=what)
        if corpus:
            one.add_argument("--dataset", default="parquet", choices=sorted(readers.LOADERS))
            one.add_argument("--path", required=True, help="where the corpus lies")
        one.add_argument("--output", required=True, help="folder to write to")
        one.add_argument("--seed", type=int, default=42)
        return one

    command("stats", "statistics of a corpus and of its clusters")
    q = command("quality", "five measures of each cluster")
    q.add_argument("--k", type=int, default=10)
    for name, default in (("medoid-sample", 2000), ("max-sample", 500), ("max-docs-kl", 200), ("max-pairs-kl", 500), ("max-sample-nmrd", 200)):
        q.add_argument(f"--{name}", type=int, default=default)
    s = command("sweep", "every combination on the dev split, the best one on the test split")
    s.add_argument("--grid", choices=("short", "full"), default="full")
    c = command("subclusters", "labels from the medoids of each cluster's parts")
    c.add_argument("--counts", type=int, nargs="+", default=[4])
    c.add_argument("--baseline", help="results of a sweep to compare with")
    g = command("graph", "nodes and edges of the whole corpus")
    g.add_argument("--threshold", type=float, default=0.5)
    r = command("correlations", "quality measures against test scores", corpus=False)
    r.add_argument("--quality", nargs="+", required=True, help="NAME=FILE of each dataset's measures")
    r.add_argument("--results", nargs="+", required=True, help="NAME=FILE of each dataset's results")
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"clusterloom {a.command}").getOrCreate()
    at = a.output.rstrip("/")
    if a.command == "correlations":
        scored = by_dataset(spark, a.results, readers.read_test_scores).withColumnRenamed("label", "cluster")
        table = runs.correlation_table(by_dataset(spark, a.quality, readers.read_quality), scored)
        writers.write_csv(table, f"{at}/correlations")
        reports.correlation_lines(table).show(1000, truncate=False)
        return
    docs = readers.require(readers.load(spark, a.dataset, a.path), "text", "label")
    cfg = runs.Config(dataset=a.dataset, cache_dir=f"{at}/cache")
    if a.command == "stats":
        writers.write_csv(analysis.corpus_statistics(docs), f"{at}/corpus")
        writers.write_csv(analysis.cluster_statistics(docs), f"{at}/clusters")
        return
    vectors = runs.vectors_of(docs, cfg)
    if a.command == "quality":
        sizes = {k: getattr(a, k) for k in ("k", "medoid_sample", "max_sample", "max_docs_kl", "max_pairs_kl", "max_sample_nmrd")}
        found = quality.measures(docs, vectors, seed=a.seed, **sizes)
        writers.write_csv(found, f"{at}/quality")
        reports.quality_table(spark.read.csv(f"{at}/quality", header=True, inferSchema=True)).show(1000, truncate=False)
    elif a.command == "sweep":
        found = runs.sweep(spark, cfg, docs, vectors, at, runs.SHORT if a.grid == "short" else runs.FULL, seed=a.seed)
        found["dev"].orderBy("run").show(1000)
        found["test"].show(1000, truncate=False)
    elif a.command == "subclusters":
        found = runs.subcluster_run(docs, vectors, cfg, a.counts, seed=a.seed)
        if a.baseline and (before := readers.read_test_scores(spark, a.baseline)) is not None:
            found = found.join(before.select("label", *[before[m].alias(f"baseline_{m}") for m in runs.METRICS]), "label", "left")
        writers.write_csv(found, f"{at}/subclusters")
    elif a.command == "graph":
        writers.write_csv(reports.graph_nodes(docs), f"{at}/nodes")
        writers.write_csv(graph.edges(vectors, a.threshold, label=None), f"{at}/edges")


def by_dataset(spark: SparkSession, named: list[str], read):
    """The tables of NAME=FILE arguments, each row with its dataset; files that don't exist are left out."""
    from pyspark.sql import functions as F

    out = None
    for one in named:
        name, _, path = one.partition("=")
        if (table := read(spark, path)) is not None:
            table = table.withColumn("dataset", F.lit(name))
            out = table if out is None else out.unionByName(table)
    if out is None:
        raise SystemExit("none of the files exists")
    return out


if __name__ == "__main__":
    main()
