"""Queries that write files from the driver's tables to the shared folder and read them back, whole runs, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions import text as T
from clusterloom.functions.vectors import dot, normalized
from clusterloom.operators import analysis, labels, pagerank, quality
from clusterloom.operators import graph as graphs
from clusterloom.plans import catalogue as C
from clusterloom.plans import reports, runs
from clusterloom.sources import readers, writers
from clusterloom.storage import shared_dir

#: Parameters of the run whose graph has no edges: then the first documents of each cluster are its central ones.
EDGELESS, FIRST = 0.999, 3


def _sized(df: DataFrame, column: str) -> DataFrame:
    """An embedder that SQL can follow: characters and occurrences of e, one more each."""
    c = F.coalesce(F.col(column), F.lit(""))
    e = F.char_length(c) - F.char_length(F.replace(c, F.lit("e"), F.lit("")))
    return df.withColumn("embedding", normalized(F.array((F.char_length(c) + 1).cast("double"), (e + 1).cast("double"))))


def _length_sql(t: str) -> str:
    return f"[length({t}) + 1.0::DOUBLE, length({t}) - length(replace({t}, 'e', '')) + 1.0::DOUBLE]"


def _sim_sql(a: str, b: str) -> str:
    x, y = _length_sql(a), _length_sql(b)
    return f"list_dot_product({x}, {y}) / sqrt(list_dot_product({x}, {x}) * list_dot_product({y}, {y}))"


# --- corpora


def csv_articles(spark, d):
    path = shared_dir(spark, "csv")
    writers.write_csv(C.docs(spark, d).select("text", "label"), path)
    return readers.load(spark, "csv_articles", path)


def text_tree(spark, d):
    """A file for each language: its documents' numbers, a line each."""
    path = shared_dir(spark, "tree")
    lines = C.docs(spark, d, "lang").groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n").alias("value"))
    lines.repartition("label").write.partitionBy("label").text(path)
    return readers.load(spark, "text_tree", path).select("doc_id", "text", F.replace("label", F.lit("label="), F.lit("")).alias("label"))


HEAD, TAIL = "From: a@b.c\nSubject: it\n\n", "\n> a quoted line\nSomebody wrote:\n--\nName of the writer"


def forum_posts(spark, d):
    path = shared_dir(spark, "posts")
    posts = C.docs(spark, d, "lang").select("doc_id", F.concat(F.lit(HEAD), "text", F.lit(TAIL)).alias("text"), "label", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("subset"))
    posts.write.parquet(path)
    return readers.read_posts(spark, path, "train")


def vector_store(spark, d):
    """The second call finds what the first one stored."""
    folder, docs = shared_dir(spark, "store"), C.docs(spark, d)
    writers.cached_vectors(docs, "sized", folder, lambda x: _sized(x, "text"))
    found = writers.cached_vectors(docs, "sized", folder, None)
    return found.select("doc_id", F.round(F.get("embedding", 0), 6).alias("first"))


# --- records of sweeps and measures


def _run_rows(spark, d, dataset: str):
    """(threshold, rows) of three runs of a dataset: two labels with scores around the run's."""
    s = C.sweep_rows(spark, d).where((F.col("dataset") == dataset) & (F.col("top_k") == 5) & (F.col("alpha") == 0.85))
    sides = F.explode(F.array(F.struct(F.lit("left").alias("label"), F.lit(0.05).alias("by")), F.struct(F.lit("right").alias("label"), F.lit(-0.01).alias("by")))).alias("x")
    rows = s.select("threshold", F.concat("dataset", F.lit(" named")).alias("generated"), "sem_sim", "tok_f1", sides)
    rows = rows.select("threshold", "x.label", "generated", (F.col("sem_sim") + F.col("x.by")).alias("sem_sim"), "tok_f1")
    return [(t, rows.where(F.col("threshold") == t)) for t in C.THRESHOLDS]


def _written_results(spark, d, dataset: str) -> str:
    path, found = f"{shared_dir(spark, 'results')}/results.json", None
    config = {"dataset": dataset, "top_k": 5, "pagerank_alpha": 0.85}
    for i, (t, rows) in enumerate(_run_rows(spark, d, dataset)):
        record = writers.run_record(rows, config | {"similarity_threshold": t, "split": "dev"})
        one = record.select(F.lit(i).alias("run"), F.struct("config", "labels", "metrics").alias("record"))
        found = one if found is None else found.unionByName(one)
    test = writers.run_record(_run_rows(spark, d, dataset)[1][1], config | {"similarity_threshold": C.THRESHOLDS[1], "split": "test"})
    writers.write_results(found, {"similarity_threshold": C.THRESHOLDS[1], "top_k": 5, "pagerank_alpha": 0.85}, test, path)
    return path


def results_record(spark, d):
    """The runs of a sweep as its record keeps them, and whether each is the best one."""
    r = readers.read_results(spark, _written_results(spark, d, "c0"))
    x, m = r.select(F.explode("dev_sweep").alias("x"), "best_config", "best_dev_metrics"), "semantic_similarity"
    best = F.col("best_config.similarity_threshold") == F.col("x.config.similarity_threshold")
    return x.select(
        F.col("x.config.similarity_threshold").alias("threshold"), F.col("x.config.top_k").alias("top_k"), F.col("x.labels")["left"]["generated"].alias("generated"),
        F.round(F.col(f"x.metrics.{m}")[readers.MEAN], 6).alias("sem_sim"), best.alias("best"), F.round(F.col(f"best_dev_metrics.{m}")["left"], 6).alias("best_left"),
    )


def test_scores(spark, d):
    return C.rounded(readers.read_test_scores(spark, _written_results(spark, d, "c0")), sem_sim=6, tok_f1=6)


def no_baseline(spark, d):
    """A baseline that isn't there is none: the sub-clusters' scores stand without it."""
    found, path = None, f"{shared_dir(spark, 'none')}/results.json"
    before = readers.read_test_scores(spark, path)
    found = C.sweep_rows(spark, d).where("top_k = 3 and alpha = 0.5")
    return C.rounded(found.select("dataset", "threshold", "sem_sim", F.lit(before is not None).alias("has_baseline")), sem_sim=6)


def sweep_file(spark, d):
    """Runs in a sweep's file, an array of records: flat, and by label."""
    path, found = f"{shared_dir(spark, 'sweep')}/sweep.json", None
    for t, rows in _run_rows(spark, d, "c1"):
        one = writers.run_record(rows, {"dataset": "c1", "similarity_threshold": t, "top_k": 5, "pagerank_alpha": 0.85})
        found = one if found is None else found.unionByName(one)
    found.agg(F.to_json(F.collect_list(F.struct("config", "labels", "metrics"))).alias("value")).write.text(path)
    return C.rounded(readers.by_label(readers.read_sweep(spark, path), "dataset", "threshold", "top_k", "alpha"), sem_sim=6, tok_f1=6)


def sweep_resume(spark, d):
    """What is left of the grid once the runs of one top_k are done."""
    path, s = f"{shared_dir(spark, 'resume')}/runs", C.sweep_rows(spark, d)
    writers.append_run(s.where("dataset = 'c0' and top_k = 5"), path)
    return writers.missing_runs(s.select("dataset", "threshold", "top_k", "alpha"), path, ["dataset", *analysis.PARAMS])


def _measures(spark, d):
    """Measures of each source: density, and two that stand for others."""
    own = C.docs(spark, d)
    rest = own.groupBy("label").agg(F.round(F.avg(F.char_length("text")) / 10000, 9).alias("voorhees_nn"), (F.count("*") * 0.5).alias("kl_divergence"))
    found = quality.density(own).join(rest, "label").withColumnRenamed("label", "cluster")
    return found.select("cluster", "voorhees_nn", F.lit(None).cast("double").alias("overlap"), "kl_divergence", "density", F.lit(None).cast("double").alias("nmrd"))


def quality_file(spark, d):
    path = f"{shared_dir(spark, 'quality')}/quality.json"
    own = _measures(spark, d)
    own.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct(*reports.MEASURES))))).alias("value")).coalesce(1).write.text(path)
    return C.rounded(readers.read_quality(spark, path), voorhees_nn=6, kl_divergence=6, density=8)


def quality_lines(spark, d):
    return reports.quality_table(_measures(spark, d))


# --- runs


def run_edgeless(spark, d):
    cfg = runs.Config(similarity_threshold=EDGELESS, top_k=FIRST)
    return C.rounded(runs.run(spark, cfg, C.paired_docs(spark, d), C.vectors(spark, d), embedder=_sized), sem_sim=6, tok_f1=6)


def subcluster_run(spark, d):
    cfg = runs.Config()
    out = runs.subcluster_run(C.paired_docs(spark, d), C.vectors(spark, d).join(C.docs(spark, d).select("doc_id"), "doc_id", "left_semi"), cfg, (1,), embedder=_sized)
    return C.rounded(out, sem_sim=6, tok_f1=6)


def label_scores(spark, d):
    return C.rounded(labels.scores(labels.extractive(C.docs(spark, d)), _sized), sem_sim=6, tok_f1=6)


def label_scores_mean(spark, d):
    return C.rounded(labels.mean_scores(labels.scores(labels.extractive(C.docs(spark, d)), _sized)), sem_sim=6, tok_f1=6)


def pagerank_converged(spark, d):
    """PageRank that ends by its own rule."""
    v = C.vectors(spark, d)
    return C.rounded(pagerank.pagerank(v, graphs.edges(v, C.THRESHOLD), 0.5, tol=1e-13), pagerank_score=8)


def _scored(spark, d):
    m = C._measured(spark, d)
    q = m.select("dataset", "cluster", F.col("mean_words").alias("voorhees_nn"), F.col("n_docs").alias("overlap"), F.col("mean_line").alias("kl_divergence"), (F.col("mean_words") / F.col("mean_line")).alias("density"), F.lit(None).cast("double").alias("nmrd"))
    return q, m.select("dataset", "cluster", F.col("mean_chars").alias("sem_sim"), (F.col("mean_chars") / F.col("mean_words")).alias("tok_f1"))


def run_correlations(spark, d):
    return runs.correlation_table(*_scored(spark, d))


def correlation_report(spark, d):
    return reports.correlation_lines(run_correlations(spark, d)).select("dataset", "measure", "metric", "n")


# --- charts


def _by_label(spark, d):
    s = labels.scores(labels.extractive(C.docs(spark, d)), _sized)
    return s.withColumn("dataset", F.when(F.col("label") < "src5", "low").otherwise("high"))


def test_bars(spark, d):
    return C.rounded(reports.test_means(_by_label(spark, d)), sem_sim=6, tok_f1=6)


def score_strip(spark, d):
    rows = _by_label(spark, d).withColumn("sem_sim", F.round("sem_sim", 6))
    return C.rounded(reports.score_strip(rows), mean=6)


def score_row(spark, d):
    rows = _by_label(spark, d).withColumn("sem_sim", F.round("sem_sim", 6))
    return C.rounded(reports.score_strip(rows, by_score=False), mean=6)


def graph_nodes(spark, d):
    return reports.graph_nodes(C.docs(spark, d))


def shown_names(spark, d):
    return C.docs(spark, d, "lang").select("doc_id", T.shown(F.col("label"), {"en": "English", "fr": "French"}).alias("label"))


def embedded_cosines(spark, d):
    """Texts embedded by a user's model, loaded once a worker: the cosine of each text to its own first line."""

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t) + 1, t.count("e") + 1] for t in texts], dtype=np.float64)

    embed = labels.model_embedder(load, batch=64)
    own = embed(C.docs(spark, d), "text").withColumnRenamed("embedding", "a").withColumn("line", F.get(F.split("text", "\n"), 0))
    both = embed(own, "line")
    return both.select("doc_id", F.round(dot(F.col("a"), F.col("embedding")), 6).alias("sem_sim"))


def queries() -> dict:
    own = (
        csv_articles, text_tree, forum_posts, vector_store, results_record, test_scores, no_baseline, sweep_file, sweep_resume, quality_file, quality_lines, run_edgeless, subcluster_run, label_scores,
        label_scores_mean, pagerank_converged, run_correlations, correlation_report, test_bars, score_strip, score_row, graph_nodes, shown_names, embedded_cosines,
    )
    return {f.__name__: f for f in own}


# --- SQL

_RUNS = "r AS (SELECT dataset, threshold, top_k, alpha, sem_sim, tok_f1, x.label, sem_sim + x.plus AS s FROM sw, (VALUES ('left', 0.05::DOUBLE), ('right', -0.01::DOUBLE)) x(label, plus) WHERE top_k = 5 AND alpha = 0.85::DOUBLE)"
_MEASURES = """q AS (SELECT den.label AS cluster, voorhees_nn, kl_divergence, density FROM den JOIN
  (SELECT source AS label, round(avg(length(text)) / 10000, 9) AS voorhees_nn, count(*) * 0.5::DOUBLE AS kl_divergence FROM documents GROUP BY source) USING (label))"""


def _named_sql(rows: str) -> str:
    """ex: the marking terms of the documents of each cluster in ``rows`` (label, text)."""
    return C._EXTRACT.replace("source AS label", "label").replace("SELECT source,", "SELECT label,").replace("FROM documents", f"FROM {rows}")


def oracle_sql() -> dict[str, str]:
    f1, sim = C._f1_sql("label", "generated"), _sim_sql("label", "generated")
    scored = f"sc AS (SELECT label, {sim} AS sem_sim, {f1} AS tok_f1 FROM (SELECT label::VARCHAR AS label, generated FROM ex))"
    by_label = f"WITH {C._EXTRACT}, {scored}, b AS (SELECT CASE WHEN label < 'src5' THEN 'low' ELSE 'high' END AS dataset, label, round(sem_sim, 6) AS sem_sim, tok_f1 FROM sc)"
    strip = "SELECT dataset, count(*) OVER (PARTITION BY dataset) AS n, round(avg(sem_sim) OVER (PARTITION BY dataset), 6) AS mean, (row_number() OVER (PARTITION BY dataset ORDER BY {o}))::INT AS position, label, sem_sim FROM b"
    run = f"{scored} SELECT ex.label::VARCHAR AS label, generated, round(sem_sim, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1"
    head, tail = (x.replace("\n", "' || chr(10) || '") for x in (HEAD, TAIL))
    number = lambda c: f"coalesce(printf('%.4f', {c}), '-') AS {c}"
    measure = "dataset, cluster, x.m AS measure, CASE x.m WHEN 'voorhees_nn' THEN mean_words WHEN 'overlap' THEN n_docs WHEN 'kl_divergence' THEN mean_line ELSE mean_words / mean_line END AS x"
    table = f"""WITH {C._MEASURE.split('lo AS')[0]} lo AS (SELECT {measure}, y.m AS metric, CASE y.m WHEN 'sem_sim' THEN mean_chars ELSE mean_chars / mean_words END AS y
  FROM me, (VALUES ('voorhees_nn'), ('overlap'), ('kl_divergence'), ('density')) x(m), (VALUES ('sem_sim'), ('tok_f1')) y(m)),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset, measure, metric ORDER BY x) + (count(*) OVER (PARTITION BY dataset, measure, metric, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY dataset, measure, metric ORDER BY y) + (count(*) OVER (PARTITION BY dataset, measure, metric, y) - 1) / 2.0::DOUBLE AS ry FROM lo),
co AS (SELECT dataset, measure, metric, count(*) AS n, corr(x, y) AS pr, corr(rx, ry) AS sr FROM rk GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)"""
    p = lambda r: C._p_sql(r).replace(", 6)", ", 4)")
    shown = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.NAMES.items()) + " END"
    nearest = C.oracle_sql()["nearest_to_centroid"].replace("WITH v AS (SELECT label, vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings)", "WITH v AS (SELECT label, vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id)")
    return {
        "csv_articles": "SELECT row_number() OVER (ORDER BY source, text) - 1 AS doc_id, text, source AS label FROM documents",
        "text_tree": "SELECT row_number() OVER (ORDER BY lang) - 1 AS doc_id, string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10) AS text, lang AS label FROM documents GROUP BY lang",
        "forum_posts": f"""WITH p AS (SELECT doc_id, lang, '{head}' || text || '{tail}' AS t FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id, lang, array_to_string(list_filter(string_split(substr(t, position(chr(10) || chr(10) IN t) + 2), chr(10)), lambda x: NOT regexp_matches(x, '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)')), chr(10)) AS t FROM p),
l AS (SELECT doc_id, lang, string_split(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), chr(10)) AS l FROM b),
e AS (SELECT doc_id, lang, l, list_max(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^\\s*-*\\s*$'))) AS last FROM l)
SELECT doc_id, array_to_string(l[1:last - 1], chr(10)) AS text, lang AS label FROM e WHERE regexp_matches(array_to_string(l[1:last - 1], chr(10)), '\\S')""",
        "vector_store": f"SELECT doc_id, round(({_length_sql('text')})[1] / sqrt(list_dot_product({_length_sql('text')}, {_length_sql('text')})), 6) AS first FROM documents",
        "results_record": f"WITH {C._SWEEP}, {_RUNS} SELECT threshold, any_value(top_k)::INT AS top_k, 'c0 named' AS generated, round(avg(s), 6) AS sem_sim, threshold = {C.THRESHOLDS[1]}::DOUBLE AS best, any_value((SELECT round(s, 6) FROM r WHERE dataset = 'c0' AND label = 'left' AND threshold = {C.THRESHOLDS[1]}::DOUBLE)) AS best_left FROM r WHERE dataset = 'c0' GROUP BY threshold",
        "test_scores": f"WITH {C._SWEEP}, {_RUNS} SELECT label, round(s, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1 FROM r WHERE dataset = 'c0' AND threshold = {C.THRESHOLDS[1]}::DOUBLE",
        "no_baseline": f"WITH {C._SWEEP} SELECT dataset, threshold, round(sem_sim, 6) AS sem_sim, false AS has_baseline FROM sw WHERE top_k = 3 AND alpha = 0.5::DOUBLE",
        "sweep_file": f"WITH {C._SWEEP}, {_RUNS} SELECT dataset, threshold, top_k::INT AS top_k, alpha, label, round(s, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1 FROM r WHERE dataset = 'c1'",
        "sweep_resume": f"WITH {C._SWEEP} SELECT dataset, threshold, top_k, alpha FROM sw WHERE NOT (dataset = 'c0' AND top_k = 5)",
        "quality_file": f"WITH d AS (SELECT doc_id, text, source AS label FROM documents), {C._density_sql('d')}, {_MEASURES} SELECT cluster, round(voorhees_nn, 6) AS voorhees_nn, NULL::DOUBLE AS overlap, round(-kl_divergence, 6) AS kl_divergence, round(density, 8) AS density, NULL::DOUBLE AS nmrd FROM q",
        "quality_lines": f"WITH d AS (SELECT doc_id, text, source AS label FROM documents), {C._density_sql('d')}, {_MEASURES}, m AS (SELECT cluster, voorhees_nn, kl_divergence, density FROM q UNION ALL SELECT 'MEAN', avg(voorhees_nn), avg(kl_divergence), avg(density) FROM q) SELECT cluster, {number('voorhees_nn')}, '-' AS overlap, {number('kl_divergence')}, {number('density')}, '-' AS nmrd FROM m",
        "run_edgeless": f"WITH {C._PAIRED}, ct AS (SELECT label, text FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS nth FROM (SELECT e.label, e.vec_id AS doc_id, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)) WHERE nth <= {FIRST}), {_named_sql('ct')}, {run} FROM ex JOIN sc ON sc.label = ex.label::VARCHAR",
        "subcluster_run": f"WITH ne AS ({nearest}), ct AS (SELECT ne.label, d.text FROM ne JOIN documents d USING (doc_id)), {_named_sql('ct')}, {run}, 1 AS n_subclusters FROM ex JOIN sc ON sc.label = ex.label::VARCHAR",
        "label_scores": f"WITH {C._EXTRACT}, {scored} SELECT label, round(sem_sim, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1 FROM sc",
        "label_scores_mean": f"WITH {C._EXTRACT}, {scored} SELECT round(avg(sem_sim), 6) AS sem_sim, round(avg(tok_f1), 6) AS tok_f1 FROM sc",
        "pagerank_converged": C._ranks_sql(0.5).replace(f"r.i < {C.STEPS}", "r.i < 60").replace(f"i = {C.STEPS})", "i = 60)") + "SELECT label, doc_id, round(pagerank_score, 8) AS pagerank_score FROM p",
        "run_correlations": f"{table} SELECT dataset, measure, metric, n, round_even(pr, 3) AS pearson_r, {p('pr')} AS pearson_p, round_even(sr, 3) AS spearman_r, {p('sr')} AS spearman_p FROM co",
        "correlation_report": f"{table} SELECT dataset, {shown.format(c='measure')} AS measure, {shown.format(c='metric')} AS metric, n FROM co",
        "test_bars": f"WITH {C._EXTRACT}, {scored} SELECT CASE WHEN label < 'src5' THEN 'low' ELSE 'high' END AS dataset, round(avg(sem_sim), 6) AS sem_sim, round(avg(tok_f1), 6) AS tok_f1 FROM sc GROUP BY 1",
        "score_strip": f"{by_label} {strip.format(o='sem_sim DESC, label')}",
        "score_row": f"{by_label} {strip.format(o='label')}",
        "graph_nodes": f"SELECT doc_id, source AS label, text, ((dense_rank() OVER (ORDER BY source) - 1) % {reports.COLOURS})::INT AS colour FROM documents",
        "shown_names": "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS label FROM documents",
        "embedded_cosines": f"SELECT doc_id, round({_sim_sql('text', 'line')}, 6) AS sem_sim FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents)",
    }
