"""The named queries over the driver's tables, with DuckDB SQL for each.

``embeddings`` are vectors with clusters (label), ``documents`` texts with clusters (source or lang); a vector's text is
the document of the same number. Floats are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import stats
from clusterloom.functions import text as T
from clusterloom.functions.vectors import dot, normalized
from clusterloom.operators import analysis, graph, labels, pagerank, quality, sampling, subcluster

#: Parameters of the graph queries: a threshold that leaves isolated nodes, and a fixed number of steps.
THRESHOLD, STEPS = 0.2, 30


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("vec_id").alias("doc_id"), "embedding")


def docs(spark: SparkSession, d: str, label: str = "source") -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.col(label).alias("label"))


def paired_docs(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the vectors, in the vectors' clusters."""
    return docs(spark, d).drop("label").join(vectors(spark, d).select("doc_id", "label"), "doc_id")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


# --- graphs and ranks


def edges_intra(spark, d):
    return rounded(graph.edges(vectors(spark, d), 0.1), weight=6)


def edges_symmetric(spark, d):
    return rounded(graph.symmetric(graph.edges(vectors(spark, d), THRESHOLD)), weight=6)


def edges_global(spark, d):
    return rounded(graph.edges(vectors(spark, d), 0.3, label=None), weight=6)


def graph_stats(spark, d):
    v = vectors(spark, d)
    return graph.counts(v, graph.edges(v, THRESHOLD))


def _ranks(spark, d, alpha=0.85):
    v = vectors(spark, d)
    return pagerank.pagerank(v, graph.edges(v, THRESHOLD), alpha, tol=None, most=STEPS)


def ranks(alpha):
    return lambda spark, d: rounded(_ranks(spark, d, alpha), pagerank_score=8)


def _central(spark, d):
    return pagerank.central(_ranks(spark, d), 5)


def central_docs(spark, d):
    return rounded(_central(spark, d), pagerank_score=8)


def central_docs_text(spark, d):
    return _central(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id", "left").select("label", "rank", "doc_id", "text")


def prompt_blocks(spark, d):
    return labels.prompts(central_docs_text(spark, d), max_words=12)


# --- quality measures


def voorhees(spark, d):
    return rounded(quality.voorhees(vectors(spark, d)), voorhees_nn=6)


def overlap(spark, d):
    return rounded(quality.overlap(vectors(spark, d)), overlap=6)


def nmrd(spark, d):
    return rounded(quality.nmrd(vectors(spark, d)), nmrd=6)


def medoids(spark, d):
    return rounded(quality.medoids(vectors(spark, d)).drop("embedding"), mean_sim=6)


def density(label):
    return lambda spark, d: rounded(quality.density(docs(spark, d, label)), density=8)


def kl_by_source(spark, d):
    return rounded(quality.kl_divergence(docs(spark, d)), kl_divergence=6)


def quality_wide(spark, d):
    out = quality.measures(paired_docs(spark, d), vectors(spark, d))
    return rounded(out, voorhees_nn=6, overlap=6, kl_divergence=6, density=8, nmrd=6)


def _quality_means(spark, d):
    return quality.measures(paired_docs(spark, d), vectors(spark, d)).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("voorhees_nn", "overlap", "kl_divergence", "density", "nmrd")])


# --- corpora


def dataset_stats(spark, d):
    out = analysis.corpus_statistics(docs(spark, d))
    names = {f"{n}_{c}": f"{n}_{c}" for c in ("words", "chars") for n in ("mean", "std", "median")}
    return rounded(out, imbalance=6, **{n: 5 for n in names})


def per_cluster_stats(spark, d):
    return rounded(analysis.cluster_statistics(docs(spark, d, "lang")), mean_words=5, std_words=5, mean_chars=5, share=6)


def nonblank_docs(spark, d):
    return docs(spark, d).where(T.is_not_blank(F.col("text"))).select("doc_id", "label")


def word_counts(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.char_length("text").cast("long").alias("n_chars"))


def token_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def truncated_texts(spark, d):
    return docs(spark, d).select("doc_id", T.truncated(F.col("text"), 40).alias("text"))


def label_names(spark, d):
    """Integer labels to names; numbers without a name are null."""
    names = ("World", "Sports", "Business", "Sci/Tech")
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    return vectors(spark, d).select("doc_id", m[F.col("label").cast("int")].alias("label"))


def stratified_split(spark, d):
    return sampling.stratified_split(docs(spark, d, "lang"), "label", "doc_id").select("doc_id", "label", "split")


def split_counts(spark, d):
    return stratified_split(spark, d).groupBy("label", "split").agg(F.count("*").alias("n"))


def cluster_sample(spark, d):
    return sampling.sample(docs(spark, d), "label", "doc_id", 20).select("doc_id", "label")


# --- sub-clusters


def centroids(spark, d):
    return subcluster.centroids(vectors(spark, d), ["label"]).select("label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


def nearest_to_centroid(spark, d):
    return rounded(subcluster.nearest_to_centroid(vectors(spark, d), ["label"]), sim=6)


def subcluster_medoids(spark, d):
    return subcluster.subcluster_medoids(vectors(spark, d), c=4)


def normalized_lengths(spark, d):
    v = normalized(F.transform("embedding", lambda x: x * 3))
    return vectors(spark, d).select("doc_id", F.round(dot(v, v), 6).alias("length"))


# --- labels

#: (truth, generated): names with separators, partial matches, and empty sides.
LABEL_PAIRS = (
    ("Sci/Tech", "Technology News"), ("sci.med", "Medical Sci"), ("age_limit", "Age Limit Questions"), ("Business", "business"),
    ("World", "World World Politics"), (".", "anything"), ("Sports", ""), ("card_payment_fee", "Fee card"), ("rec.sport.hockey", "Hockey Sport Rec"), ("Politics", "Harbour Budget Vote"),
)
MESSAGES = ("try again in 7.5s", "please try again in 12s.", "try again in 1m30s", "try again in 2m0.25s", "no idea", "")


def _label_pairs(spark):
    return spark.createDataFrame(list(LABEL_PAIRS), "label string, generated string")


def token_f1(spark, d):
    return _label_pairs(spark).select("label", F.round(T.token_f1(F.col("label"), F.col("generated")), 6).alias("tok_f1"))


def token_f1_mean(spark, d):
    return _label_pairs(spark).agg(F.round(F.avg(T.token_f1(F.col("label"), F.col("generated"))), 6).alias("tok_f1"))


def token_f1_docs(spark, d):
    """Documents' first words against their second line's, as labels of any length."""
    lines = docs(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.round(T.token_f1(F.coalesce(F.get("l", 0), F.lit("")), F.coalesce(F.get("l", 1), F.lit(""))), 6).alias("tok_f1"))


def retry_seconds(spark, d):
    return spark.createDataFrame([(m,) for m in MESSAGES], "message string").select("message", T.wait_seconds(F.col("message")).alias("seconds"))


def clean_labels(spark, d):
    rows = [(0, "  UK Policy \n"), (1, None), (2, "Sport")]
    return spark.createDataFrame(rows, "id int, label string").select("id", T.cleaned_label(F.col("label")).alias("label"))


def extractive_labels(spark, d):
    return labels.extractive(docs(spark, d))


def semantic_similarity_pairs(spark, d):
    v = vectors(spark, d)
    other = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("other"))
    return v.join(other, "doc_id").select("doc_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("sem_sim"))


def label_compare(spark, d):
    l = labels.extractive(docs(spark, d, "source"))  # noqa: E741
    dev = l.where("label < 'src5'")
    return analysis.label_comparison(dev, l.where("label >= 'src12'"))


# --- sweeps: 27 runs for each of four clusters, scored by their graphs

THRESHOLDS, TOP_KS, ALPHAS = (0.1, 0.15, 0.2), (3, 5, 10), (0.5, 0.85, 0.95)


def sweep_rows(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, threshold, top_k, alpha, sem_sim, tok_f1): the first four clusters of the vectors under 27 settings. The
    strongest edges at or above the threshold, weighed against it by alpha, stand for the one score, how few edges there are for the other."""

    def each(values, name):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    pairs = graph.edges(vectors(spark, d).where("label < 4"), min(THRESHOLDS))
    kept = pairs.select("*", each(THRESHOLDS, "threshold")).where("weight >= threshold")
    ranked = graph.top(kept, ["label", "threshold"], [F.round("weight", 10).desc(), F.col("src"), F.col("dst")], max(TOP_KS))
    sizes = kept.groupBy("label", "threshold").agg(F.count("*").alias("c"))
    means = ranked.select("*", each(TOP_KS, "top_k")).where("rank <= top_k").groupBy("label", "threshold", "top_k").agg(F.avg("weight").alias("m")).join(sizes, ["label", "threshold"])
    alpha = F.col("alpha")
    rows = means.select("*", each(ALPHAS, "alpha")).withColumn("sem_sim", F.round(F.col("m") * alpha + (1 - alpha) * F.col("threshold"), 9))
    return rows.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("dataset"), "threshold", "top_k", "alpha", "sem_sim", F.round(F.col("top_k") / (F.col("c") + 10.0), 9).alias("tok_f1"))


def sweep_grid(spark, d):
    return analysis.grid(spark, (0.3, 0.5, 0.7), (3, 5, 10), (0.5, 0.85, 0.95))


def sweep_edges(spark, d):
    """One comparison at the lowest threshold serves all."""
    pairs = graph.edges(vectors(spark, d), 0.1)
    steps = F.explode(F.filter(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3)]), lambda t: t <= F.col("weight"))).alias("threshold")
    return pairs.select("label", steps).groupBy("label", "threshold").agg(F.count("*").alias("n_edges"))


def sweep_best(spark, d):
    return rounded(analysis.best_runs(sweep_rows(spark, d)), sem_sim=6, tok_f1=6)


def hyperparam_effects(spark, d):
    return rounded(analysis.effects(sweep_rows(spark, d)), sem_sim=6, tok_f1=6)


def variance_ratio(spark, d):
    return rounded(analysis.variance_ratios(sweep_rows(spark, d)), variance_ratio=6)


def variance_pivot(spark, d):
    return rounded(analysis.pivoted(analysis.variance_ratios(sweep_rows(spark, d)), "dataset", "param", "variance_ratio", list(analysis.PARAMS)), threshold=6, top_k=6, alpha=6)


def most_impactful(spark, d):
    return rounded(analysis.most_impactful(sweep_rows(spark, d)), variance_ratio=6)


def sweep_rank(spark, d):
    return rounded(analysis.ranked(sweep_rows(spark, d)), sem_sim=6, tok_f1=6)


def sweep_spread(spark, d):
    return rounded(analysis.spread(sweep_rows(spark, d)), low=6, high=6, std=6, span=6)


def sweep_quantiles(spark, d):
    return rounded(analysis.quartiles(sweep_rows(spark, d)), q1=6, q2=6, q3=6)


def param_votes(spark, d):
    return analysis.votes(sweep_rows(spark, d))


def _results(spark, d):
    s = sweep_rows(spark, d)
    dev = analysis.best_runs(s).select("dataset", F.col("sem_sim").alias("dev"))
    return dev.join(s.groupBy("dataset").agg(F.avg("sem_sim").alias("test")), "dataset")


def dev_test_gap(spark, d):
    return rounded(analysis.gaps(_results(spark, d)), dev=6, test=6, gap=6)


def best_worst_dataset(spark, d):
    return rounded(analysis.extremes(_results(spark, d), [], "dataset", "test"), best_value=6, worst_value=6)


def best_worst_cluster(spark, d):
    sims = quality.mean_similarities(vectors(spark, d)).groupBy("label").agg(F.round(F.avg("mean_sim"), 6).alias("score"))
    return analysis.extremes(sims.withColumn("dataset", F.lit("vectors")), ["dataset"], "label", "score")


def low_f1(spark, d):
    return rounded(analysis.low_f1_advice(sweep_rows(spark, d)), mean_f1=6)


def found_runs(spark, d):
    s = sweep_rows(spark, d)
    return rounded(analysis.find_run(s, s.where("top_k = 5 and alpha = 0.85")), sem_sim=6, tok_f1=6)


def subcluster_delta(spark, d):
    s = sweep_rows(spark, d)
    return rounded(analysis.deltas(s.withColumnRenamed("top_k", "n_subclusters"), s.where("dataset = 'c0'")), sem_sim=6, delta=6)


# --- correlations: per language, statistics of its sources

MEASURED = ("mean_words", "n_docs", "mean_line")


def _measured(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("dataset"), F.col("source").alias("cluster"), T.word_count(F.col("text")).alias("w"), F.char_length("text").alias("c"), F.size(F.split("text", "\n")).alias("l"))
    return own.groupBy("dataset", "cluster").agg(F.round(F.avg("w"), 4).alias("mean_words"), F.count("*").cast("double").alias("n_docs"), F.round(F.avg(F.col("c") / F.col("l")), 4).alias("mean_line"), F.round(F.avg("c"), 4).alias("mean_chars"))


def _long(spark, d):
    return _measured(spark, d).select("dataset", F.col("mean_chars").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURED])).alias("m")).select("dataset", "m.measure", "m.x", "y")


def correlations(spark, d):
    return rounded(stats.correlations(_long(spark, d), ["dataset", "measure"]), pearson_r=6, pearson_p=6, spearman_r=6, spearman_p=6)


def significance(spark, d):
    t = stats.correlations(_long(spark, d), ["dataset", "measure"])
    return t.select("dataset", "measure", analysis.significant(t).alias("star"))


def spearman_pivot(spark, d):
    t = stats.correlations(_long(spark, d), ["dataset", "measure"])
    return rounded(analysis.pivoted(t, "dataset", "measure", "spearman_r", list(MEASURED)), **{m: 6 for m in MEASURED})


def regression_line(spark, d):
    return rounded(stats.regression(_long(spark, d), ["dataset", "measure"]), slope=4, intercept=3)


def minmax_normalized(spark, d):
    return rounded(stats.min_max(_measured(spark, d), ["dataset"], [*MEASURED, "mean_chars"]), mean_words=6, n_docs=6, mean_line=6, mean_chars=6)


def queries() -> dict:
    own = (
        edges_intra, edges_symmetric, edges_global, graph_stats, central_docs, central_docs_text, prompt_blocks, voorhees, overlap, nmrd, medoids, kl_by_source, quality_wide, dataset_stats,
        per_cluster_stats, nonblank_docs, word_counts, token_counts, truncated_texts, label_names, stratified_split, split_counts, cluster_sample, centroids, nearest_to_centroid, subcluster_medoids,
        normalized_lengths, token_f1, token_f1_mean, token_f1_docs, retry_seconds, clean_labels, extractive_labels, semantic_similarity_pairs, label_compare, sweep_grid, sweep_edges, sweep_best,
        hyperparam_effects, variance_ratio, variance_pivot, most_impactful, sweep_rank, sweep_spread, sweep_quantiles, param_votes, dev_test_gap, best_worst_dataset, best_worst_cluster, low_f1,
        found_runs, subcluster_delta, correlations, significance, spearman_pivot, regression_line, minmax_normalized,
    )
    return {f.__name__: f for f in own} | {
        "pagerank": ranks(0.85), "pagerank_alpha50": ranks(0.5), "pagerank_alpha95": ranks(0.95), "density_by_source": density("source"), "density_by_lang": density("lang"), "quality_means": _quality_means,
    }


# --- SQL

_V = "v AS (SELECT label, vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings)"
_SIM = "list_dot_product(a.e, b.e)"
_WORDS = "list_filter(regexp_split_to_array({t}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"
_TOKENS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
_PAIRED = "d AS (SELECT doc_id, text, e.label FROM documents JOIN embeddings e ON e.vec_id = doc_id)"


def _edges_sql(t: float) -> str:
    return f"e AS (SELECT a.label, a.doc_id AS src, b.doc_id AS dst, {_SIM} AS w FROM v a JOIN v b ON a.label = b.label AND a.doc_id < b.doc_id WHERE {_SIM} >= {t}::DOUBLE)"


def _ranks_sql(alpha: float) -> str:
    return f"""WITH RECURSIVE {_V}, {_edges_sql(THRESHOLD)},
s AS (SELECT label, src, dst, w FROM e UNION ALL SELECT label, dst, src, w FROM e),
o AS (SELECT label, src, sum(w) AS total FROM s GROUP BY label, src),
n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
m AS (SELECT s.label, s.src, s.dst, s.w / o.total AS w FROM s JOIN o ON s.label = o.label AND s.src = o.src
  UNION ALL SELECT a.label, a.doc_id, b.doc_id, 1.0::DOUBLE / n.n FROM v a JOIN v b ON a.label = b.label JOIN n ON n.label = a.label
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.label = a.label AND o.src = a.doc_id)
  UNION ALL SELECT label, doc_id, doc_id, 0.0::DOUBLE FROM v),
r AS (SELECT 0 AS i, v.label, doc_id, 1.0::DOUBLE / n AS x FROM v JOIN n USING (label)
  UNION ALL SELECT r.i + 1, m.label, m.dst, sum(m.w * r.x) * {alpha}::DOUBLE + (1 - {alpha}::DOUBLE) / any_value(n.n)
    FROM r JOIN m ON m.label = r.label AND m.src = r.doc_id JOIN n ON n.label = m.label WHERE r.i < {STEPS} GROUP BY r.i, m.label, m.dst),
p AS (SELECT label, doc_id, x AS pagerank_score FROM r WHERE i = {STEPS}),
c AS (SELECT * FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY round(pagerank_score, 12) DESC, doc_id)::INT AS rank, doc_id, pagerank_score FROM p) WHERE rank <= 5),
ct AS (SELECT c.label, c.rank, c.doc_id, d.text FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id)
"""


_MEDOID = f"""WITH {_V}, n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
s AS (SELECT a.label, a.doc_id, sum(CASE WHEN a.doc_id <> b.doc_id THEN {_SIM} ELSE 0 END) / (any_value(n.n) - 1) AS mean_sim
  FROM v a JOIN v b ON a.label = b.label JOIN n ON n.label = a.label WHERE n.n > 1 GROUP BY a.label, a.doc_id),
m AS (SELECT label, doc_id, mean_sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mean_sim, 10) DESC, doc_id) AS nth FROM s) WHERE nth = 1)"""
_VOORHEES = f"""{_MEDOID}, k AS (SELECT a.label AS q, b.label, row_number() OVER (PARTITION BY a.doc_id ORDER BY round({_SIM}, 10) DESC, b.doc_id) AS nth
  FROM v a JOIN m ON m.doc_id = a.doc_id JOIN v b ON b.doc_id <> a.doc_id),
voor AS (SELECT n.label, any_value(x.y) AS voorhees_nn FROM n LEFT JOIN (SELECT q, sum((label = q)::INT) / 10.0::DOUBLE AS y FROM k WHERE nth <= 10 GROUP BY q) x ON x.q = n.label GROUP BY n.label)"""
# The caps of 2000, 500 and 200 documents a cluster; clusters nth this scale are below 200 and their complements below 500.
_OVERLAP = f"""i AS (SELECT a.label, avg({_SIM}) AS intra FROM v a JOIN v b ON a.label = b.label AND a.doc_id < b.doc_id GROUP BY a.label),
f AS (SELECT label, doc_id, e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS nth FROM v) WHERE nth <= 200),
z AS (SELECT l, doc_id, e FROM (SELECT x.label AS l, v.doc_id, v.e, row_number() OVER (PARTITION BY x.label ORDER BY v.doc_id) AS nth
  FROM (SELECT DISTINCT label FROM v) x JOIN v ON v.label <> x.label) WHERE nth <= 200),
t AS (SELECT a.label, avg({_SIM}) AS inter FROM f a JOIN z b ON b.l = a.label GROUP BY a.label),
over AS (SELECT i.label, intra - inter AS overlap FROM i JOIN t USING (label))"""
_NMRD = f"""g AS (SELECT a.label AS l, a.doc_id AS q, b.label, b.doc_id,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY CASE WHEN a.doc_id = b.doc_id THEN -2 ELSE round({_SIM}, 10) END DESC, b.doc_id) AS nth FROM v a JOIN v b ON true),
c AS (SELECT label, count(*) AS m FROM v GROUP BY label),
y AS (SELECT l, q, avg(1.0::DOUBLE / nth) AS mrr FROM g WHERE label = l AND q <> doc_id GROUP BY l, q),
nm AS (SELECT y.l AS label, avg(mrr / (list_sum(list_transform(range(1, m), lambda k: 1.0::DOUBLE / k)) / (m - 1))) AS nmrd FROM y JOIN c ON c.label = y.l GROUP BY y.l)"""


def _density_sql(rows: str) -> str:
    return f"""dt AS (SELECT label, doc_id, list_distinct({_TOKENS.format(t='text')}) AS k FROM {rows}),
dn AS (SELECT label, count(*) AS n, sum(len(k)) AS p FROM dt GROUP BY label),
dv AS (SELECT label, count(DISTINCT tok) AS v FROM (SELECT label, unnest(k) AS tok FROM dt) GROUP BY label),
den AS (SELECT label, (p / (v::DOUBLE * n))::DOUBLE AS density FROM dn LEFT JOIN dv USING (label))"""


def _kl_sql(rows: str) -> str:
    return f"""kd AS (SELECT label, doc_id, {_TOKENS.format(t='text')} AS k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || doc_id), doc_id) AS nth FROM {rows}) WHERE nth <= 200),
kt AS (SELECT label, doc_id, tok, count(*) AS c FROM (SELECT label, doc_id, unnest(k) AS tok FROM kd) GROUP BY ALL),
kv AS (SELECT label, count(DISTINCT tok) AS v FROM kt GROUP BY label),
kn AS (SELECT label, doc_id, len(k) + 1e-5::DOUBLE * v AS dd FROM kd JOIN kv USING (label)),
kp AS (SELECT * FROM (SELECT a.label, a.doc_id AS i, b.doc_id AS j, row_number() OVER (PARTITION BY a.label ORDER BY md5('42-' || a.doc_id || '-' || b.doc_id), a.doc_id, b.doc_id) AS nth,
  count(*) OVER (PARTITION BY a.label) AS np FROM kd a JOIN kd b ON a.label = b.label AND a.doc_id < b.doc_id) WHERE nth <= 500),
ku AS (SELECT p.label, p.i, p.j, t.tok, sum(CASE WHEN t.doc_id = p.i THEN t.c ELSE 0 END) AS ci, sum(CASE WHEN t.doc_id = p.j THEN t.c ELSE 0 END) AS cj
  FROM kp p JOIN kt t ON t.label = p.label AND t.doc_id IN (p.i, p.j) GROUP BY ALL),
ks AS (SELECT u.label, u.i, u.j, count(*) AS k, sum(0.5 * ((ci + 1e-5::DOUBLE) / a.dd - (cj + 1e-5::DOUBLE) / b.dd) * (ln((ci + 1e-5::DOUBLE) / a.dd) - ln((cj + 1e-5::DOUBLE) / b.dd))) AS s
  FROM ku u JOIN kn a ON a.doc_id = u.i AND a.label = u.label JOIN kn b ON b.doc_id = u.j AND b.label = u.label GROUP BY ALL),
kk AS (SELECT p.label, coalesce(s, 0) + (v - coalesce(k, 0)) * 0.5 * (1e-5::DOUBLE / a.dd - 1e-5::DOUBLE / b.dd) * (ln(1e-5::DOUBLE / a.dd) - ln(1e-5::DOUBLE / b.dd)) AS d
  FROM kp p LEFT JOIN ks USING (label, i, j) JOIN kn a ON a.doc_id = p.i AND a.label = p.label JOIN kn b ON b.doc_id = p.j AND b.label = p.label JOIN kv ON kv.label = p.label),
kl AS (SELECT x.label, avg(d) AS kl_divergence FROM (SELECT DISTINCT label FROM {rows}) x LEFT JOIN kk USING (label) GROUP BY x.label)"""


def _f1_sql(t: str, g: str) -> str:
    a = f"list_distinct(list_filter(regexp_split_to_array(translate(lower({t}), '_.', '  '), '\\s+'), lambda x: x <> ''))"
    b = f"list_distinct(list_filter(regexp_split_to_array(lower({g}), '\\s+'), lambda x: x <> ''))"
    c = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {c} > 0 THEN 2.0::DOUBLE * {c} / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


def _in(values, name: str) -> str:
    return f"(VALUES {', '.join(f'({v!r}::DOUBLE)' if isinstance(v, float) else f'({v})' for v in values)}) {name}(v)"


_SWEEP = f"""{_V}, {_edges_sql(min(THRESHOLDS))},
st AS (SELECT label, t.v AS threshold, w, count(*) OVER (PARTITION BY label, t.v) AS c, row_number() OVER (PARTITION BY label, t.v ORDER BY round(w, 10) DESC, src, dst) AS nth
  FROM e, {_in(THRESHOLDS, 't')} WHERE label < 4 AND w >= t.v),
sk AS (SELECT label, threshold, k.v AS top_k, avg(w) AS m, any_value(c) AS c FROM st, {_in(TOP_KS, 'k')} WHERE nth <= k.v GROUP BY ALL),
sw AS (SELECT 'c' || label AS dataset, threshold, top_k, a.v AS alpha, round(m * a.v + (1 - a.v) * threshold, 9) AS sem_sim, round(top_k / (c + 10.0::DOUBLE), 9) AS tok_f1 FROM sk, {_in(ALPHAS, 'a')})"""
_LONG = """lp AS (SELECT dataset, 'threshold' AS param, threshold::DOUBLE AS value, sem_sim, tok_f1 FROM sw UNION ALL SELECT dataset, 'top_k', top_k::DOUBLE, sem_sim, tok_f1 FROM sw
  UNION ALL SELECT dataset, 'alpha', alpha::DOUBLE, sem_sim, tok_f1 FROM sw)"""
_BEST = "bs AS (SELECT dataset, threshold, top_k, alpha, sem_sim, tok_f1 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sem_sim DESC, threshold, top_k, alpha) AS nth FROM sw) WHERE nth = 1)"
_RATIO = """vr AS (SELECT b.dataset, param, b.x / t.x AS variance_ratio FROM (SELECT dataset, param, var_samp(m) AS x FROM (SELECT dataset, param, value, avg(sem_sim) AS m FROM lp GROUP BY ALL) GROUP BY ALL) b
  JOIN (SELECT dataset, var_samp(sem_sim) AS x FROM sw GROUP BY dataset) t USING (dataset) WHERE t.x > 0)"""
_RESULTS = "rs AS (SELECT bs.dataset, bs.sem_sim AS dev, t.test FROM bs JOIN (SELECT dataset, avg(sem_sim) AS test FROM sw GROUP BY dataset) t USING (dataset))"
_EXTRACT = """xt AS (SELECT source AS label, tok, count(*) AS tf FROM (SELECT source, unnest(""" + _TOKENS.format(t="text") + """) AS tok FROM documents) GROUP BY ALL),
xd AS (SELECT tok, count(*) AS df FROM xt GROUP BY tok), xn AS (SELECT count(DISTINCT label) AS n FROM xt),
xr AS (SELECT label, tok, row_number() OVER (PARTITION BY label ORDER BY round(tf * ln(1 + n / df::DOUBLE), 6) DESC, tok) AS nth FROM xt JOIN xd USING (tok), xn),
ex AS (SELECT label, string_agg(tok, ' ' ORDER BY nth) AS generated FROM xr WHERE nth <= 3 GROUP BY label)"""
_MEASURE = f"""me AS (SELECT lang AS dataset, source AS cluster, round(avg(len({_WORDS.format(t='text')})), 4) AS mean_words, count(*)::DOUBLE AS n_docs,
  round(avg(length(text) / len(string_split(text, chr(10)))::DOUBLE), 4) AS mean_line, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY ALL),
lo AS (SELECT dataset, 'mean_words' AS measure, mean_words AS x, mean_chars AS y FROM me UNION ALL SELECT dataset, 'n_docs', n_docs, mean_chars FROM me UNION ALL SELECT dataset, 'mean_line', mean_line, mean_chars FROM me),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset, measure ORDER BY x) + (count(*) OVER (PARTITION BY dataset, measure, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY dataset, measure ORDER BY y) + (count(*) OVER (PARTITION BY dataset, measure, y) - 1) / 2.0::DOUBLE AS ry FROM lo),
co AS (SELECT dataset, measure, count(*) AS n, corr(x, y) AS pr, corr(rx, ry) AS sr FROM rk GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)"""


def _p_sql(r: str) -> str:
    c = f"(1 - {r} * {r})"
    even = f"1 - abs({r}) * list_sum(list_transform(range(0, (n - 2) // 2), lambda j: exp(lgamma(j + 0.5::DOUBLE) - lgamma(j + 1::DOUBLE)) / sqrt(pi()) * pow({c}, j)))"
    odd = f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1::DOUBLE) - lgamma(j + 1.5::DOUBLE)) * pow({c}, j + 0.5::DOUBLE))), 0))"
    return f"round(CASE WHEN abs({r}) >= 1 THEN 0.0::DOUBLE WHEN n % 2 = 0 THEN greatest(0, {even}) ELSE greatest(0, {odd}) END, 6)"


def oracle_sql() -> dict[str, str]:
    w = _WORDS.format(t="text")
    short = lambda n: f"array_to_string(({w})[1:{n}], ' ') || CASE WHEN len({w}) > {n} THEN '...' ELSE '' END"
    scale = lambda c: f"CASE WHEN max({c}) OVER p > min({c}) OVER p THEN round(({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p), 6) ELSE 0.5::DOUBLE END AS {c}"
    quality_sql = f"{_VOORHEES}, {_OVERLAP}, {_NMRD}, {_PAIRED}, {_density_sql('d')}, {_kl_sql('d')}"
    wide = "FROM (SELECT DISTINCT label FROM v) x LEFT JOIN voor USING (label) LEFT JOIN over USING (label) LEFT JOIN nm USING (label) LEFT JOIN den USING (label) LEFT JOIN kl USING (label)"
    return {
        "edges_intra": f"WITH {_V}, {_edges_sql(0.1)} SELECT label, src, dst, round(w, 6) AS weight FROM e",
        "edges_symmetric": f"WITH {_V}, {_edges_sql(THRESHOLD)} SELECT label, src, dst, round(w, 6) AS weight FROM e UNION ALL SELECT label, dst, src, round(w, 6) FROM e",
        "edges_global": f"WITH {_V} SELECT a.doc_id AS src, b.doc_id AS dst, round({_SIM}, 6) AS weight FROM v a JOIN v b ON a.doc_id < b.doc_id WHERE {_SIM} >= 0.3::DOUBLE",
        "graph_stats": f"WITH {_V}, {_edges_sql(THRESHOLD)} SELECT n.label, n.n AS n_nodes, coalesce(x.n, 0) AS n_edges FROM (SELECT label, count(*) AS n FROM v GROUP BY label) n LEFT JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) x USING (label)",
        "pagerank": _ranks_sql(0.85) + "SELECT label, doc_id, round(pagerank_score, 8) AS pagerank_score FROM p",
        "pagerank_alpha50": _ranks_sql(0.5) + "SELECT label, doc_id, round(pagerank_score, 8) AS pagerank_score FROM p",
        "pagerank_alpha95": _ranks_sql(0.95) + "SELECT label, doc_id, round(pagerank_score, 8) AS pagerank_score FROM p",
        "central_docs": _ranks_sql(0.85) + "SELECT label, rank, doc_id, round(pagerank_score, 8) AS pagerank_score FROM c",
        "central_docs_text": _ranks_sql(0.85) + "SELECT label, rank, doc_id, text FROM ct",
        "prompt_blocks": _ranks_sql(0.85) + f"SELECT label, count(*) AS k, string_agg('Document ' || rank || ':' || chr(10) || coalesce({short(12)}, ''), chr(10) || chr(10) ORDER BY rank) AS prompt FROM ct GROUP BY label",
        "medoids": f"{_MEDOID} SELECT label, doc_id, round(mean_sim, 6) AS mean_sim FROM m",
        "voorhees": f"{_VOORHEES} SELECT label, round(voorhees_nn, 6) AS voorhees_nn FROM voor",
        "overlap": f"WITH {_V}, {_OVERLAP} SELECT label, round(overlap, 6) AS overlap FROM over",
        "nmrd": f"WITH {_V}, {_NMRD} SELECT label, round(nmrd, 6) AS nmrd FROM nm",
        "density_by_source": f"WITH d AS (SELECT doc_id, text, source AS label FROM documents), {_density_sql('d')} SELECT label, round(density, 8) AS density FROM den",
        "density_by_lang": f"WITH d AS (SELECT doc_id, text, lang AS label FROM documents), {_density_sql('d')} SELECT label, round(density, 8) AS density FROM den",
        "kl_by_source": f"WITH d AS (SELECT doc_id, text, source AS label FROM documents), {_kl_sql('d')} SELECT label, round(kl_divergence, 6) AS kl_divergence FROM kl",
        "quality_wide": f"{quality_sql} SELECT label AS cluster, round(voorhees_nn, 6) AS voorhees_nn, round(overlap, 6) AS overlap, round(kl_divergence, 6) AS kl_divergence, round(density, 8) AS density, round(nmrd, 6) AS nmrd {wide}",
        "quality_means": f"{quality_sql} SELECT round(avg(voorhees_nn), 5) AS voorhees_nn, round(avg(overlap), 5) AS overlap, round(avg(kl_divergence), 5) AS kl_divergence, round(avg(density), 5) AS density, round(avg(nmrd), 5) AS nmrd {wide}",
        "dataset_stats": f"WITH l AS (SELECT len({w})::BIGINT AS a, length(text)::BIGINT AS b FROM documents), s AS (SELECT count(*) AS n_clusters, max(c) / min(c)::DOUBLE AS r FROM (SELECT count(*) AS c FROM documents GROUP BY source)) SELECT count(*) AS n_docs, any_value(n_clusters) AS n_clusters, round(any_value(r), 6) AS imbalance, round(avg(a), 5) AS mean_words, round(stddev_samp(a), 5) AS std_words, round(median(a), 5) AS median_words, min(a) AS min_words, max(a) AS max_words, round(avg(b), 5) AS mean_chars, round(stddev_samp(b), 5) AS std_chars, round(median(b), 5) AS median_chars, min(b) AS min_chars, max(b) AS max_chars FROM l, s",
        "per_cluster_stats": f"WITH l AS (SELECT lang AS label, len({w})::BIGINT AS a, length(text) AS b FROM documents) SELECT label, count(*) AS n_docs, round(100 * count(*) / (SELECT count(*) FROM l)::DOUBLE, 6) AS share, round(avg(a), 5) AS mean_words, round(stddev_samp(a), 5) AS std_words, min(a) AS min_words, max(a) AS max_words, round(avg(b), 5) AS mean_chars FROM l GROUP BY label",
        "nonblank_docs": "SELECT doc_id, source AS label FROM documents WHERE regexp_matches(text, '\\S')",
        "word_counts": f"SELECT doc_id, len({w})::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM documents",
        "token_counts": f"SELECT doc_id, len({_TOKENS.format(t='text')})::BIGINT AS n_tokens FROM documents",
        "truncated_texts": f"SELECT doc_id, {short(40)} AS text FROM documents",
        "label_names": "SELECT vec_id AS doc_id, CASE label WHEN 0 THEN 'World' WHEN 1 THEN 'Sports' WHEN 2 THEN 'Business' WHEN 3 THEN 'Sci/Tech' END AS label FROM embeddings",
        "stratified_split": _SPLIT + "SELECT doc_id, label, split FROM out",
        "split_counts": _SPLIT + "SELECT label, split, count(*) AS n FROM out GROUP BY ALL",
        "cluster_sample": "SELECT doc_id, source AS label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 20",
        "centroids": "SELECT label, pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings) GROUP BY label, pos",
        "nearest_to_centroid": f"WITH {_V}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY ALL) GROUP BY label) SELECT label, doc_id, round(sim, 6) AS sim FROM (SELECT v.label, doc_id, list_dot_product(e, c) AS sim, row_number() OVER (PARTITION BY v.label ORDER BY round(list_dot_product(e, c), 10) DESC, doc_id) AS nth FROM v JOIN c USING (label)) WHERE nth = 1",
        "normalized_lengths": "SELECT vec_id AS doc_id, round(list_dot_product(e, e) / list_dot_product(e, e), 6) AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        "token_f1": f"SELECT t AS label, round({_f1_sql('t', 'g')}, 6) AS tok_f1 FROM (VALUES {_values(LABEL_PAIRS)}) x(t, g)",
        "token_f1_mean": f"SELECT round(avg({_f1_sql('t', 'g')}), 6) AS tok_f1 FROM (VALUES {_values(LABEL_PAIRS)}) x(t, g)",
        "token_f1_docs": f"SELECT doc_id, round({_f1_sql('t', 'g')}, 6) AS tok_f1 FROM (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS t, coalesce(string_split(text, chr(10))[2], '') AS g FROM documents)",
        "retry_seconds": f"SELECT m AS message, CASE WHEN regexp_matches(m, 'try again in (\\d+(?:\\.\\d+)?)s') THEN regexp_extract(m, 'try again in (\\d+(?:\\.\\d+)?)s', 1)::DOUBLE WHEN regexp_matches(m, 'try again in (\\d+)m([\\d.]+)s') THEN regexp_extract(m, 'try again in (\\d+)m', 1)::DOUBLE * 60 + regexp_extract(m, 'm([\\d.]+)s', 1)::DOUBLE ELSE 60.0::DOUBLE END AS seconds FROM (VALUES {_values([(m,) for m in MESSAGES])}) x(m)",
        "clean_labels": "SELECT id::INT AS id, coalesce(trim(l, ' ' || chr(10)), '[no label generated]') AS label FROM (VALUES (0, '  UK Policy ' || chr(10)), (1, NULL), (2, 'Sport')) x(id, l)",
        "extractive_labels": f"WITH {_EXTRACT} SELECT label, generated FROM ex",
        "label_compare": f"WITH {_EXTRACT} SELECT a.label, a.generated AS dev_label, coalesce(b.generated, '—') AS test_label FROM ex a LEFT JOIN (SELECT * FROM ex WHERE label >= 'src12') b USING (label) WHERE a.label < 'src5'",
        "semantic_similarity_pairs": f"WITH {_V} SELECT a.doc_id, round({_SIM}, 6) AS sem_sim FROM v a JOIN v b ON b.doc_id = a.doc_id + 1",
        "sweep_grid": "SELECT (t.i * 9 + k.i * 3 + a.i)::INT AS run, t.v AS threshold, k.v AS top_k, a.v AS alpha FROM (VALUES (0, 0.3::DOUBLE), (1, 0.5::DOUBLE), (2, 0.7::DOUBLE)) t(i, v), (VALUES (0, 3), (1, 5), (2, 10)) k(i, v), (VALUES (0, 0.5::DOUBLE), (1, 0.85::DOUBLE), (2, 0.95::DOUBLE)) a(i, v)",
        "sweep_edges": f"WITH {_V}, {_edges_sql(0.1)} SELECT label, t AS threshold, count(*) AS n_edges FROM e JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) x(t) ON w >= t GROUP BY ALL",
        "sweep_best": f"WITH {_SWEEP}, {_BEST} SELECT dataset, threshold, top_k, alpha, round(sem_sim, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1 FROM bs",
        "hyperparam_effects": f"WITH {_SWEEP}, {_LONG} SELECT dataset, param, value, round(avg(sem_sim), 6) AS sem_sim, round(avg(tok_f1), 6) AS tok_f1 FROM lp GROUP BY ALL",
        "variance_ratio": f"WITH {_SWEEP}, {_LONG}, {_RATIO} SELECT dataset, param, round(variance_ratio, 6) AS variance_ratio FROM vr",
        "variance_pivot": f"WITH {_SWEEP}, {_LONG}, {_RATIO} SELECT dataset, round(max(variance_ratio) FILTER (param = 'threshold'), 6) AS threshold, round(max(variance_ratio) FILTER (param = 'top_k'), 6) AS top_k, round(max(variance_ratio) FILTER (param = 'alpha'), 6) AS alpha FROM vr GROUP BY dataset",
        "most_impactful": f"WITH {_SWEEP}, {_LONG}, {_RATIO} SELECT dataset, param, round(variance_ratio, 6) AS variance_ratio FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(variance_ratio, 12) DESC, list_position(['threshold', 'top_k', 'alpha'], param)) AS nth FROM vr) WHERE nth = 1",
        "sweep_rank": f"WITH {_SWEEP} SELECT dataset, threshold, top_k, alpha, round(sem_sim, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1, (row_number() OVER (PARTITION BY dataset ORDER BY sem_sim DESC, threshold, top_k, alpha))::INT AS rank FROM sw",
        "sweep_spread": f"WITH {_SWEEP} SELECT dataset, round(min(sem_sim), 6) AS low, round(max(sem_sim), 6) AS high, round(stddev_samp(sem_sim), 6) AS std, round(max(sem_sim) - min(sem_sim), 6) AS span, count(*) AS runs FROM sw GROUP BY dataset",
        "sweep_quantiles": f"WITH {_SWEEP} SELECT dataset, round(quantile_cont(sem_sim, 0.25), 6) AS q1, round(quantile_cont(sem_sim, 0.5), 6) AS q2, round(quantile_cont(sem_sim, 0.75), 6) AS q3 FROM sw GROUP BY dataset",
        "param_votes": f"WITH {_SWEEP}, {_BEST}, lb AS (SELECT dataset, 'threshold' AS param, threshold::DOUBLE AS value FROM bs UNION ALL SELECT dataset, 'top_k', top_k::DOUBLE FROM bs UNION ALL SELECT dataset, 'alpha', alpha FROM bs), c AS (SELECT param, value, count(*) AS votes, min(dataset) AS f FROM lb GROUP BY ALL) SELECT param, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY votes DESC, f) AS nth FROM c) WHERE nth = 1",
        "dev_test_gap": f"WITH {_SWEEP}, {_BEST}, {_RESULTS} SELECT dataset, round(dev, 6) AS dev, round(test, 6) AS test, round(dev - test, 6) AS gap, CASE WHEN dev > test THEN 'overfit' ELSE 'underfit' END AS direction FROM rs",
        "best_worst_dataset": f"WITH {_SWEEP}, {_BEST}, {_RESULTS} SELECT a.dataset AS best, round(a.test, 6) AS best_value, b.dataset AS worst, round(b.test, 6) AS worst_value FROM (SELECT * FROM rs ORDER BY test DESC, dataset LIMIT 1) a, (SELECT * FROM rs ORDER BY test, dataset LIMIT 1) b",
        "best_worst_cluster": f"{_MEDOID}, r AS (SELECT label, round(avg(mean_sim), 6) AS score FROM s GROUP BY label) SELECT 'vectors' AS dataset, a.label AS best, a.score AS best_value, b.label AS worst, b.score AS worst_value FROM (SELECT * FROM r ORDER BY score DESC, label LIMIT 1) a, (SELECT * FROM r ORDER BY score, label LIMIT 1) b",
        "low_f1": f"WITH {_SWEEP} SELECT round(avg(tok_f1), 6) AS mean_f1, avg(tok_f1) < 0.1 AS low FROM sw",
        "found_runs": f"WITH {_SWEEP} SELECT dataset, threshold, top_k, alpha, round(sem_sim, 6) AS sem_sim, round(tok_f1, 6) AS tok_f1 FROM sw WHERE top_k = 5 AND alpha = 0.85::DOUBLE",
        "subcluster_delta": f"WITH {_SWEEP} SELECT top_k AS n_subclusters, round(avg(sem_sim), 6) AS sem_sim, round(avg(sem_sim) - (SELECT avg(sem_sim) FROM sw WHERE dataset = 'c0'), 6) AS delta FROM sw GROUP BY top_k",
        "correlations": f"WITH {_MEASURE} SELECT dataset, measure, n, round(pr, 6) AS pearson_r, {_p_sql('pr')} AS pearson_p, round(sr, 6) AS spearman_r, {_p_sql('sr')} AS spearman_p FROM co",
        "significance": f"WITH {_MEASURE} SELECT dataset, measure, CASE WHEN {_p_sql('pr')} < 0.05 THEN '*' ELSE '' END AS star FROM co",
        "spearman_pivot": f"WITH {_MEASURE} SELECT dataset, round(max(sr) FILTER (measure = 'mean_words'), 6) AS mean_words, round(max(sr) FILTER (measure = 'n_docs'), 6) AS n_docs, round(max(sr) FILTER (measure = 'mean_line'), 6) AS mean_line FROM co GROUP BY dataset",
        "regression_line": f"WITH {_MEASURE} SELECT dataset, measure, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM lo GROUP BY ALL",
        "minmax_normalized": f"WITH {_MEASURE} SELECT dataset, cluster, {', '.join(scale(c) for c in (*MEASURED, 'mean_chars'))} FROM me WINDOW p AS (PARTITION BY dataset)",
    }


_SPLIT = """WITH s AS (SELECT lang AS label, count(*) AS c FROM documents GROUP BY lang), n AS (SELECT sum(c) AS n FROM s),
q AS (SELECT label, ceil(0.2::DOUBLE * n) * c / n AS want, n FROM s, n),
r AS (SELECT label, floor(want) AS quota, row_number() OVER (ORDER BY round(want - floor(want), 9) DESC, label) AS nth, ceil(0.2::DOUBLE * n) - sum(floor(want)) OVER () AS rest FROM q),
out AS (SELECT doc_id, d.label, CASE WHEN d.nth <= r.quota + (r.nth <= r.rest)::INT THEN 'test' ELSE 'dev' END AS split
  FROM (SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS nth FROM documents) d JOIN r USING (label))
"""
