import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import analysis, graph, labels, pagerank, quality, sampling, subcluster


def unit(rng, n, dim=6):
    v = rng.normal(size=(n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    v = unit(rng, 70)
    v[10] = v[11]  # equal vectors
    labels_ = ["a"] * 25 + ["b"] * 40 + ["c"] * 2 + ["d"] + [None] * 2
    rows = [(lab, i, [float(x) for x in v[i]]) for i, lab in enumerate(labels_)]
    return rows, v.astype(np.float64), spark.createDataFrame(rows, "label string, doc_id long, embedding array<float>").repartition(3).cache()


def brute_edges(rows, v, t, by_label=True):
    out = {}
    for i, (a, x, _) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b, y, _ = rows[j]
            if (a == b and a is not None) if by_label else True:
                w = float(v[i] @ v[j])
                if w >= t:
                    out[(a, x, y) if by_label else (x, y)] = w
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_edges(table, block):
    rows, v, df = table
    got = {(r["label"], r["src"], r["dst"]): r["weight"] for r in graph.edges(df, 0.2, block=block).collect()}
    want = brute_edges(rows, v, 0.2)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = {(r["src"], r["dst"]) for r in graph.edges(df, 0.5, label=None, block=block).collect()}
    assert got == brute_edges(rows, v, 0.5, False).keys()
    both = graph.symmetric(graph.edges(df, 0.2)).collect()
    assert len(both) == 2 * len(want) and {(r["label"], r["dst"], r["src"]) for r in both} == {(r["label"], r["src"], r["dst"]) for r in both}
    n = {r["label"]: (r["n_nodes"], r["n_edges"]) for r in graph.counts(df, graph.edges(df, 0.2)).collect()}
    assert n["d"] == (1, 0) and n["a"][0] == 25 and sum(e for _, e in n.values()) == len(want)


def brute_ranks(rows, v, t, alpha):
    out = {}
    for lab in {r[0] for r in rows} - {None}:
        at = [i for i, r in enumerate(rows) if r[0] == lab]
        w = np.array([[v[i] @ v[j] if i != j and v[i] @ v[j] >= t else 0.0 for j in at] for i in at])
        n, s = len(at), w.sum(axis=0)
        x = np.full(n, 1 / n)
        for _ in range(1000):
            new = alpha * (w / np.where(s > 0, s, 1)) @ x + (alpha * x[s == 0].sum() + 1 - alpha) / n
            done = np.abs(new - x).sum() < n * 1e-6
            x = new
            if done:
                break
        out |= {(lab, i): x[k] for k, i in enumerate(at)}
    return out


@pytest.mark.parametrize("alpha", [0.5, 0.85])
def test_pagerank_both_ways(table, alpha):
    rows, v, df = table
    pairs = graph.edges(df, 0.3)
    want = brute_ranks(rows, v, 0.3, alpha)
    ways = [pagerank.pagerank(df, pairs, alpha)]
    if alpha == 0.5:
        ways.append(pagerank.by_dataframes(df.where("label is not null").select("label", "doc_id"), pairs, alpha))
    for way in ways:
        got = {(r["label"], r["doc_id"]): r["pagerank_score"] for r in way.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        for lab in "abcd":
            assert math.isclose(sum(x for k, x in got.items() if k[0] == lab), 1.0)
    best = pagerank.central(pagerank.pagerank(df, graph.edges(df, 0.999), alpha), 3).where("label = 'b'").orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [25, 26, 27]  # no edges: the lowest ids


def test_large_clusters_go_by_joins(table, monkeypatch):
    _, _, df = table
    pairs = graph.edges(df, 0.3)
    whole = {(r["label"], r["doc_id"]): r["pagerank_score"] for r in pagerank.pagerank(df, pairs, tol=None, most=3).collect()}
    monkeypatch.setattr(pagerank, "MAX_NODES", 30)
    got = {(r["label"], r["doc_id"]): r["pagerank_score"] for r in pagerank.pagerank(df, pairs, tol=None, most=3).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-12 for k in got)


def test_quality_of_vectors(table):
    rows, v, df = table
    known = [i for i, r in enumerate(rows) if r[0] is not None]
    lab = [rows[i][0] for i in known]
    sims = v[known] @ v[known].T
    med = {r["label"]: r["doc_id"] for r in quality.medoids(df).collect()}
    voor = {r["label"]: r["voorhees_nn"] for r in quality.voorhees(df, k=5).collect()}
    over = {r["label"]: r["overlap"] for r in quality.overlap(df).collect()}
    rank = {r["label"]: r["nmrd"] for r in quality.nmrd(df).collect()}
    assert voor["d"] is None and over["d"] is None and rank["d"] is None and "d" not in med
    for name in "abc":
        at = [k for k, x in enumerate(lab) if x == name]
        others = [k for k, x in enumerate(lab) if x != name][:200]
        mean = (sims[np.ix_(at, at)].sum(axis=1) - np.diag(sims)[at]) / (len(at) - 1)
        m = at[int(np.argmax(np.round(mean, 10)))]
        assert med[name] == known[m]
        own = np.round(sims[m].copy(), 10)
        own[m] = -2
        near = sorted(range(len(known)), key=lambda k: (-own[k], k))[:5]
        assert math.isclose(voor[name], sum(lab[k] == name for k in near) / 5)
        inner = [sims[i, j] for i in at for j in at if i < j]
        assert abs(over[name] - (np.mean(inner) - sims[np.ix_(at, others)].mean())) < 1e-6
        scores = []
        for q in at:
            s = np.round(sims[q].copy(), 10)
            s[q] = -2
            order = sorted(range(len(known)), key=lambda k: (-s[k], k))
            scores.append(np.mean([1 / (order.index(k) + 1) for k in at if k != q]))
        ideal = sum(1 / k for k in range(1, len(at))) / (len(at) - 1)
        assert abs(rank[name] - np.mean(scores) / ideal) < 1e-9


def test_quality_of_texts(spark):
    rows = [("a", 1, "x y x"), ("a", 2, "y z"), ("b", 3, "..."), ("b", 4, None), ("c", 5, "Été été"), ("d", 6, "p q"), ("d", 7, "p q"), (None, 8, "z")]
    df = spark.createDataFrame(rows, "label string, doc_id long, text string")
    dens = {r["label"]: r["density"] for r in quality.density(df).collect()}
    assert dens == {"a": 4 / 6, "b": None, "c": 1.0, "d": 1.0}
    kl = {r["label"]: r["kl_divergence"] for r in quality.kl_divergence(df).collect()}
    s = 1e-5
    p = np.array([2 + s, 1 + s, s]) / (3 + 3 * s)
    q = np.array([s, 1 + s, 1 + s]) / (2 + 3 * s)
    assert abs(kl["a"] - 0.5 * ((p - q) * (np.log(p) - np.log(q))).sum()) < 1e-12
    assert kl["b"] is None and kl["c"] is None and abs(kl["d"]) < 1e-12


def test_split_and_samples(spark):
    df = spark.createDataFrame([(i, "abc"[min(2, i // 40)] if i < 93 else None) for i in range(95)], "doc_id long, label string")
    got = sampling.stratified_split(df, "label", "doc_id").groupBy("split", "label").count().collect()
    n = {(r["split"], r["label"]): r["count"] for r in got}
    assert sum(c for (s, _), c in n.items() if s == "test") == math.ceil(0.2 * 93) and n[("test", "a")] in (8, 9) and sum(n.values()) == 93
    twice = [sorted(map(tuple, sampling.sample(df, "label", "doc_id", 10).collect())) for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0]) == 30
    first = sampling.first_of_others(df, "label", "doc_id", 12, F.col("doc_id")).collect()
    by = {lab: sorted(r["doc_id"] for r in first if r["own_label"] == lab) for lab in "abc"}
    assert by == {"a": list(range(40, 52)), "b": list(range(12)), "c": list(range(12))}


@pytest.mark.parametrize("most", [200_000, 20])
def test_subclusters(table, monkeypatch, most):
    """Clusters that fit a task, and one that is left to Spark's own K-Means."""
    monkeypatch.setattr(subcluster, "MAX_DOCS", most)
    rows, v, df = table
    parts = subcluster.kmeans(df, 3).collect()
    for name, n in (("a", 3), ("c", 2), ("d", 1)):
        assert {r["subcluster_id"] for r in parts if r["label"] == name} == set(range(n))
    assert len(parts) == 68
    med = subcluster.subcluster_medoids(df, c=3).collect()
    of = {(r["label"], r["doc_id"]): r["subcluster_id"] for r in parts}
    assert all(of[r["label"], r["doc_id"]] == r["subcluster_id"] for r in med) and len(med) == 3 + 3 + 2 + 1
    one = {r["label"]: r["doc_id"] for r in subcluster.subcluster_medoids(df, c=1).collect()}
    at = [i for i, r in enumerate(rows) if r[0] == "a"]
    assert one["a"] == at[int(np.argmax(v[at] @ v[at].mean(axis=0)))]


def test_labels(spark):
    class Echo:
        def __init__(self):
            self.calls = 0

        def __call__(self, prompt):
            self.calls += 1
            if "wait" in prompt and self.calls < 3:
                raise labels.RateLimited("try again in 0.01s")
            if "fail" in prompt:
                raise ValueError("no service")
            return None if "none" in prompt else f" {prompt[-4:]} "

    central = spark.createDataFrame([("a", 2, "two words here"), ("a", 1, "wait"), ("b", 1, "fail"), ("c", 1, "none"), ("d", 1, None)], "label string, rank int, text string")
    prompts = labels.prompts(central, max_words=2)
    by = {r["label"]: r["prompt"] for r in prompts.collect()}
    assert by["a"] == "Document 1:\nwait\n\nDocument 2:\ntwo words..." and by["d"] == "Document 1:\n"
    assert labels.prompts(central, template="{k}|{documents_block}").where("label = 'b'").first()["prompt"] == "1|Document 1:\nfail"
    got = {r["label"]: r["generated"] for r in labels.labelled(prompts.coalesce(1), Echo()).collect()}
    assert got["a"] == "s..." and got["b"] == got["c"] == "[no label generated]"
    ex = {r["label"]: r["generated"] for r in labels.extractive(spark.createDataFrame([("a", "cat cat dog"), ("b", "dog bird"), ("c", "..")], "label string, text string"), terms=2).collect()}
    assert ex == {"a": "cat dog", "b": "bird dog", "c": "[no label generated]"}
    scored = labels.scores(spark.createDataFrame([("a b", "a b"), ("x", "y")], "label string, generated string")).collect()
    assert abs(scored[0]["sem_sim"] - 1) < 1e-9 and scored[0]["tok_f1"] == 1.0 and scored[1]["tok_f1"] == 0.0


def test_sweep_statistics(spark):
    rows = [("d", t, k, a, 0.1 * i, 0.0) for i, (t, k, a) in enumerate([(0.3, 3, 0.5), (0.3, 5, 0.5), (0.5, 3, 0.5), (0.5, 5, 0.5)])] + [("e", 0.3, 3, 0.5, 0.5, 0.2), ("e", 0.5, 3, 0.5, 0.5, 0.2)]
    s = spark.createDataFrame(rows, "dataset string, threshold double, top_k int, alpha double, sem_sim double, tok_f1 double")
    best = {r["dataset"]: (r["threshold"], r["top_k"]) for r in analysis.best_runs(s).collect()}
    assert best == {"d": (0.5, 5), "e": (0.3, 3)}  # of equals the first
    ratios = {(r["dataset"], r["param"]): r["variance_ratio"] for r in analysis.variance_ratios(s).collect()}
    assert {d for d, _ in ratios} == {"d"}  # no variance, no row
    assert math.isclose(ratios["d", "threshold"], np.var([0.05, 0.25], ddof=1) / np.var([0, 0.1, 0.2, 0.3], ddof=1))
    assert analysis.most_impactful(s).first()["param"] == "threshold"
    q = analysis.quartiles(s).where("dataset = 'd'").first()
    assert np.allclose([q["q1"], q["q2"], q["q3"]], np.percentile([0, 0.1, 0.2, 0.3], [25, 50, 75]))
