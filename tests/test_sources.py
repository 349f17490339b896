import json

import pytest

from clusterloom.operators import graph, sampling
from clusterloom.plans import runs
from clusterloom.sources import readers, writers


def test_csv_and_text_tree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"He said ""no""\nand left",x\nNA,y\n', encoding="utf-8")
    got = readers.load(spark, "csv_articles", str(tmp_path / "a.csv")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["label"]) for r in got] == [(0, 'He said "no"\nand left', "x"), (1, "NA", "y")]
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), null="NA").where("text is null").count() == 1
    for lab, name, data in (("sport", "002.txt", b"two"), ("sport", "001.txt", b"caf\xe9"), ("art", "001.txt", "Été".encode())):
        (tmp_path / "tree" / lab).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / lab / name).write_bytes(data)
    got = readers.load(spark, "text_tree", str(tmp_path / "tree")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["label"]) for r in got] == [(0, "Été", "art"), (1, "caf�", "sport"), (2, "two", "sport")]


def test_parquet_loaders(spark, tmp_path):
    spark.createDataFrame([("a", 0), (" ", 3), ("c", 9)], "text string, label int").write.parquet(str(tmp_path / "n"))
    assert sorted((r["text"], r["label"] or "") for r in readers.load(spark, "news_topics", str(tmp_path / "n")).collect()) == [(" ", "Sci/Tech"), ("a", "World"), ("c", "")]
    assert readers.read_parquet(spark, str(tmp_path / "n"), drop_blank=True).count() == 2
    spark.createDataFrame([("a", "pay")], "text string, label_text string").write.parquet(str(tmp_path / "i"))
    assert readers.load(spark, "intents", str(tmp_path / "i")).first()["label"] == "pay"
    with pytest.raises(ValueError):
        readers.load(spark, "nothing", "")
    with pytest.raises(ValueError):
        readers.require(spark.range(1), "text")
    with pytest.raises(ValueError):
        readers.require(spark.range(0), "id")


def record(threshold, score):
    return {
        "config": {"dataset": "x", "similarity_threshold": threshold, "top_k": 3, "pagerank_alpha": 0.5},
        "labels": {"a": {"generated": "A"}},
        "metrics": {"semantic_similarity": {"a": score, "b": 0.5, "__mean__": score}, "token_overlap_f1": {"a": 0.0, "__mean__": 0.25}},
    }


def test_json_scans(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([record(0.3, 0.1), record(0.5, 0.9)]))
    sweep = readers.read_sweep(spark, str(tmp_path / "s.json"))
    assert sorted((r["threshold"], r["sem_sim"], r["tok_f1"]) for r in sweep.collect()) == [(0.3, 0.1, 0.25), (0.5, 0.9, 0.25)]
    flat = readers.by_label(sweep, "threshold").where("threshold = 0.5").collect()
    assert sorted((r["label"], r["sem_sim"], r["tok_f1"]) for r in flat) == [("a", 0.9, 0.0), ("b", 0.5, None)]
    whole = {"dev_sweep": [record(0.3, 0.1)], "best_config": record(0.3, 0.1)["config"], "best_dev_metrics": record(0.3, 0.1)["metrics"], "test_result": record(0.3, 0.7)}
    (tmp_path / "r.json").write_text(json.dumps(whole))
    assert readers.read_results(spark, str(tmp_path / "r.json")).first()["best_config"]["top_k"] == 3
    assert {r["label"]: r["sem_sim"] for r in readers.read_test_scores(spark, str(tmp_path / "r.json")).collect()} == {"a": 0.7, "b": 0.5}
    (tmp_path / "q.json").write_text(json.dumps({"a": {"voorhees_nn": 1.0, "overlap": None, "kl_divergence": 7.5, "density": 0.1, "nmrd": 0.9}}, indent=2))
    q = readers.read_quality(spark, str(tmp_path / "q.json")).first()
    assert q["kl_divergence"] == -7.5 and q["overlap"] is None and q["cluster"] == "a"
    assert readers.read_quality(spark, str(tmp_path / "none.json")) is None


def test_sinks_and_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, "d")], "doc_id long, text string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["text"] for r in readers.read_csv(spark, str(tmp_path / "c")).collect()) == ['a "b"\nc', "d"]
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    calls = []

    def embed(d):
        calls.append(1)
        return d.selectExpr("doc_id", "array(cast(doc_id as float)) as embedding")

    for docs, n in ((df, 1), (df.orderBy("text"), 1), (df.where("doc_id = 1"), 2)):
        writers.cached_vectors(docs, "m", str(tmp_path / "v"), embed).count()
        assert len(calls) == n
    grid = spark.createDataFrame([(0.3, 1), (0.5, 1)], "threshold double, top_k int")
    assert writers.missing_runs(grid, str(tmp_path / "runs"), ["threshold", "top_k"]).count() == 2
    writers.append_run(grid.where("threshold = 0.3"), str(tmp_path / "runs"))
    assert [r["threshold"] for r in writers.missing_runs(grid, str(tmp_path / "runs"), ["threshold", "top_k"]).collect()] == [0.5]


def corpus(spark):
    words = {"cats": "cat purr whisker milk", "dogs": "dog bark leash bone", "cars": "car wheel road engine"}
    rows = [(i, f"{words[k]} {words[k].split()[i % 4]} extra{i % 5}", k) for i, k in enumerate(k for k in words for _ in range(10))]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def test_whole_run_and_sweep(spark, tmp_path):
    docs = corpus(spark)
    cfg = runs.Config(similarity_threshold=0.2, top_k=3, cache_dir=str(tmp_path / "cache"))
    out = {r["label"]: r for r in runs.run(spark, cfg, docs).collect()}
    assert set(out) == {"cats", "dogs", "cars"} and all(r["generated"] and r["tok_f1"] == 0.0 for r in out.values())
    named = runs.run(spark, cfg, docs, labeller=lambda prompt: "cats" if "purr" in prompt else "no")
    assert {r["label"]: r["tok_f1"] for r in named.collect()} == {"cats": 1.0, "dogs": 0.0, "cars": 0.0}
    vectors = runs.vectors_of(docs, cfg)
    grid = {"thresholds": (0.2, 0.9), "top_ks": (2,), "alphas": (0.85,)}
    found = runs.sweep(spark, cfg, docs, vectors, str(tmp_path / "s"), grid)
    assert found["dev"].count() == 2 and found["best"].split == "test" and found["test"].count() == 3
    wider = grid | {"thresholds": (0.9, 0.2, 0.5)}
    again = runs.sweep(spark, cfg, docs, vectors, str(tmp_path / "s"), wider)
    assert again["dev"].count() == 3  # the two that were there count, wherever they stand now
    parts = runs.subcluster_run(docs, vectors, cfg, (1, 2))
    assert sorted({r["n_subclusters"] for r in parts.collect()}) == [1, 2] and parts.count() == 6


def test_published_correlations(spark):
    """Per-cluster measures and scores with known, rounded results (fixed values)."""
    quality = [("business", 0.1), ("entertainment", 0.2), ("politics", 0.15), ("sport", 0.3), ("tech", 0.12)]
    scores = [0.36, 0.35, 0.31, 0.42, 0.32]
    q = spark.createDataFrame([("n", c, 1.0, x, -x, 0.5 + x, x * x) for c, x in quality], "dataset string, cluster string, voorhees_nn double, overlap double, kl_divergence double, density double, nmrd double")
    s = spark.createDataFrame([("n", c, y, 0.0) for (c, _), y in zip(quality, scores)], "dataset string, cluster string, sem_sim double, tok_f1 double")
    table = {(r["measure"], r["metric"]): r for r in runs.correlation_table(q, s).collect()}
    assert set(table) == {(m, "sem_sim") for m in ("overlap", "kl_divergence", "density", "nmrd")}  # constant sides give no row
    assert table["overlap", "sem_sim"]["pearson_r"] == -table["kl_divergence", "sem_sim"]["pearson_r"] and table["overlap", "sem_sim"]["n"] == 5
