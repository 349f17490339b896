import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom import __main__ as cli
from clusterloom import storage
from clusterloom.functions import text as T
from clusterloom.operators import labels, quality, sampling
from clusterloom.plans import reports
from clusterloom.sources import readers


class Service(BaseHTTPRequestHandler):
    """A chat service that is busy at first; it keeps what it was asked."""

    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append((body, self.headers.get("Authorization")))
        prompt = body["messages"][0]["content"]
        if prompt == "broken" or len(Service.asked) == 1:
            self.send_response(500 if prompt == "broken" else 429)
            self.end_headers()
            self.wfile.write(b"please try again in 0.01s")
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": f" {prompt.upper()} \n"}}]}).encode())

    def log_message(self, *_):
        pass


def test_http_labeller(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    labeller = labels.HttpLabeller(f"http://127.0.0.1:{server.server_port}/chat", "some-model")
    rows = spark.createDataFrame([("a", "sport"), ("b", "broken"), ("c", "news")], "label string, prompt string").coalesce(1)
    got = {r["label"]: r["generated"] for r in labels.labelled(rows, labeller).collect()}
    server.shutdown()
    assert got == {"a": "SPORT", "b": T.NO_LABEL, "c": "NEWS"}
    assert all(b["temperature"] == 0 and b["max_tokens"] == 30 and b["model"] == "some-model" for b, _ in Service.asked)
    assert len(Service.asked) == 4  # the busy answer was asked again


def test_embedders(spark):
    df = spark.createDataFrame([(0, "a a b"), (1, None), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in labels.hashed_embedder(16)(df, "text").collect()}
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-9 and sorted(set(got[0]))[-1] == pytest.approx(2 / 5**0.5) and set(got[1]) == {0.0}

    def load():
        return lambda texts: np.array([[len(t), 3.0] for t in texts])

    got = {r["doc_id"]: r["embedding"] for r in labels.model_embedder(load, batch=2)(df, "text").collect()}
    assert got[0] == pytest.approx([5 / 34**0.5, 3 / 34**0.5]) and got[1] == [0.0, 1.0]


def test_posts(spark, tmp_path):
    posts = [
        (1, "From: a\nSubject: b\n\nHello there.\n> quoted\nA friend wrote:\nMore.\n--\nName", "x", "train"),
        (2, "no blank line", "y", "train"),
        (3, "H: 1\n\nOne line", "y", "test"),
        (4, "H: 1\n\n\nFirst\n\nLast", "y", "test"),
    ]
    spark.createDataFrame(posts, "doc_id long, text string, label string, subset string").write.parquet(f"{tmp_path}/p")
    got = lambda *a: {r["doc_id"]: r["text"] for r in readers.read_posts(spark, f"{tmp_path}/p", *a).collect()}
    assert got() == {1: "Hello there.\nMore.", 3: "One line", 4: "First"}
    assert got("test") == {3: "One line", 4: "First"} and got("all", False) == {r[0]: r[1] for r in posts}
    with pytest.raises(ValueError):
        readers.read_posts(spark, f"{tmp_path}/p", "dev")


def test_nmrd_in_blocks(spark, monkeypatch):
    """Units and blocks of any size give the same ranks, ties included."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 3)) + 0.5
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).astype(float)  # many are equal
    rows = [(i, int(i % 4) if i < 59 else 9, [float(x) for x in v[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, embedding array<float>")
    whole = {r["label"]: r["nmrd"] for r in quality.nmrd(df).collect()}
    monkeypatch.setattr(quality, "DOCS", 11)
    monkeypatch.setattr(quality, "UNIT", 40)
    parts = {r["label"]: r["nmrd"] for r in quality.nmrd(df).collect()}
    assert whole[9] is None and parts[9] is None and all(whole[k] == pytest.approx(parts[k]) for k in range(4))
    # Brute force.
    for label in range(4):
        own, scores = [i for i in range(59) if i % 4 == label], []
        for q in own:
            order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(v[i] @ v[q]), 10), i))
            place = {d: k + 1 for k, d in enumerate(order)}
            best = np.mean([1 / k for k in range(1, len(own))])
            scores.append(np.mean([1 / place[d] for d in own if d != q]) / best)
        assert whole[label] == pytest.approx(np.mean(scores))


def test_split_takes_exact_quotas(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("label"), F.lit("t").alias("text"))
    out = sampling.stratified_split(df, "label", "doc_id")
    assert {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()} == {(str(k), s): n for k, c in ((0, 1667), (1, 1667), (2, 1666)) for s, n in (("test", {0: 334, 1: 333, 2: 333}[k]), ("dev", c - {0: 334, 1: 333, 2: 333}[k]))}
    assert out.count() == 5000 and set(out.columns) == {"doc_id", "label", "text", "split"}
    first = sorted(r["doc_id"] for r in out.where("split = 'test'").collect())
    assert first == sorted(r["doc_id"] for r in sampling.stratified_split(df.repartition(7), "label", "doc_id").where("split = 'test'").collect())


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster(), "x")
    df = storage.stored(spark.range(3).toDF("x"), "t")
    path = df.stored_at.removeprefix("file:")
    assert os.path.isdir(path) or os.path.isdir("/" + path.lstrip("/"))
    storage.drop_stored(df)
    assert not os.path.exists("/" + path.lstrip("/"))


def test_tables_for_the_console(spark):
    q = spark.createDataFrame([("a", 0.5, None, 1.25, 0.1, None), ("b", 1.0, 0.25, 0.75, 0.3, float("nan"))], "cluster string, voorhees_nn double, overlap double, kl_divergence double, density double, nmrd double")
    rows = [tuple(r) for r in reports.quality_table(q).collect()]
    assert rows[0] == ("a", "0.5000", "-", "1.2500", "0.1000", "-") and rows[2][:5] == ("MEAN", "0.7500", "0.2500", "1.0000", "0.2000")
    t = spark.createDataFrame([("d", "overlap", "tok_f1", 5, 0.9, 0.01, -0.4, 0.5)], "dataset string, measure string, metric string, n long, pearson_r double, pearson_p double, spearman_r double, spearman_p double")
    assert tuple(reports.correlation_lines(t).first()) == ("d", "Overlap", "Token F1", 5, "+0.900 *", "0.0100", "-0.400", "0.5000")


def test_command_line(spark, tmp_path, capsys):
    rows = [(i, f"word{i % 7} thing{i % 3} other words here", f"l{i % 3}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, label string").write.parquet(f"{tmp_path}/docs")
    for argv in (["stats"], ["graph", "--threshold", "0.3"], ["quality"], ["subclusters", "--counts", "1", "2"], ["sweep", "--grid", "short"]):
        cli.main([argv[0], "--path", f"{tmp_path}/docs", "--output", f"{tmp_path}/{argv[0]}", *argv[1:]])
    assert spark.read.csv(f"{tmp_path}/graph/nodes", header=True).count() == 30
    assert spark.read.csv(f"{tmp_path}/subclusters/subclusters", header=True).count() == 6
    record = readers.read_results(spark, f"{tmp_path}/sweep/results.json").first()
    assert len(record["dev_sweep"]) == 9 and set(record["test_result"]["labels"]) == {"l0", "l1", "l2"}
    scores = readers.read_test_scores(spark, f"{tmp_path}/sweep/results.json")
    assert scores.count() == 3 and "MEAN" in capsys.readouterr().out
