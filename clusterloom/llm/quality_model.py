"""Quality classifier by co-training: a content view and a metadata view teach each other on unlabelled pages.

The content view has the text's own features, the metadata view only the columns beside it (categories such as language
and source, alone and in pairs). Each round scores every unlabelled row of the corpus with both views in one distributed
pass, takes each view's surest rows of either class from all of them, and hands them to the other view.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import drop_stored, stored
from clusterloom.llm.hashing import slices, window_hashes, word_hashes

#: Columns of the content view (hashed byte trigrams, four of words, twelve of characters and lines) and of the metadata view.
TRIGRAMS, CONTENT, META = 1024, 1024 + 4 + 12, 128
_CLASSES = np.zeros(256, dtype=np.int64)  # 0 other, 1 letters, 2 capitals, 3 digits, 4 white space, 5 symbols, 6 ends, 7 beyond ASCII
_CLASSES[list(range(97, 123))] = 1
_CLASSES[list(range(65, 91))] = 2
_CLASSES[list(range(48, 58))] = 3
_CLASSES[[32, 9, 10, 11, 12, 13]] = 4
_CLASSES[list(b"#*$%&|<>")] = 5
_CLASSES[list(b".!?")] = 6
_CLASSES[128:] = 7


def features(texts: pa.Array, kinds: list[tuple[str | None, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, content, meta): the two views of each row. kinds: the row's categories, as language and source."""
    for first, data, offsets in slices(texts):
        words, of = word_hashes(data, offsets)
        bounds = np.searchsorted(of, np.arange(len(offsets)))
        five = window_hashes(words, 5) if len(words) >= 5 else words[:0]
        wide = data.astype(np.uint32)
        grams = ((wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)) if len(data) > 2 else wide[:0]
        for i in range(len(offsets) - 1):
            a, b, x, y = int(offsets[i]), int(offsets[i + 1]), int(bounds[i]), int(bounds[i + 1])
            n, w = b - a, y - x
            content = np.zeros(CONTENT, dtype=np.float32)
            if n > 2:
                counts = np.bincount(grams[a : b - 2], minlength=TRIGRAMS).astype(np.float32)
                counts = np.sqrt(counts)
                content[:TRIGRAMS] = counts / np.sqrt((counts * counts).sum()) * 4
            content[TRIGRAMS] = np.log1p(w) / 5
            if w:
                content[TRIGRAMS + 1] = 2 * len(np.unique(words[x:y])) / w
                content[TRIGRAMS + 2] = 2 * (words[x + 1 : y] == words[x : y - 1]).mean() if w > 1 else 0
            if w > 5:
                content[TRIGRAMS + 3] = 4 * (1 - len(np.unique(five[x : y - 4])) / (w - 4))
            share = np.bincount(_CLASSES[data[a:b]], minlength=8) / max(1, n)
            lines = int((data[a:b] == 10).sum()) + 1
            content[TRIGRAMS + 4 : TRIGRAMS + 12] = share * 4
            content[TRIGRAMS + 12 :] = np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 5, 1
            yield first + i, content, described(kinds[first + i])


def described(kinds: tuple[str | None, ...]) -> np.ndarray:
    """The metadata view of a row: its categories and their pairs, hashed."""
    meta = np.zeros(META, dtype=np.float32)
    named = [f"{k}={v}" for k, v in enumerate(kinds)]
    for name in named + [f"{x}&{y}" for i, x in enumerate(named) for y in named[:i]]:
        meta[zlib.crc32(name.encode()) % META] = 1
    return meta


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Weights of a logistic regression, intercept last, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = (weight / weight.sum()).astype(np.float32)
    step = np.float32(1 / (0.25 * float(((x * x).sum(axis=1) * weight).sum()) + ridge))
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(steps):
        grad = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - y)) + np.float32(ridge) * v
        new = v - step * grad
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with his targets inside (0, 1)."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        v = ab[0] * z + ab[1]
        return float((np.logaddexp(0, v) - target * v).sum() + 0.5 * (ab[0] - 1) ** 2)

    for _ in range(50):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -30, 30)))
        g = np.array([((p - target) * z).sum() + at[0] - 1, (p - target).sum()])
        s = p * (1 - p) + 1e-6
        d = np.linalg.solve(np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum()]]), g)
        step = next((2.0**-k for k in range(20) if loss(at - d * 2.0**-k) < loss(at)), 0.0)
        at = at - step * d
        if not step:
            break
    a, b = at
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(both views, content, metadata) probabilities of good quality. Both: the views' calibrated evidence, each beyond
        the prior log-odds, adds up."""
        z = [a * logits(x, w) + b for x, w, (a, b) in zip((content, meta), (self.content, self.meta), self.scales)]
        return np.stack([_sigmoid(v) for v in (z[0] + z[1] - self.prior, *z)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: A row that a view is sure of: its key, the view (0 content, 1 metadata), the label, and both views' features.
Guess = tuple[object, int, float, np.ndarray, np.ndarray]


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, draw: Callable[[tuple[np.ndarray, np.ndarray]], list[Guess]], rounds: int = 3) -> Model | None:
    """Two regressions that hand each other their confident guesses on unlabelled rows; None without both classes.

    Every third labelled row is kept out for the calibration. A round fits both views on the labelled rows and what the
    other view has handed over so far (at half weight); draw(weights of both views) then gives the surest guesses. A row
    keeps the first label that it got.
    """
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), dtype=bool)
    given: tuple[dict, dict] = ({}, {})  # for each view: what it got from the other
    weights: list[np.ndarray] = []
    for r in range(rounds + 1):
        weights = []
        for v in (0, 1):
            more = list(given[v].values())
            x = np.vstack([views[v][~held], *[g[None] for g, _ in more]])
            t = np.concatenate([y[~held], [label for _, label in more]]).astype(np.float32)
            w = np.concatenate([np.ones((~held).sum()), np.full(len(more), 0.5)])
            for c in (0, 1):  # classes weigh alike in sum, up to a factor
                if (t == c).any():
                    w[t == c] *= (w.sum() / w[t == c].sum()) ** 0.5
            weights.append(fit(x, t, w))
        if r < rounds:
            for key, view, label, *features_ in draw((weights[0], weights[1])):
                given[1 - view].setdefault(key, (features_[1 - view], label))
    on = held if held.any() else np.ones(len(y), dtype=bool)
    scales = tuple(calibrate(logits(views[v][on], weights[v]).astype(np.float64), y[on]) for v in (0, 1))
    good = (float(y[on].sum()) + 1) / (int(on.sum()) + 2)
    return Model(weights[0], weights[1], scales, float(np.log(good / (1 - good))))


def _own(docs: DataFrame, doc_id: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].cast("binary").alias("text"), *[docs[f"`{c}`"].cast("string").alias(f"kind{i}") for i, c in enumerate(kinds)])
    return own


def _kinds_of(batch: pa.RecordBatch, first: int) -> list[tuple]:
    """The categories of each row: the columns from ``first`` on."""
    return list(zip(*(batch.column(i).to_pylist() for i in range(first, batch.num_columns)))) if batch.num_columns > first else [()] * len(batch)


def _in_chunks(batch: pa.RecordBatch, kinds: list[tuple], size: int = 1000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, content, meta) of so many rows of a batch at a time; its column 1 is the text."""
    rows, at = [], 0
    for _, c, m in features(batch.column(1), kinds):
        rows.append((c, m))
        if len(rows) == size:
            yield at, np.stack([c for c, _ in rows]), np.stack([m for _, m in rows])
            at, rows = at + size, []
    if rows:
        yield at, np.stack([c for c, _ in rows]), np.stack([m for _, m in rows])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = ("lang", "source"), quality: str = "quality", *, labelled: int = 6000, each: int = 500, confident: float = 0.9, rounds: int = 3) -> Model | None:
    """A model from at most ``labelled`` labelled rows, those with the smallest hashes of their ids; None if the labels don't
    have both classes. Ids with several labels take their mean, from a half on good.

    In each of the ``rounds``, each view scores all rows of docs that have an id and no label, and hands over the ``each``
    of either class that it is surest of, beyond ``confident``. A repeated id counts once. The passes run when this is called.
    """
    marks = labels.select(labels[f"`{doc_id}`"].alias("doc_id"), labels[f"`{quality}`"].alias("q")).where("doc_id is not null and q is not null")
    marks = marks.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("float").alias("y"))
    own = _own(docs, doc_id, text, kinds).where("doc_id is not null")
    kind = own.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c.tobytes() + m.tobytes() for _, c, m in features(batch.column(1), _kinds_of(batch, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    def described_rows(ids: DataFrame) -> dict:
        """The features of ids, of which there are few."""
        got = own.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(describe, f"doc_id {kind}, x binary").groupBy("doc_id").agg(F.max("x").alias("x"))
        rows = got.toArrow().to_pylist()
        return {r["doc_id"]: np.frombuffer(r["x"], dtype=np.float32) for r in sorted(rows, key=lambda r: str(r["doc_id"]))}

    some = own.select("doc_id").distinct().join(marks, "doc_id").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(labelled)
    target = {r["doc_id"]: r["y"] for r in some.collect()}  # ``labelled`` rows at most
    if len(set(target.values())) < 2:
        return None
    spark = docs.sparkSession
    x = described_rows(spark.createDataFrame([(d,) for d in target], f"doc_id {kind}"))
    order = sorted(x, key=lambda d: (zlib.crc32(str(d).encode()), str(d)))
    y = np.array([target[d] for d in order])
    table = np.stack([x[d] for d in order])

    def draw(weights: tuple[np.ndarray, np.ndarray]) -> list[Guess]:
        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, *both in _in_chunks(batch, _kinds_of(batch, 2)):
                    for view in (0, 1):
                        p = _sigmoid(logits(both[view], weights[view]))
                        sure = np.maximum(p, 1 - p)
                        rows = np.flatnonzero(sure >= confident)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(rows + at)), pa.array(np.full(len(rows), view, np.int32)), pa.array((p[rows] > 0.5).astype(np.float32)), pa.array(sure[rows].astype(np.float64))], names=["doc_id", "view", "y", "p"]
                        )

        sure = own.mapInArrow(guess, f"doc_id {kind}, view int, y float, p double").join(marks.select("doc_id"), "doc_id", "left_anti")
        sure = stored(sure.groupBy("doc_id", "view").agg(F.max(F.struct("p", "y")).alias("s")).select("doc_id", "view", "s.y", "s.p"), "guesses")
        best = [sure.where((F.col("view") == v) & (F.col("y") == c)).orderBy(F.desc("p"), F.xxhash64("doc_id"), "doc_id").limit(each) for v in (0, 1) for c in (0.0, 1.0)]
        chosen = [(r["doc_id"], r["view"], r["y"]) for b in best for r in b.collect()]  # 4 * ``each`` rows at most
        drop_stored(sure)
        if not chosen:
            return []
        of = described_rows(spark.createDataFrame([(d,) for d in {d for d, _, _ in chosen}], f"doc_id {kind}"))
        return [(d, view, label, of[d][:CONTENT], of[d][CONTENT:]) for d, view, label in chosen]

    return cotrain((table[:, :CONTENT], table[:, CONTENT:]), y, draw, rounds)


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = ("lang", "source"), *, limit: float = 0.5) -> DataFrame:
    """(doc_id, score, content_score, meta_score, keep): every row of docs; keep: the score is ``limit`` or more.

    Null texts count as empty and null categories are a category; texts of any length are read whole. Without a model (no labels, or of one class only) all
    scores are 0.5. Repeated rows score alike, an empty table gives none, other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((len(batch), 3), 0.5)
            for at, content, meta in _in_chunks(batch, _kinds_of(batch, 2)) if model is not None else ():
                out[at : at + len(content)] = model.score(content, meta)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.round(out[:, k], 6)) for k in range(3)], pa.array(np.round(out[:, 0], 6) >= limit)], names=["doc_id", "score", "content_score", "meta_score", "keep"])

    own = _own(docs, doc_id, text, kinds)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, score double, content_score double, meta_score double, keep boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
