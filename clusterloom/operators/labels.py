"""Prompts, labels by a pluggable labeller, and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions import text as T
from clusterloom.functions.vectors import dot, normalized

#: The default wording; any template with {k} and {documents_block} will do.
TEMPLATE = "Below are {k} documents of one group, the most typical ones first.\n\n{documents_block}\n\nName what they share in one to four words. Answer with the name alone."


def prompts(central: DataFrame, max_words: int = 300, template: str | None = None) -> DataFrame:
    """(label, k, prompt): each cluster's documents in rank order. central: (label, rank, text).

    Null texts count as empty. Without a template the prompt is the documents' block alone.
    """
    entry = T.prompt_entry(F.col("rank"), F.coalesce("text", F.lit("")), max_words)
    blocks = central.groupBy("label").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("entries"))
    block = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n\n")
    return blocks.select("label", "k", (T.filled(template, F.col("k"), block) if template else block).alias("prompt"))


class Labeller(Protocol):
    """Turns prompts into labels; the object is sent to the tasks."""

    def __call__(self, prompt: str) -> str | None: ...


class RateLimited(Exception):
    """A labeller's service asks to wait; the message names how long."""


def labelled(prompted: DataFrame, labeller: Labeller, retries: int = 5, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """(label, generated): one call a cluster, tried again after the wait that a rate limit names; other errors and
    empty answers give NO_LABEL."""
    kind = dict(prompted.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            out = []
            for prompt in batch.column(1).to_pylist():
                answer = None
                for _ in range(retries):
                    try:
                        answer = labeller(prompt)
                        break
                    except RateLimited as limit:
                        (sleep or time.sleep)(T.wait_of(str(limit)))
                    except Exception:  # any failure of an outside service is "no label"
                        break
                out.append((answer or "").strip() or T.NO_LABEL)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["label", "generated"])

    return prompted.select("label", "prompt").mapInArrow(run, f"label {kind}, generated string")


@dataclass(frozen=True)
class HttpLabeller:
    """A labeller that asks a chat service: temperature 0, ``tokens`` tokens at most. The key is read from the named
    variable on the worker, so it is in no plan. Too many requests (status 429) raise RateLimited."""

    url: str
    model: str
    key_variable: str = ""
    tokens: int = 30
    timeout: float = 60.0

    def __call__(self, prompt: str) -> str | None:
        import json
        import os
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        body = {"model": self.model, "temperature": 0, "max_tokens": self.tokens, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        try:
            with urlopen(Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except HTTPError as e:
            if e.code == 429:
                raise RateLimited(e.read().decode("utf-8", "replace")) from e
            raise


def extractive(docs: DataFrame, label: str = "label", text: str = "text", terms: int = 3) -> DataFrame:
    """(label, generated): the terms that mark each cluster, without any model.

    A term weighs its occurrences in the cluster times ln(1 + clusters / clusters that have it); ties go by the term.
    """
    own = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(T.tokens(F.col(text))).alias("term"))
    counts = own.groupBy("label", "term").agg(F.count("*").alias("tf"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.select("label").distinct().agg(F.count("*").alias("n"))
    weighed = counts.join(spread, "term").join(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log(1 + F.col("n") / F.col("df")), 6))
    best = weighed.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.col("weight").desc(), "term"))).where(F.col("at") <= terms)
    named = best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t")).select("label", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("generated"))
    return docs.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().join(named, "label", "left").select("label", F.coalesce("generated", F.lit(T.NO_LABEL)).alias("generated"))


Embedder = Callable[[DataFrame, str], DataFrame]


def hashed_embedder(buckets: int = 256) -> Embedder:
    """An offline embedder: adds (column) embedding, the unit vector of a text's hashed token counts."""

    @F.pandas_udf("array<double>")
    def counted(at: pd.Series) -> pd.Series:
        return at.map(lambda x: np.bincount(x, minlength=buckets).astype(np.float64))

    def embed(df: DataFrame, column: str) -> DataFrame:
        at = F.transform(T.tokens(F.coalesce(F.col(column), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        return df.withColumn("embedding", counted(at)).withColumn("embedding", normalized(F.col("embedding")))

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Embedder:
    """An embedder with a model of the user's: load() runs once in each Python worker and gives a function from texts to
    a matrix of their vectors, which gets ``batch`` texts at a time. Null texts are empty; vectors are put to length one."""

    @F.pandas_udf("array<double>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            texts = ["" if t is None else t for t in part.tolist()]
            rows = [row for i in range(0, len(texts), batch) for row in np.asarray(encode(texts[i : i + batch]), dtype=np.float64)]
            yield pd.Series(rows, dtype=object)

    return lambda df, column: df.withColumn("embedding", encoded(F.col(column))).withColumn("embedding", normalized(F.col("embedding")))


def scores(named: DataFrame, embedder: Embedder | None = None, truth: str = "label", generated: str = "generated") -> DataFrame:
    """(label, sem_sim, tok_f1) of generated labels; sem_sim is the cosine of both labels' embeddings."""
    embed = embedder or hashed_embedder()
    own = named.select(F.col(truth).cast("string").alias("label"), F.col(generated).alias("generated"))
    own = embed(own, "label").withColumnRenamed("embedding", "a")
    own = embed(own, "generated").withColumnRenamed("embedding", "b")
    return own.select("label", dot(F.col("a"), F.col("b")).alias("sem_sim"), T.token_f1(F.col("label"), F.col("generated")).alias("tok_f1"))


def mean_scores(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg("sem_sim").alias("sem_sim"), F.avg("tok_f1").alias("tok_f1"))
