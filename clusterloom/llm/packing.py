"""Packing: length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import pick, stored
from clusterloom.llm.token_store import Encoder


def boundaries(histogram: list[tuple[int, int]], k: int) -> list[int]:
    """Upper bounds of at most k buckets with the least padding; histogram: (length, rows), in whole numbers throughout.

    Dynamic programming over the sorted lengths: least[j] is the least padding of the first j lengths in as many buckets
    as the round says. With n rows and t tokens up to a length, a bucket from i to j costs bound[j] * (n[j] - n[i]) -
    (t[j] - t[i]); so the best i for j is the lowest of the lines -n[i] * x + least[i] + t[i] at x = bound[j]. Both the
    slopes and x are monotone, so a round takes one pass over a lower envelope. Ties take the earlier split.
    """
    rows = sorted(histogram)
    bound, n, t = [r[0] for r in rows], [0], [0]
    for length, count in rows:
        n.append(n[-1] + count)
        t.append(t[-1] + length * count)
    m, cuts = len(rows), []
    least: list[int | None] = [0] + [None] * m
    for _ in range(min(k, m)):
        new: list[int | None] = [None] * (m + 1)
        cut = [0] * (m + 1)
        envelope: list[tuple[int, int, int]] = []  # (slope, height, i), slopes falling
        at = 0
        for j in range(1, m + 1):
            if (before := least[j - 1]) is not None:
                slope, height = -n[j - 1], before + t[j - 1]
                while len(envelope) > at + 1:
                    (s1, h1, _), (s2, h2, _) = envelope[-2:]
                    # The last line is nowhere lower than both the one before it and the new one.
                    if (h2 - h1) * (s1 - slope) < (height - h1) * (s1 - s2):
                        break
                    envelope.pop()
                envelope.append((slope, height, j - 1))
            if not envelope:
                continue
            x = bound[j - 1]
            while at + 1 < len(envelope) and envelope[at + 1][0] * x + envelope[at + 1][1] < envelope[at][0] * x + envelope[at][1]:
                at += 1
            slope, height, cut[j] = envelope[at]
            new[j] = slope * x + height + x * n[j] - t[j]
        cuts.append(cut)
        least = new
    out, j = [], m
    for cut in reversed(cuts):
        out.append(bound[j - 1])
        j = cut[j]
        if not j:
            break
    return sorted(out)


def pack(docs: DataFrame, length: Column, doc_id: str = "doc_id", *, buckets: int = 8, budget: int = 16384, run: int = 50_000) -> DataFrame:
    """(doc_id, length, bucket, batch_id, slot): every document in one batch.

    bucket is the padded length: the lowest of the chosen bounds that holds the document. A batch has documents of one
    bucket and at most ``budget`` padded tokens; a document above the budget is a batch of its own. batch_id is
    ``bucket:run:number``: inside a bucket, documents are dealt by a hash of their id over runs of about ``run``
    documents, which are numbered apart, so no task holds a whole bucket; the last batch of each run may be short.
    The driver gets the histogram: a row for each length that occurs, at most sqrt(2 * all tokens).

    Null and empty texts have length 0 (an own bucket of bound 0 may arise; its batches hold budget documents). Null
    ids and repeated rows are packed as rows of their own, ties broken by length. Empty tables give no rows. Other
    columns are not read.
    """
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    histogram = [(r["length"], r["n"]) for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()]
    bounds = boundaries(histogram, buckets)
    of, sizes = F.lit(None).cast("long"), {}
    for low, high in reversed(list(zip([-1, *bounds], bounds))):
        of = F.when(F.col("length") <= high, F.lit(high).cast("long")).otherwise(of)
        sizes[high] = sum(n for length, n in histogram if low < length <= high)
    runs = F.lit(1)
    for high, n in sizes.items():
        runs = F.when(F.col("bucket") == high, F.lit(max(1, -(-n // run)))).otherwise(runs)
    dealt = own.withColumn("bucket", of)
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64(F.col("doc_id"), F.col("length")), runs).cast("int"))
    order = Window.partitionBy("bucket", "run").orderBy("doc_id", "length")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    at = dealt.withColumn("at", F.row_number().over(order) - 1)
    return at.select(
        "doc_id",
        "length",
        "bucket",
        F.concat_ws(":", "bucket", "run", F.floor(F.col("at") / each).cast("long")).alias("batch_id"),
        F.pmod(F.col("at"), each).cast("int").alias("slot"),
    )


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, budget: int = 65_536, **how) -> DataFrame:
    """pack() with a text's UTF-8 bytes as length: the tokens of a byte-level model, and an upper bound for those of any
    byte-level vocabulary, so a batch is within its budget under each of them, texts without spaces included."""
    own = pick(docs, doc_id=doc_id, text=text)
    return pack(own, F.octet_length(own["text"]), budget=budget, **how)


def pack_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """pack() with the number of a tokenizer's tokens as length; ``path``: its JSON file. Texts of any length are counted
    whole, null and empty ones have no token. The lengths are counted once, and stored in the shared folder."""
    own = pick(docs, doc_id=doc_id, text=text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n = [len(b) // 4 for b in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "length"])

    kind = own.schema["doc_id"].dataType.simpleString()
    sized = stored(own.mapInArrow(count, f"doc_id {kind}, length long"), "lengths")
    return pack(sized, F.col("length"), **how)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
