import random
from itertools import combinations

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clusterloom.llm import packing


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram)


def test_boundaries_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        lengths = rng.sample(range(rng.choice([12, 900, 20_000, 1 << 40])), rng.randrange(1, 9))
        histogram = [(x, rng.randrange(1, 6)) for x in lengths]
        rng.shuffle(histogram)
        k = rng.randrange(1, 5)
        got = packing.boundaries(histogram, k)
        best = min(padding(histogram, [*c, max(lengths)]) for c in combinations(sorted(lengths)[:-1], min(k, len(lengths)) - 1))
        assert padding(histogram, got) == best and len(got) <= k and set(got) <= set(lengths)
    assert packing.boundaries([], 3) == []


def test_batches_hold_every_row_and_the_budget(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300) if rng.random() < 0.9 else None, rng.choice([0, 1, 5, 600, 601, 5000, 40_000])) for _ in range(500)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long").selectExpr("*", "1 as bucket", "2 as length").repartition(3)
    out = packing.pack(docs, F.col("n"), buckets=3, budget=16_384, run=100).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in out) == sorted((d or -1, n or 0) for d, n in rows)
    batches = {}
    for r in out:
        assert r["length"] <= r["bucket"]
        batches.setdefault(r["batch_id"], []).append(r)
    for batch in batches.values():
        assert len({r["bucket"] for r in batch}) == 1 and sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or sum(r["bucket"] for r in batch) <= 16_384 or not batch[0]["bucket"]
    histogram = [(n, sum((m or 0) == n for _, m in rows)) for n in {m or 0 for _, m in rows}]
    assert sorted({r["bucket"] for r in out}) == packing.boundaries(histogram, 3)
    assert packing.pack(docs.limit(0), F.col("n")).count() == 0


def test_bounds_are_real_lengths(spark):
    """Each bucket is padded to its longest document, at any length."""
    lengths = [3, 40, 511, 513, 515, 1001, 1003, 2050, 5003, 9999]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.pack(docs, F.col("n"), buckets=4).collect()
    assert sorted(r["length"] for r in rows) == lengths
    longest = {}
    for r in rows:
        longest[r["bucket"]] = max(r["length"], longest.get(r["bucket"], 0))
    assert all(bucket == most for bucket, most in longest.items()) and len(longest) == 4


def test_lengths_of_texts(spark):
    """Bytes bound the tokens of byte-level vocabularies; a tokenizer's own counts are the library's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), [None, "", "don't stop", "é" * 5000, "x" * 70_000, "a b\n\n c  d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as length", "'x' as batch_id")
    tokens = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["length"] for r in packing.pack_tokens(docs, path).collect()} == tokens
    got = {r["doc_id"]: r["length"] for r in packing.pack_texts(docs).collect()}
    assert got == {i: len((t or "").encode()) for i, t in enumerate(texts)} and all(tokens[i] <= got[i] for i in got)
