import random

import numpy as np
import pyarrow as pa
import pytest

from clusterloom.llm import buckets, hashing, ngram_join
from clusterloom.llm import components as components_module
from clusterloom.llm.components import components


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(rng, n, hot=False):
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, base = [], [[rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 20, 40, 90, 200]))] for _ in range(25)]
    big = [rng.choice(vocab) for _ in range(50)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        elif hot and kind < 0.45:
            w = [rng.choice(vocab) for _ in range(rng.randrange(0, 50))] + passage
        elif hot and kind < 0.8:
            w = list(big)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 1 + max(1, len(w) // 30))):
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocab))
            if rng.random() < 0.3:
                w = w[rng.randrange(0, 4) :]
        rows.append((i, " ".join(w).replace("w1", "W1" if rng.random() < 0.3 else "w1")))
    return rows


def test_shingles_against_plain_python():
    rng = random.Random(2)
    texts = [None, "", " a ", "é É a\x0bB\x1cc", "x" * 5000] + ["".join(rng.choice("aB \n\té") for _ in range(rng.randrange(400))) for _ in range(50)]
    seen, sizes = {}, []
    for i, s in hashing.shingle_sets(pa.array([None if t is None else t.encode() for t in texts], pa.binary())):
        assert (np.diff(s.astype(object)) > 0).all()
        w = (texts[i] or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)
        sizes.append(i)
        if len(want) == 1:
            assert seen.setdefault(next(iter(want)), int(s[0])) == int(s[0])
    assert sizes == list(range(len(texts)))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in list(range(1, 40)) * 6 + [60, 100, 300, 1000]:
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        add = max(0, int((len(s) - drop) / 0.75 - len(s)))
        t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        common = len(np.intersect1d(s, t))
        if 100 * common < 75 * (len(s) + len(t) - common):
            continue
        assert ngram_join.sketches_near(ngram_join.sketch(s), len(s), ngram_join.sketch(t), len(t))
        a, b = ngram_join.signed(s), ngram_join.signed(t)
        assert set(np.concatenate([x for x, _, _ in a]).tolist()) & set(np.concatenate([x for x, _, _ in b]).tolist())
        # T signatures of a tag or more at the first level where either set guarantees some.
        ok = False
        for x, t, tag in a:
            for y, u, other in b:
                ok |= tag == other and len(set(x.tolist()) & set(y.tolist())) >= max(1, t, u)
        assert ok


@pytest.mark.parametrize("task", [1_000_000, 40])
def test_components(spark, monkeypatch, task):
    """In one task, and in rounds."""
    monkeypatch.setattr(components_module, "TASK", task)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = [(7, i) for i in range(100, 600)] + [(i, i + 1000) for i in range(100, 600, 7)] + [(3, 1100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(star, "a long, b long").repartition(9)).collect()}
    assert set(got.values()) == {3} and len(got) == 2 + 500 + 72


def test_components_of_documents(spark, monkeypatch):
    rng = random.Random(6)
    rows = corpus(rng, 260) + [(900, None), (901, " "), (902, ""), (903, "w1"), (904, "W1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as cls")
    got = sorted(map(tuple, ngram_join.linked_components(df).collect()))
    assert got == brute(rows)
    assert ngram_join.linked_components(df.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(buckets, "LARGE", 6)
    rows = corpus(random.Random(11), 260, hot=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.linked_components(df).collect()))
    assert got == brute(rows)


def test_large_buckets_give_every_link(spark, monkeypatch):
    monkeypatch.setattr(buckets, "LARGE", 6)
    rng = random.Random(12)
    rows = corpus(rng, 120, hot=True)
    big = [f"v{rng.randrange(300)}" for _ in range(120)]
    for i in range(60):
        w = list(big)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((500 + i, " ".join(w)))
    members, links = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[of[d]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets.pop(None, None)
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 500


def test_distinct_rows(spark):
    """One row of each component, whatever repeats: ids, rows, null ids, bare texts."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a + " and more"
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "z"), (2, near, "x"), (None, a, "x"), (3, b, "x"), (4, None, "x"), (5, "", "x"), (5, "", "x"), (None, " ", "x"), (6, "lone words " * 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stay_id string").repartition(3)
    got = sorted(((str(r["doc_id"]), r["text"]) for r in ngram_join.distinct(df).collect()), key=str)
    assert got == sorted([("1", a), ("1", b), ("4", None), ("5", ""), ("5", ""), ("None", " "), ("6", "lone words " * 3)], key=str)
    assert ngram_join.distinct(df).columns == df.columns and ngram_join.distinct(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, f"{a} {i}", "x") for i in range(5)] + [(i, f"{a} {i}", "x") for i in range(5)], "doc_id long, text string, k string")
    assert [r["doc_id"] for r in ngram_join.distinct(same).collect()] == [0]


def test_signing_does_no_work_twice(monkeypatch):
    """Numbers of subsets are mixed for the first set of a band only: for a later one its features and its signatures are."""
    rng, mixed, mix = np.random.default_rng(14), [], ngram_join.mix
    first, second = (np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    ngram_join.signed(first)
    monkeypatch.setattr(ngram_join, "mix", lambda x: mixed.append(x.size) or mix(x))
    signed = ngram_join.signed(second)
    parts = sum(n1 * ngram_join.SECOND for _, n1, _ in ngram_join._keys(len(second)))
    assert len(signed) == 2 and sum(mixed) <= len(second) + parts
    for values in ([], [5], [7, 7], [9, 1, 9, 3, 1]):
        assert (hashing.sorted_set(np.array(values, np.uint64)) == np.unique(np.array(values, np.uint64))).all()
