import random

import numpy as np

from clusterloom.llm import quality_model as qm


def page(rng, good):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(rng.randrange(12, 120))]
    if good:
        return " ".join(words) + "."
    if rng.random() < 0.5:
        return " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in words)
    return " ".join(w for w in words[:8] for _ in range(6)).upper()


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    # Bad pages come mostly from source s0, good ones hardly ever: the metadata tell something, too.
    rows = [(i, page(rng, good := i % 5 > 0), rng.choice(["en", "de", None]), "s0" if rng.random() < (0.03 if good else 0.97) else f"s{1 + i % 4}", int(good)) for i in range(900)]
    docs = spark.createDataFrame([r[:4] + (7.0,) for r in rows] + [(5000, None, None, None, 1.0), (5001, "", "en", "s1", 1.0), (None, "a b", "en", "s1", 1.0), (17,) + rows[17][1:4] + (2.0,)], "doc_id long, text string, lang string, source string, score double")
    docs = docs.selectExpr("*", "1 as p", "2 as view", "3 as y", "4 as x").repartition(3)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] < 300] + [(1, None), (None, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    model = qm.train(docs, labels, labelled=200, each=60)
    scored = qm.score(docs, model).collect()
    out = {r["doc_id"]: r for r in scored}
    assert len(out) == 903 and len(scored) == 904 and len({tuple(r) for r in scored if r["doc_id"] == 17}) == 1
    unseen = [r for r in rows if r[0] >= 300]
    right = np.mean([out[r[0]]["keep"] == bool(r[4]) for r in unseen])
    assert right > 0.97, right
    assert np.mean([(out[r[0]]["content_score"] >= 0.5) == bool(r[4]) for r in unseen]) > 0.9
    assert np.mean([(out[r[0]]["meta_score"] >= 0.5) == bool(r[4]) for r in unseen]) > 0.9
    assert qm.train(docs, labels.where("quality = 1")) is None
    assert qm.train(docs.limit(0), labels) is None
    assert {r["score"] for r in qm.score(docs, None).collect()} == {0.5}
    assert qm.score(docs.limit(0), model).count() == 0


def test_every_unlabelled_row_can_be_drawn(spark, monkeypatch):
    """What a round hands over are the surest rows of the whole table, by brute force over all scores."""
    rng = random.Random(5)
    rows = [(i, page(rng, i % 3 > 0), "en", f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    seen = []

    def cotrain(views, y, draw, rounds):
        model = plain(views, y, lambda w: [], 0)
        weights = (model.content, model.meta)
        seen.append((weights, draw(weights)))
        return model

    plain = qm.cotrain
    monkeypatch.setattr(qm, "cotrain", cotrain)
    qm.train(docs, labels, each=25, confident=0.6)
    weights, got = seen[0]
    import pyarrow as pa

    feats = {i: (c, m) for (i, *_), (_, c, m) in zip(rows, qm.features(pa.array([r[1].encode() for r in rows]), [r[2:] for r in rows]))}
    for view in (0, 1):
        p = {i: float(1 / (1 + np.exp(-qm.logits(feats[i][view], weights[view])))) for i in range(60, 400)}
        for label in (0.0, 1.0):
            own = [d for d, v, c, *_ in got if v == view and c == label]
            sure = sorted((max(q, 1 - q) for q in p.values() if (q > 0.5) == bool(label) and max(q, 1 - q) >= 0.6), reverse=True)
            assert len(own) == min(25, len(sure)) and not set(own) & set(range(60))
            assert np.allclose(sorted((max(p[d], 1 - p[d]) for d in own), reverse=True), sure[: len(own)], atol=1e-5)


def test_views_help_each_other():
    """With few labels, the surest guesses of one view teach the other: far fewer errors than from the labels alone."""
    errors = {True: 0.0, False: 0.0}
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 3000)
        y[:12] = [0, 1] * 6
        a, b = (rng.normal(size=(3000, 30)).astype(np.float32) for _ in (0, 1))
        a[:, 0] += 2 * (2 * y - 1)
        b[:, 1] += 2 * (2 * y - 1)
        pool = np.arange(12, 2000)

        def draw(weights):
            out = []
            for view, x in ((0, a), (1, b)):
                z = qm.logits(x[pool], weights[view])
                order = np.argsort(z)
                out += [(int(pool[i]), view, label, a[pool[i]], b[pool[i]]) for label, part in ((0.0, order[:200]), (1.0, order[-200:])) for i in part]
            return out

        for together in (True, False):
            model = qm.cotrain((a[:12], b[:12]), y[:12], draw if together else lambda w: [])
            errors[together] += ((model.score(a[2000:], b[2000:])[:, 0] >= 0.5) != y[2000:]).mean() / 6
    assert errors[True] < 0.6 * errors[False], errors
