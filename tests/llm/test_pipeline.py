import os
import random

import corpus_pipeline
from clusterloom.llm import quality_rules
from test_decontaminate import best_edits, plain
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_components


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghéß", k=rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(4, 20))) + "."
    base = ["\n".join(sentence() for _ in range(4)) for _ in range(12)]
    item = " ".join(word() for _ in range(25))
    common = sentence()
    docs = []
    for i in range(140):
        t = rng.choice(base) if i % 3 == 0 else "\n".join(sentence() for _ in range(rng.randrange(1, 6)))
        if i % 3 == 0 and rng.random() < 0.7:
            w = t.split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 7 == 0:
            t += "\n" + common
        if i % 11 == 0:
            t = " ".join(f"{w}$$$" for w in t.split())
        if i % 13 == 0:
            t += "\nStart " + item + " end."
        docs.append((i, t, "en", "s", len(t)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in quality_rules.clean(frame).collect()]
    gone = brute_lines(rows)
    rows = [(d, "\n".join(ln for n, ln in enumerate(t.split("\n")) if n not in gone.get(d, []))) for d, t in rows]
    rows = [(d, t) for d, t in rows if t.strip()]
    keep = {d for d, _, c in brute_components(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in keep]
    c = plain(item)
    windows = [c[s : s + 80] for s in range(max(1, len(c) - 79))]
    rows = [(d, t) for d, t in rows if not any(best_edits(w, plain(t)) <= min(6, len(w) * 6 // 80) for w in windows)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((d, len(t.encode())) for d, t in rows)
    assert 20 < len(rows) < 130

    # Of all that was stored on the way, the rows that the last stage reads are left.
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(root)) - before) == 1
    stage = frame
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == frame.columns, name


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, a very long text, clashing columns and an empty table, stage by stage."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randrange(2, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    copy, twice = prose(4), prose(3)
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (3, twice), (3, prose(3)), (None, None), (4, ""), (5, " \n "), (None, prose(2)), (6, prose(9000))]
    names = ["_hit_id", "_stay_id", "_gone_id", "_q_found", "version", "key", "length", "lines"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars", *[f"'x' as `{n}`" for n in names]).repartition(3)
    spark.createDataFrame([(0, prose(2)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = sorted((str(d), t) for d, t in {r for r in rows if (r[1] or "").strip() and r[1] != copy}) + [("1", copy)]
    for start in (df, df.limit(0)):
        stage, kept = start, []
        for name, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, str(tmp_path))
            assert stage.columns == df.columns, name
            kept.append(sorted((str(r["doc_id"]), r["text"]) for r in stage.collect()))
        packed = corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path)).collect()
        assert sorted((str(r["doc_id"]), r["length"]) for r in packed) == sorted((d, len(t.encode())) for d, t in kept[-1])
        if start is df:
            assert len(kept[0]) == 8 and set(kept[2]) == set(kept[3]) == set(good) and len(kept[3]) == len(good)
    # Near-copy removal alone, on what other stages would have dropped.
    left = [(str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted(good + [("None", None), ("4", ""), ("5", " \n ")], key=str)
