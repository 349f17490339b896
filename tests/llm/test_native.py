import random

import pytest
from pyspark.sql import functions as F

from clusterloom.llm import quality_rules, url_filters


def repeat_words(words):
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(5))
    return len(hit)


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t\x0b", "a b c d e", "a " * 30, "x y z w v u " * 3 + "\n\n#*$% é ü."]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "é", "|", ".", "\r\n", "\x1c"]) + rng.choice(["", " "]) for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality_rules.judge(df).collect():
        t = texts[r["doc_id"]] or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().strip()]
        assert r["_q_n_words"] == len(words)
        assert r["_q_word_chars"] == sum(len(w.decode()) for w in words)
        assert r["_q_n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["_q_n_dup_lines"] == len(lines) - len(set(lines))
        assert r["_q_n_repeat_words"] == repeat_words(words)
        assert r["_q_base_failed"] == (len(words) < 10 or 100 * repeat_words(words) > 20 * len(words))
        assert not (r["_q_base_failed"] and r["_q_kept"])
    with pytest.raises(ValueError):
        quality_rules.judge(df.withColumn("_q_kept", F.lit(1)))
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_drops_lines_then_documents(spark):
    good = "This line is a sentence of ten words in all here.\n" * 1 + "Another quite different line says more things than the first one."
    rows = [
        (1, good + "\nHome | About | Contact |\nPlease enable javascript."),
        (2, "Home | News | Shop | About\nA$$$ b%%% c### d&&& e*** f$$$ g### h&&& i%%% j$$$."),
        (3, good),
    ]
    out = {r["doc_id"]: r for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == good and out[3]["text"] == good and set(out) == {1, 3}


def test_url_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?y", "https://example.com/en/", "https://a.net/es/1", "https://badnet/es/", "http://x.com", "http://bad.org/#a/b", "http://ok.org/1"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/z", 1) for i in range(60)] + [(200 + i, "http://ok.org/2", 1) for i in range(60)], "page_id long, url string, host int")
    bad = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filters.judge(pages, bad).collect()}
    assert [got[i]["rule"] for i in range(8)] == [None, None, None, "www.example.com/en/", "example.com/en/", "net/es/", None, None]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert (got[0]["host"], got[0]["path"], got[3]["host"], got[3]["path"]) == ("", "", "www.example.com", "/en/x")
    assert url_filters.judge(pages, bad.limit(0)).where("bad_low is not null").count() == 0
    assert url_filters.judge(pages.limit(0), bad).count() == 0


def test_priors_are_estimated_and_reach_new_hosts(spark):
    """Hosts without labels have their domain's record, suffixes of two labels are known, and weights follow the spread."""
    rng = random.Random(3)
    pages, bad, n = [], [], 0

    def add(host, rate, count):
        nonlocal n
        for _ in range(count):
            pages.append((n, f"https://{host}/x"))
            bad.append((n, int(rng.random() < rate)))
            n += 1

    for i in range(12):
        add(f"h{i}.spam.co.uk", 0.95, 30)
        add(f"h{i}.fine.co.uk", 0.02, 30)
        add(f"h{i}.mixed.org", 0.95 if i % 2 else 0.02, 30)
    new = ["new.spam.co.uk", "new.fine.co.uk", "new.mixed.org", "other.co.uk", "elsewhere.xyz"]
    pages += [(10_000 + i, f"https://{h}/") for i, h in enumerate(new)]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    got = {r["host"]: r for r in url_filters.judge(df, labels).collect()}
    assert got["new.spam.co.uk"]["verdict"] == "block" and got["new.fine.co.uk"]["verdict"] == "allow"
    # The mixed domain's hosts are either bad or good, so its record says little on a new one.
    assert got["new.mixed.org"]["verdict"] == "allow" and got["h1.mixed.org"]["verdict"] == "block" and got["h0.mixed.org"]["verdict"] == "allow"
    assert got["other.co.uk"]["verdict"] == got["elsewhere.xyz"]["verdict"] == "allow"
    assert url_filters.domain_of(F.lit("a.b.co.uk")) is not None


def test_beta_quantile(spark):
    """The closed form against a numerical integral of the density."""
    import numpy as np

    cases = [(2.0, 5.0), (30.0, 3.0), (1.5, 1.5), (100.0, 400.0), (0.3, 4.0), (3.0, 0.5), (0.5, 0.5), (8.0, 8.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    for r in df.select("a", "b", url_filters.beta_low(F.col("a"), F.col("b"), 1.645, 0.05).alias("x")).collect():
        t = np.linspace(0, 1, 400_002)[1:-1] if min(r["a"], r["b"]) > 1 else np.linspace(0, 1, 4_000_002)[1:-1]
        d = np.exp((r["a"] - 1) * np.log(t) + (r["b"] - 1) * np.log1p(-t))
        below = d[t <= r["x"]].sum() / d.sum()
        assert 0.02 < below < 0.09, (r, below)
