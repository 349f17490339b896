import random

from clusterloom.llm import decontaminate as dc


def best_edits(pattern, text):
    """The least edits of the pattern against any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_banded_alignment_against_the_full_table():
    rng = random.Random(1)
    for _ in range(400):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        t = [rng.choice("abc") for _ in range(rng.randrange(0, 20))]
        k = rng.randrange(0, 5)
        want, got = best_edits(p, t), dc.edits_within(p, t, k)
        assert (got[0] if got else None) == (want if want <= k and len(t) - len(p) + 2 * k + 1 > 0 else None)
        if got:
            assert best_edits(p, t[got[1] : got[2]]) == got[0]


def plain(text):
    s = " ".join("".join(c if c not in "\x0b\x0c\t\n\r" else " " for c in text).split(" ")).strip(" ")
    s = " ".join(x for x in s.split(" ") if x)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def as_words(item, text):
    """Whether the item stands in the text verbatim, from a word's start to a word's end."""
    joined = lambda a, b: a.isalnum() and b.isalnum()
    return any(
        text.startswith(item, at) and not (at and joined(text[at - 1], item[0])) and not (at + len(item) < len(text) and joined(item[-1], text[at + len(item)])) for at in range(len(text))
    )


def test_short_items_stand_verbatim(spark):
    items = [(1, "a"), (2, "New York"), (3, "x y"), (4, " "), (5, "(b)"), (6, "new york")]
    docs = [(1, "A new\nYORK minute"), (2, "anew york"), (3, "new yorker a"), (4, "(B)a"), (5, ""), (6, None), (7, "x  y new york new york"), (8, "ax ya")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in docs for i, it in items if t and plain(it) and as_words(plain(it), plain(t))}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 5
    assert {(r["n_windows"], r["start"], r["end"]) for r in got if r["doc_id"] == 7 and r["item_id"] == 2} == {(2, 5, 22)}


def test_no_region_within_the_budget_is_filtered_out():
    """Items of 20 to 80 characters, with as many edits as the budget allows at the worst places."""
    rng = random.Random(11)
    for n in range(20, 81):
        item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        budget = min(6, n * 6 // 80)
        for _ in range(12):
            t, places = list(item), sorted(rng.sample(range(n), budget))
            if rng.random() < 0.5 and budget:
                places = [min(n - 1, (k + 1) * n // (budget + 1)) for k in range(budget)]
            for k in places:
                t[k] = rng.choice(["#", "", t[k] + "#"])
            text = "0123456789 " * 3 + "".join(t) + " 9876543210" * 3
            c, at = dc.normalised(text.encode())
            assert any(x.search(c, at) for x in dc.Index.of([(1, item)], 10, 80, 1, 0.075)), (n, places)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgéß", k=rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 8, 12, 30, 45])] + [(7, None), (8, "")]
    docs = [(500, None), (501, ""), (502, "a")]
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            t = rng.choice(items[:5])[1]
            for _ in range(rng.randrange(0, 12)):
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice(["", "x", "yz", t[k].upper()]) + t[k + 1 :]
            if rng.random() < 0.3:
                t = t[rng.randrange(len(t)) :]
            w.insert(rng.randrange(len(w) + 1), t.replace(" ", rng.choice([" ", "\n", " \t"])))
        docs.append((d, " ".join(w)))
    window, step, share = 40, 20, 0.1
    want = set()
    for d, t in docs:
        for i, it in items:
            c = plain(it or "")
            if not c or t is None:
                continue
            if len(c) < 16:
                if as_words(c, plain(t)):
                    want.add((d, i))
                continue
            last = max(0, len(c) - window)
            for s in {*range(0, last, step), last}:
                part = c[s : s + window]
                if best_edits(part, plain(t)) <= min(4, len(part) * 4 // window):
                    want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as version").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    how = {"q": 8, "window": window, "step": step, "share": share}
    got = dc.contaminated(df, bench, **how).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 15
    by_id = dict(docs)
    assert all(0 <= r["start"] < r["end"] <= len(by_id[r["doc_id"]]) for r in got)
    left = dc.clean(df, bench, **how)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(20))) for i in range(12)]
    docs = [(i, "x " * 10 + items[i % 12][1] + " y" * 5) for i in range(24)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(df, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, dc.contaminated(df, bench).collect())) == whole and len(whole) == 24


def test_windows_of_an_item_at_once():
    rng, np = random.Random(6), dc.np
    for _ in range(150):
        item = np.array([ord(rng.choice("abc")) for _ in range(rng.randrange(6, 20))])
        text = np.array([ord(rng.choice("abc")) for _ in range(rng.randrange(1, 40))])
        size, k = rng.randrange(1, len(item) + 1), rng.randrange(0, 4)
        starts = np.arange(len(item) - size + 1)
        low = np.array([rng.randrange(0, len(text)) for _ in starts])
        high = np.array([rng.randrange(x, len(text) + 1) for x in low])
        e, x, y = dc.edits_of_windows(item, starts, size, text, low, high, k)
        for i, s in enumerate(starts.tolist()):
            part, stretch = item[s : s + size].tolist(), text[low[i] : high[i]].tolist()
            got = dc.edits_within(part, stretch, k)
            assert (e[i] if e[i] <= k else None) == (got[0] if got else None)
            if got:
                assert best_edits(part, stretch[x[i] : y[i]]) == e[i]


def test_excerpts_between_grid_points(spark):
    """Any stretch of 80 characters of an item is found, wherever it starts, also with edits, by brute force over all starts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9)))
    c = plain(" ".join(word() for _ in range(45)))
    fill = lambda: " ".join("".join(rng.choices("nopqrstuvw", k=5)) for _ in range(12))
    docs = []
    for d, s in enumerate(range(3, len(c) - 85, 9)):
        t = c[s : s + 82 - 3 * (d % 4)]
        for _ in range(d % 9):
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        docs.append((d, f"{fill()} {t} {fill()}"))
    want = {d for d, t in docs if any(best_edits(c[s : s + 80], plain(t)) <= 6 for s in range(len(c) - 79))}
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, c)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == want and 5 < len(want) < len(docs)
