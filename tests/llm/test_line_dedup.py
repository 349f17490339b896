import random

import numpy as np
from pyspark.sql import functions as F

from clusterloom.llm import jvm, line_dedup


def grams(s):
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return {s[i : i + line_dedup.GRAM] for i in range(len(s) - line_dedup.GRAM + 1)} or {s}


def brute(rows, similarity=0.75):
    lines = [(d, n, ln) for d, t in rows for n, ln in enumerate((t or "").split("\n")) if t is not None and ln.strip(" \t\n\v\f\r")]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [grams(x[2]) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c >= similarity * (len(sets[i]) + len(sets[j]) - c):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    gone = {}
    for i, (d, n, _) in enumerate(lines):
        if find(i) != i:
            gone.setdefault(d, []).append(n)
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(3, 30))) for _ in range(25)]
    rows = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "short\nshort\nabc\n \t\n \t"), (1004, ""), (1005, "ABC\nabd\n\n\nshort line\nShort line"), (1006, "shout line")]
    for d in range(120):
        own = []
        for _ in range(rng.randrange(0, 6)):
            ln = rng.choice(base) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(1, 20)))
            if rng.random() < 0.4 and len(ln) > 60:
                k = rng.randrange(len(ln))
                ln = ln[:k] + "X" + ln[k + 1 :]
            own.append(ln.upper() if rng.random() < 0.1 and ln.isascii() else ln)
        rows.append((d, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lines", "1 as version", "2 as key").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.summary(df).collect()}
    want = brute(rows)
    assert {d: r for d, (_, r) in got.items() if r} == want
    assert {d: n for d, (n, _) in got.items()} == {d: len(t.split("\n")) if t is not None else 0 for d, t in rows}
    left = {r["doc_id"]: r["text"] for r in line_dedup.clean(df).collect()}
    for d, t in rows:
        kept = [ln for n, ln in enumerate((t or "").split("\n")) if n not in want.get(d, [])]
        assert left.get(d, "") == ("\n".join(kept) if "".join(kept).strip() else "")
    assert line_dedup.clean(df).columns == df.columns
    assert line_dedup.summary(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    line = "this line has more than twenty characters"
    rows = [(1, line), (1, line), (None, line), (2, line + "\nother words of a line that stands alone")]
    got = sorted((str(r["doc_id"]), r["removed"]) for r in line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", []), ("1", []), ("2", [0]), ("None", [0])]


def test_large_buckets_are_compared_whole(spark):
    """Copies near to one line, but not to each other, are one component, however many share a bucket."""
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=240))
    rows = []
    for d in range(150):
        ln = line
        for k in rng.sample(range(20, 220), 3) if d != 75 else ():
            ln = ln[:k] + "#" + ln[k + 1 :]
        rows.append((d, ln))
    rows += [(1000 + d, "".join(rng.choices("abcdefghij ", k=120))) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.summary(df).collect() if r["removed"]}
    assert got == brute(rows) and len(got) == 149


def test_small_edits_in_short_lines_link(spark):
    """One edited character in a line of 50 characters, two distant ones in a line of 100."""
    rng = random.Random(10)
    rows, want = [], {}
    for d in range(0, 60, 2):
        ln = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=50 if d % 4 else 100))
        new = ln
        for k in (25,) if d % 4 else (30, 70):
            new = new[:k] + "#" + new[k + 1 :]
        rows += [(d, ln), (d + 1, new)]
        want[d + 1] = [0]
    got = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["removed"] for r in got if r["removed"]} == want


def test_similar_against_sets():
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abé🙂 ", k=rng.randrange(1, 30)))
    x = [word() for _ in range(500)] + ["abcde", "abcdef", "aaaaaaaaa"]
    y = [t if rng.random() < 0.2 else t[: rng.randrange(len(t) + 1)] + word() if rng.random() < 0.7 else t + "a" for t in x[:500]] + ["abcde", "abcde", "aaaaa"]
    pairs = [(a, b) for a, b in zip(x, y) if len(a) >= 5 and len(b) >= 5]
    want = []
    for a, b in pairs:
        p, q = grams(a), grams(b)
        want.append(len(p & q) >= 0.75 * len(p | q))
    got = line_dedup.similar([a for a, _ in pairs], [b for _, b in pairs], 0.75)
    assert got.tolist() == want and 50 < sum(want) < len(want) - 50


def test_recall_in_large_families(spark):
    """Pairs at 0.75 to 0.85 inside families of thousands of lines that are less near: nine in ten at least are linked."""
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = "".join(rng.choices(letters, k=200))

    def changed(line, n):
        line = list(line)
        for k in rng.sample(range(3, len(line) - 3), n):
            line[k] = rng.choice("0123456789")
        return "".join(line)

    rows, want, near = [], 0, 0
    for d in range(0, 3000, 2):
        a = changed(base, 14)  # about 0.5 to any other one
        b = changed(a, rng.randrange(3, 6))
        p, q = grams(a), grams(b)
        j = len(p & q) / len(p | q)
        rows += [(d, a), (d + 1, b)]
        want += j >= 0.75
        near += 0.75 <= j <= 0.85
    out = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_removed > 0").count()
    assert near > 900 and 0.9 * want <= out <= want * 1.1, (near, want, out)


def test_signatures_by_pieces(monkeypatch):
    """Lines longer and shorter than a piece, and lines left out, have the smallest hashes of their own shingles."""
    rng = np.random.default_rng(8)
    lines = ["".join(rng.choice(list("abcdé "), int(n))) + "x" * 5 for n in rng.integers(0, 300, 60)] + ["y" * 3]
    data = "\n".join(lines).encode()
    x = line_dedup.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    chosen = np.flatnonzero(x.ends - x.starts >= line_dedup.GRAM)[::3]
    whole = x.signatures(chosen)
    monkeypatch.setattr(line_dedup, "PIECE", 100)
    assert (x.signatures(chosen) == whole).all()
    for row, i in zip(whole, chosen.tolist()):
        text = x.text(i).encode()
        alone = line_dedup.Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (alone.signatures(np.array([0])) == row).all()


def test_lines_of_many_shingles_are_hashed_once(monkeypatch):
    """Near copies around MANY shingles share a signature, also across that border; no long line is hashed once a row."""
    rng, rows, pairs = random.Random(12), [], 150
    for k in range(pairs):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(600, 1700) if k else 30_000))
        other = list(text)
        for at in rng.sample(range(len(text)), len(text) // 45):  # a similarity of about 0.8
            other[at] = "#"
        rows += [text, "".join(other)]
    data = "\n".join(rows).encode()
    x = line_dedup.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    sizes, by_row = np.array([len(line_dedup.gram_set(r)) for r in rows]), []
    signatures = line_dedup.Lines.signatures
    monkeypatch.setattr(line_dedup.Lines, "signatures", lambda self, chosen: by_row.extend(chosen.tolist()) or signatures(self, chosen))
    found: dict[int, set] = {i: set() for i in range(len(rows))}
    for own, sigs in x.signed(np.arange(len(rows)), 0.75):
        for i, s in zip(own.tolist(), sigs.tolist()):
            found[i] |= set(s)
    assert sizes[by_row].max() < 1.02 * line_dedup.MANY < sizes.max()
    near = [k for k in range(0, len(rows), 2) if (c := len(line_dedup.gram_set(rows[k]) & line_dedup.gram_set(rows[k + 1]))) >= 0.77 * (sizes[k] + sizes[k + 1] - c)]
    assert len(near) > pairs / 2 and sum(bool(found[k] & found[k + 1]) for k in near) >= 0.97 * len(near)
    assert not any(found[k] & found[k + 2] for k in range(0, len(rows) - 2, 2))


def test_two_rows_a_hash_and_only_long_lines_hashed_whole(monkeypatch):
    """Each hash function serves two rows, and bands are alike as often as the formula says; 64-bit hashes are made of long lines alone."""
    rng = random.Random(5)
    assert 2 * len(line_dedup._A) == line_dedup.BANDS * line_dedup.ROWS
    lines, want = [], []
    for _ in range(600):
        a = [rng.choice("abcdefgh") for _ in range(120)]
        b = [*a]
        for i in rng.sample(range(120), 3):
            b[i] = "z"
        x, y = (line_dedup.gram_set("".join(t)) for t in (a, b))
        want.append((len(x & y) / len(x | y)) ** line_dedup.ROWS)
        lines += ["".join(a), "".join(b)]
    long, hashed, grams = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000)), [], line_dedup.gram_hashes
    monkeypatch.setattr(line_dedup, "gram_hashes", lambda chars: hashed.append(len(chars)) or grams(chars))
    data = np.frombuffer("\n".join([*lines, long]).encode(), dtype=np.uint8)
    found = line_dedup.Lines(data, np.array([0, len(data)]))
    (few, signatures), (many, _) = found.signed(np.arange(len(found.keys)), 0.75)
    assert len(few) == len(lines) and many.tolist() == [len(lines)] and hashed == [3000]
    alike = (signatures[::2] == signatures[1::2]).mean()
    assert abs(alike - np.mean(want)) < 0.02


def test_java_signs_the_lines_that_numpy_finds(spark):
    """Java's lines have the keys of Lines, repeated ones once; bands of lines of any length are alike as often as the formula says."""
    rng = random.Random(16)
    call = jvm.functions(spark, line_dedup.SOURCES, SignLines="binary")["SignLines"]

    def signed(texts):
        rows = spark.createDataFrame([(i, bytearray(t.encode()) if t is not None else None) for i, t in enumerate(texts)], "i int, text binary").repartition(1)
        got = rows.sortWithinPartitions("i").select("i", F.call_udf(call, "text").alias("signed")).collect()
        return [r["signed"] if r["signed"] is None else np.frombuffer(r["signed"], "<u8").reshape(-1, 2 + line_dedup.BANDS) for r in sorted(got, key=lambda r: r["i"])]

    hostile = [None, "", "\n\n", "abcd\nabcde\n", " \t \x0b \n  \x1c   \nABCDÉ Z", "🙂🙂🙂🙂\n🙂🙂🙂🙂🙂\nabcdé z", "日本語の文字" * 50 + "\n\r\n" + "x" * 30_000, "ABCDE\nabcde"]
    got, met = signed(hostile), set()
    for text, rows in zip(hostile, got):
        assert (rows is None) == (text is None)
        data = np.frombuffer((text or "").encode(), np.uint8)
        lines = line_dedup.Lines(data, np.array([0, len(data)]))
        want = [k for k in dict.fromkeys(lines.keys[lines.ends - lines.starts >= line_dedup.GRAM].tolist()) if k not in met]
        met.update(want)
        assert (line_dedup.keys_of(rows[:, 0], rows[:, 1]).tolist() if text is not None else []) == want
    for n, edits in ((8, 1), (30, 1), (116, 3), (400, 9), (2000, 40)):
        texts, want = [], []
        for _ in range(300):
            a = [rng.choice("abcdefgh") for _ in range(n + 4)]
            b = [*a]
            for i in rng.sample(range(n + 4), edits):
                b[i] = "z"
            x, y = grams("".join(a)), grams("".join(b))
            want.append((len(x & y) / len(x | y)) ** line_dedup.ROWS)
            texts.append("".join(a) + "\n" + "".join(b))
        found = [r for r in signed(texts) if len(r) == 2]
        assert len(found) > 280 and abs(np.mean([(r[0, 2:] == r[1, 2:]).mean() for r in found]) - np.mean(want)) < 0.02
