"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import pick
from clusterloom.llm.hashing import _powers

U = np.uint64
#: Bytes of benchmark text whose index is broadcast at a time; larger benchmarks go in as many blocks as it takes.
BLOCK_BYTES = 4 << 20
_SPACES = np.array([32, 9, 10, 11, 12, 13], dtype=np.uint32)


def normalised(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(characters, places): A-Z in lower case, runs of ASCII white space as one space, none at the ends; places are
    the characters' indices in the text."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    kept = ~space
    kept[1:] |= ~space[:-1]
    at = np.flatnonzero(kept)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    if len(at) and space[at[0]]:
        at = at[1:]
    c = np.where(space, np.uint32(32), c)[at]
    return np.where((c >= 65) & (c <= 90), c + np.uint32(32), c), at


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) * U(0x9FB21C651E98DF25) ^ U(0x5851F42D4C957F2D)) * up[: len(c)], out=total[1:])
    h = (total[q:] - total[:-q]) * down[: len(c) - q + 1]
    h ^= h >> U(29)
    return h * U(0xBF58476D1CE4E5B9)


def edits_within(pattern: list, text: list, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end): the best alignment of the whole pattern with a stretch of text, if it takes at most
    ``budget`` edits. Only cells within the band of diagonals that such an alignment can use are filled."""
    m, n = len(pattern), len(text)
    far = budget + 1
    width = n - m + 2 * budget + 1  # diagonals -budget .. n - m + budget
    if width <= 0:
        return None
    # cell d of row i stands for text place j = i + d - budget
    cost = [0 if 0 <= d - budget <= n else far for d in range(width)]
    start = [max(0, d - budget) for d in range(width)]
    for i in range(1, m + 1):
        new, begun, ch = [far] * width, [0] * width, pattern[i - 1]
        for d in range(width):
            j = i + d - budget
            if j < 0 or j > n:
                continue
            best, at = far, 0
            if j > 0:
                best, at = cost[d] + (text[j - 1] != ch), start[d]
                if d > 0 and new[d - 1] + 1 < best:
                    best, at = new[d - 1] + 1, begun[d - 1]
            if d + 1 < width and cost[d + 1] + 1 < best:
                best, at = cost[d + 1] + 1, start[d + 1]
            if best < far:
                new[d], begun[d] = best, at
        cost, start = new, begun
    best = min(range(width), key=lambda d: (cost[d], d))
    return (cost[best], start[best], m + best - budget) if cost[best] <= budget else None


def edits_of_windows(item: np.ndarray, starts: np.ndarray, size: int, text: np.ndarray, low: np.ndarray, high: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """edits_within() for many windows of an item at once: (edits, start, end) of each; edits above the budget mean none.

    Window i has the ``size`` characters from starts[i] on, and its stretch lies in text[low[i] : high[i]]; start and
    end count from low[i]. Of stretches with equally few edits, the one that ends first counts.
    """
    n = high - low
    width = max(0, int(n.max()) - size + 2 * budget + 1)
    if not width:
        return np.full(len(starts), budget + 1), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    # Costs and starts in one number, so that the least cost comes with the least start; ahead of the cost of inserts.
    unit = np.int64(1) << 32
    far = (budget + 1) * unit
    d = np.arange(width)
    j = d - budget
    cell = np.where((j >= 0) & (j <= n[:, None]), np.maximum(j, 0), far)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i in range(1, size + 1):
        j = i + d - budget
        inside = (j >= 0) & (j <= n[:, None])
        at = np.minimum(low[:, None] + np.maximum(j - 1, 0), len(text))
        new = np.where(j > 0, cell + (padded[at] != item[starts + i - 1][:, None]) * unit, far)
        new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + unit)
        new = np.where(inside, new, far)
        new = np.minimum.accumulate(new - d * unit, axis=1) + d * unit
        cell = np.where(inside, np.minimum(new, far), far)
    cost = cell // unit
    best = cost.argmin(axis=1)
    rows = np.arange(len(starts))
    return cost[rows, best], cell[rows, best] % unit, size + best - budget


class Short:
    """Items too short for windows: they are found where they stand verbatim as whole words."""

    def __init__(self, items: list):
        self.items, lengths = items, np.array([len(c) for _, c in items])
        self.of = []  # (length, sorted hashes, item numbers)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            h = np.array([gram_hashes(items[k][1], n)[0] for k in own], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            self.of.append((n, h[order], own[order]))

    def search(self, c: np.ndarray, places: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        found: dict[int, tuple[int, int, int, int]] = {}
        for n, hashes, own in self.of:
            g = gram_hashes(c, n)
            left, right = np.searchsorted(hashes, g), np.searchsorted(hashes, g, "right")
            for at in np.flatnonzero(right > left).tolist():
                if at and _joined(c[at - 1], c[at]) or at + n < len(c) and _joined(c[at + n - 1], c[at + n]):
                    continue
                for k in own[left[at] : right[at]].tolist():
                    if (self.items[k][1] == c[at : at + n]).all():
                        count, first = (found[k][0], found[k][2]) if k in found else (0, int(places[at]))
                        found[k] = (count + 1, 0, first, int(places[at + n - 1]) + 1)
        return found


def _joined(a: int, b: int) -> bool:
    """Whether no word ends between these characters."""
    return chr(a).isalnum() and chr(b).isalnum()


@dataclass
class Index:
    """The windows of benchmark items and the places of the items' q-grams."""

    q: int
    window: int
    budget: int
    items: list = field(default_factory=list)  # (item id, characters)
    starts: list = field(default_factory=list)  # of each item, its windows' starts; all have the length of the first

    @classmethod
    def of(cls, rows: list[tuple], q: int, window: int, step: int, share: float) -> list[Index | Short]:
        """Indexes for all items that have a character: one for each length of q-gram that the lemma allows, and one for short items.

        A region with e edits keeps size - q + 1 - e * q q-grams of a window; that is one at least if q is at most size /
        (e + 1). So windows for which the given q is too long get a shorter one.
        """
        budget, short, out = int(window * share), [], {}
        for item_id, text in rows:
            c, _ = normalised((text or "").encode())
            if len(c) < q * 2:
                if len(c):
                    short.append((item_id, c))
                continue
            size = min(window, len(c))
            own = min(q, size // (min(budget, size * budget // window) + 1))
            index = out.setdefault(own, cls(own, window, budget))
            index.items.append((item_id, c))
            last = max(0, len(c) - window)
            index.starts.append(np.array(sorted({*range(0, last, step), last}), dtype=np.int64))
        return [x.ready() for x in out.values()] + ([Short(short)] if short else [])

    def ready(self) -> Index:
        grams = [gram_hashes(c, self.q) for _, c in self.items]
        self.hash = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        counts = [len(g) for g in grams]
        self.item = np.repeat(np.arange(len(grams)), counts)[order]
        self.place = (np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, np.int64))[order]
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[(self.hash >> U(42)).astype(np.int64)] = True
        self.sizes = np.minimum(self.window, np.array([len(c) for _, c in self.items], dtype=np.int64))
        self.budgets = np.minimum(self.budget, (self.sizes * self.budget) // self.window)
        # The lemma: a region within the budget keeps this many of the window's q-grams.
        self.least = self.sizes - self.q + 1 - self.budgets * self.q
        self.fewest = int(self.least.min()) if len(self.sizes) else 1
        self.longest = int(self.sizes.max()) + self.budget if len(self.sizes) else 0
        return self

    def search(self, c: np.ndarray, places: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """item number -> (windows found, fewest edits, start, end) with places in the text that c is normalised() from."""
        g = gram_hashes(c, self.q)
        if not len(g):
            return {}
        maybe = np.flatnonzero(self.table[(g >> U(42)).astype(np.int64)])
        if len(maybe) < self.fewest:
            return {}
        left = np.searchsorted(self.hash, g[maybe])
        real = self.hash[np.minimum(left, len(self.hash) - 1)] == g[maybe]
        maybe, left = maybe[real], left[real]
        # Regions with too few q-grams of any item at all can't pass for one of them.
        if len(maybe) < self.fewest:
            return {}
        ahead = np.searchsorted(maybe, maybe + self.longest) - np.arange(len(maybe)) >= self.fewest
        runs = np.flatnonzero(ahead)
        if not len(runs):
            return {}
        mark = np.zeros(len(maybe) + 1, dtype=np.int64)
        np.add.at(mark, runs, 1)
        np.add.at(mark, np.searchsorted(maybe, maybe[runs] + self.longest), -1)
        near = np.cumsum(mark[:-1]) > 0
        maybe, left = maybe[near], left[near]
        right = np.searchsorted(self.hash, g[maybe], "right")
        n = right - left
        hit = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, item, place = np.repeat(maybe, n), self.item[hit], self.place[hit]
        # Overlapping bands, budget + 1 apart and twice as wide: every alignment lies in one of them whole.
        step = self.budget + 1
        band = (at - place) // step
        k2, b2 = np.concatenate([item, item]), np.concatenate([band, band - 1])
        gram = np.concatenate([place, place])
        order = np.lexsort((gram, b2, k2))
        k2, b2, gram = k2[order], b2[order], gram[order]
        fresh = np.concatenate([[True], (k2[1:] != k2[:-1]) | (b2[1:] != b2[:-1]) | (gram[1:] != gram[:-1])])
        k2, b2, gram = k2[fresh], b2[fresh], gram[fresh]  # a q-gram of the item counts once in a band
        begin = np.flatnonzero(np.concatenate([[True], (k2[1:] != k2[:-1]) | (b2[1:] != b2[:-1])]))
        end = np.concatenate([begin[1:], [len(k2)]])
        enough = np.flatnonzero(end - begin >= self.least[k2[begin]])
        found: dict[int, tuple[int, int, int, int]] = {}
        done: dict[int, np.ndarray] = {}
        for x, y in zip(begin[enough].tolist(), end[enough].tolist()):
            k, b, own = int(k2[x]), int(b2[x]), gram[x:y]
            starts, size, budget = self.starts[k], int(self.sizes[k]), int(self.budgets[k])
            left_out = done.setdefault(k, np.zeros(len(starts), dtype=bool))
            kept = np.searchsorted(own, starts + size - self.q, "right") - np.searchsorted(own, starts)
            todo = np.flatnonzero((kept >= self.least[k]) & ~left_out)
            for part in np.split(todo, range(1024, len(todo), 1024)):
                s = starts[part]
                low = np.maximum(0, b * step + s - budget)
                high = np.minimum(len(c), (b + 2) * step + s + size + budget)
                if not len(s):
                    continue
                e, first, last = edits_of_windows(self.items[k][1], s, size, c, low, high, budget)
                hits = np.flatnonzero(e <= budget)
                if not len(hits):
                    continue
                left_out[part[hits]] = True
                first, last = int(places[(low + first)[hits].min()]), int(places[(low + last)[hits].max() - 1]) + 1
                new = (len(hits), int(e[hits].min()), first, last)
                o = found.get(k)
                found[k] = new if o is None else (o[0] + new[0], min(o[1], new[1]), min(o[2], new[2]), max(o[3], new[3]))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, q: int = 10, window: int = 80, step: int = 1, share: float = 0.075) -> DataFrame:
    """(doc_id, version, item_id, n_windows, edits, start, end): a row for each document and item with a passage in common.

    Texts are compared with A-Z in lower case and white space runs as one space. Items are cut into windows of
    ``window`` characters every ``step`` (one, if shorter): with a step of 1, each stretch of that length is a window,
    wherever an excerpt starts. A document is contaminated if some stretch of it is within share * window edits of a
    window (fewer in proportion, if the window is shorter): by the q-gram lemma, such a stretch shares a certain number of
    q-grams with the window inside a band of diagonals; bands with as many are aligned. Where q-grams are too long for
    the lemma, shorter ones are taken. Items below 2 q characters are found where they stand verbatim as whole words.
    n_windows counts the windows found, edits is the least of them, start and end are the characters of the text from
    the first stretch to the last. version tells rows with equal ids and other texts apart; repeated rows give
    repeated results. Texts of any length are searched whole; one text has to fit a worker. Null texts have none, and
    null, empty or blank items are in no text; a null id stays; empty tables give no rows; other columns aren't read.
    The benchmark's index is broadcast in blocks of BLOCK_BYTES of text; each block is a pass over docs. The benchmark
    is read when this is called.
    """
    own = pick(docs, doc_id=doc_id, text=text)
    own = own.select("doc_id", own["text"].cast("binary").alias("text"), F.xxhash64("text").alias("version"))
    items = pick(benchmark, item_id=item_id, text=item_text)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    kinds = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, version long, item_id {items.schema['item_id'].dataType.simpleString()}, n_windows long, edits int, start long, end long"
    arrow_id = items.limit(0).toArrow().schema.field("item_id").type
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).dropDuplicates().orderBy("item_id", "text")
        rows = [tuple(r) for r in block.collect()]  # about BLOCK_BYTES
        part = own.mapInArrow(_searcher(rows, q, window, step, share, arrow_id), kinds)
        found = part if found is None else found.union(part)
    return found


def _searcher(rows, q, window, step, share, arrow_id):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = Index.of(rows, q, window, step, share)
        for batch in batches:
            texts, out = batch.column(1), []
            for i in range(len(batch)):
                t = texts[i].as_buffer()
                if t is not None and indexes:
                    c, places = normalised(t.to_pybytes())
                    for index in indexes:
                        out.extend((i, index.items[k][0], *hit) for k, hit in index.search(c, places).items())
            if out:
                at, item, n, e, x, y = zip(*out)
                rows_at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows_at), batch.column(2).take(rows_at), pa.array(item, arrow_id), pa.array(n, pa.int64()), pa.array(e, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                    names=["doc_id", "version", "item_id", "n_windows", "edits", "start", "end"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that share no passage with the benchmark, with docs' own columns; all rows of an id and text stay or
    go together."""
    names = ["_hit_id", "_hit_version"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    hits = contaminated(docs, benchmark, doc_id, text, **how).select("doc_id", "version").distinct().toDF(*names)
    return docs.join(hits, docs[f"`{doc_id}`"].eqNullSafe(hits[names[0]]) & (F.xxhash64(docs[f"`{text}`"]) == hits[names[1]]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).drop("version")
