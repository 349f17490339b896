"""Fuzzy line deduplication: MinHash over character shingles (SignLines.java), banding, exact checks, union-find over lines.

Each band's bucket first pairs its lines with one or two of them; checked links give first components, which are nearly
all. Then lines of different components that share a bucket are compared: pair by pair in small buckets, in blocks in
large ones. So no bucket is cut short, and candidates grow with the lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.buckets import LARGE, PACKED, Bloom, Packer, across, parts_for, stars
from clusterloom.llm.common import drop_stored, let, pick, stored
from clusterloom.llm.components import components
from clusterloom.llm.hashing import _PLACES, _powers, mix, slices
from clusterloom.llm.jvm import functions

U = np.uint64
#: Characters of a shingle. Shorter lines are duplicates only of equal ones.
GRAM = 5
#: Bands and their rows. At a similarity of 0.8, 9997 of 10,000 pairs share a band; at 0.75, 9923. Lines of one language have
#: similarities of some hundredths, up to 0.2; with seven rows few such pairs are candidates, however many lines there are.
BANDS, ROWS = 34, 7
#: Parts of the signatures at least: nearly each of a line's is in a part of its own, as with any larger number. So a line takes
#: as many bytes of shuffle in a small table as in a large one.
PARTS = 4 * BANDS
#: Characters that are checked at a time, and shingles that are hashed at a time.
CHECKED, PIECE = 300_000, 1 << 16
#: Hash functions: the least and the largest hash of each are a row (min-max hash, of no more variance than a function for each row).
HASHES = BANDS * ROWS // 2
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 1 << 15, HASHES, dtype=np.uint16) * np.uint16(2) + np.uint16(1)
_X = _rng.integers(0, 1 << 16, HASHES, dtype=np.uint16)
_SHORT_PLACES = _rng.integers(1, 1 << 31, GRAM, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Lines of so many distinct shingles (by 16-bit hashes) are hashed once, not once a row. Those of fewer have 16-bit hashes, which add n / 131,072
#: to the similarity of two lines of n shingles: less than 0.008.
MANY = 1024
_NONE = U(1 << 32)
SOURCES = ("SignLines",)


def _banded(least: np.ndarray, seed: int) -> np.ndarray:
    """(lines, BANDS): a hash of the rows of each band; least: (rows, lines)."""
    out = np.empty((least.shape[1], BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(out), seed + b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * _PLACES[r] + least[b * ROWS + r])
        out[:, b] = h
    return out


def _banded_short(rows: np.ndarray) -> np.ndarray:
    """(lines, BANDS): a hash of the rows of each band; rows: (rows, lines) of 16 bits, four to a number."""
    out = np.empty((rows.shape[1], BANDS), dtype=np.uint64)
    for b in range(BANDS):
        own, h = rows[b * ROWS : (b + 1) * ROWS], np.full(len(out), b + 1, dtype=np.uint64)
        for at in range(0, ROWS, 4):
            packed = own[at].astype(np.uint64)
            for r in own[at + 1 : at + 4]:
                packed <<= U(16)
                packed |= r
            h = mix(h * _PLACES[at] + packed)
        out[:, b] = h
    return out


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM characters from each place on."""
    n = max(0, len(chars) - GRAM + 1)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, PIECE):  # what a processor's cache holds
        c = chars[at : at + PIECE + GRAM - 1].astype(np.uint64)
        h = out[at : at + PIECE]
        np.multiply(c[: len(h)], _PLACES[0], out=h)
        for k in range(1, GRAM):
            h += c[k : k + len(h)] * _PLACES[k]
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
    return out


def _row_grams(texts: list[str]) -> np.ndarray:
    """Sorted distinct (row, shingle) of lines, as row << 44 and 44 bits of the shingle's hash."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(chars == 10)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.concatenate([[-1], ends])))
    h = gram_hashes(chars)
    inside = np.ones(len(h), dtype=bool)
    for k in range(GRAM):  # no shingle holds a line's end
        at = ends - k
        inside[at[(at >= 0) & (at < len(h))]] = False
    keys = (row[: len(h)] << U(44) | h >> U(20))[inside]
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def similar(x: list[str], y: list[str], similarity: float) -> np.ndarray:
    """Whether the lines of each row have shingles of that Jaccard similarity. Shingles of a row are compared by 44-bit hashes."""
    a, b = _row_grams(x), _row_grams(y)
    both = np.concatenate([a, b])
    both.sort()
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> U(44)).astype(np.int64), minlength=len(x))
    total = np.bincount((both >> U(44)).astype(np.int64), minlength=len(x))
    return common >= similarity * (total - common)


def keys_of(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys of lines, from the sums of their characters' hashes and their numbers of characters."""
    return mix(sums + lengths * _PLACES[1])


class Lines:
    """The lines of a run of texts: their keys (hashes of the whole line, A-Z in lower case), texts and numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        chars = np.frombuffer(data.tobytes().lower().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)  # A-Z alone are lowered
        inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that don't begin a character
        at = offsets - np.searchsorted(inner, offsets)
        if at[-1] != len(chars):
            raise ValueError("a text is not UTF-8")
        self.chars = chars
        newline = np.flatnonzero(chars == 10)
        # A line starts with each text and behind each newline.
        starts = np.concatenate([at[:-1], newline + 1])
        ends = np.concatenate([at[1:], newline])
        starts.sort()
        ends.sort()
        values = np.empty(len(chars) + 1, dtype=np.uint64)
        values[-1] = 0
        own = values[:-1]
        np.multiply(self.chars, U(0x9FB21C651E98DF25), out=own)
        own ^= U(0x5851F42D4C957F2D)
        up, down = _powers(len(chars) + 1)
        own *= up[: len(chars)]
        own[newline] = 0
        total = np.add.reduceat(values, starts) if len(starts) else values[:0]
        shown = ends > starts
        for i in np.flatnonzero(shown & self._blank(chars[np.minimum(starts, len(chars) - 1)])).tolist() if len(chars) else ():
            shown[i] = not self._blank(chars[starts[i] : ends[i]]).all()
        self.starts, self.ends = starts[shown], ends[shown]
        self.of = np.searchsorted(at[1:], self.starts, "right")
        self.number = np.searchsorted(newline, self.starts) - np.searchsorted(newline, at[:-1])[self.of]
        self.keys = keys_of(total[shown] * down[self.starts], (self.ends - self.starts).astype(np.uint64))

    @staticmethod
    def _blank(chars: np.ndarray) -> np.ndarray:
        return (chars == 32) | (chars - np.uint32(9) < 5)

    @cached_property
    def short(self) -> np.ndarray:
        """16-bit hashes of the GRAM characters from each place on."""
        n = max(0, len(self.chars) - GRAM + 1)
        out = np.empty(n, dtype=np.uint16)
        for at in range(0, n, PIECE):
            c = self.chars[at : at + PIECE + GRAM - 1]
            m = min(PIECE, n - at)
            h = c[:m] * _SHORT_PLACES[0]
            for k in range(1, GRAM):
                h += c[k : k + m] * _SHORT_PLACES[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[at : at + m] = h >> np.uint32(16)
        return out

    def signatures(self, chosen: np.ndarray) -> np.ndarray:
        """(lines, BANDS) signatures of the chosen lines, of GRAM characters or more: a hash function for each two rows, which are in
        different bands."""
        first = self.starts[chosen]
        sizes = self.ends[chosen] - GRAM + 1 - first
        ends = np.cumsum(sizes)
        g, begins, last = self.short, ends - sizes, first + sizes
        rows = np.empty((2 * HASHES, len(chosen)), dtype=np.uint16)
        held = np.empty(max(PIECE, int(sizes.max())), dtype=np.uint16)
        a = 0
        while a < len(chosen):  # whole lines, so many that a processor's cache holds their hashes
            b = max(a + 1, int(np.searchsorted(ends, begins[a] + PIECE, "right")))
            at = begins[a:b] - begins[a]
            own = np.concatenate([g[i:j] for i, j in zip(first[a:b].tolist(), last[a:b].tolist())])
            hashes = held[: len(own)]
            for k in range(HASHES):
                np.bitwise_xor(own, _X[k], out=hashes)
                np.multiply(hashes, _A[k], out=hashes)
                np.minimum.reduceat(hashes, at, out=rows[k, a:b])
                np.maximum.reduceat(hashes, at, out=rows[HASHES + k, a:b])
            a = b
        return _banded_short(rows)

    def signatures_at_once(self, chosen: np.ndarray) -> np.ndarray:
        """(lines, BANDS) signatures of lines of many shingles: one hash function deals a line's shingles over all rows, and
        each keeps its least. A row that gets none takes that of another one, which its number chooses (one-permutation MinHash
        with optimal densification): two rows agree as often as those of a function each."""
        rows = BANDS * ROWS
        least = np.full((len(chosen), rows), _NONE, dtype=np.uint64)
        for own, i in zip(least, chosen.tolist()):
            h = mix(gram_hashes(self.chars[self.starts[i] : self.ends[i]]))
            np.minimum.at(own, ((h >> U(32)) * U(rows) >> U(32)).astype(np.int64), h & U(0xFFFFFFFF))
        out, (line, row) = least.copy(), np.nonzero(least == _NONE)
        step = U(0)
        while len(line):
            step += U(1)
            taken = least[line, (mix(row.astype(np.uint64) * _PLACES[0] + step) % U(rows)).astype(np.int64)]
            out[line, row] = taken
            line, row = line[taken == _NONE], row[taken == _NONE]
        return _banded(out.T, BANDS)

    def signed(self, chosen: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lines, their signatures), as duplicate_lines() had them before SignLines.java: lines of MANY distinct 16-bit hashes or more at once, others row by row, and those that may
        have partners of both kinds both ways."""
        long = chosen[self.ends[chosen] - self.starts[chosen] - GRAM + 1 >= similarity * MANY]
        distinct, met = np.zeros(len(long), np.int64), np.zeros(1 << 16, bool)
        for k, i in enumerate(long.tolist()):
            own = self.short[self.starts[i] : self.ends[i] - GRAM + 1]
            met[own] = True
            distinct[k] = np.count_nonzero(met)
            met[own] = False
        few = np.setdiff1d(chosen, long[distinct >= MANY], assume_unique=True)
        if len(few):
            yield few, self.signatures(few)
        if (distinct >= similarity * MANY).any():
            yield (many := long[distinct >= similarity * MANY]), self.signatures_at_once(many)

    def text(self, i: int) -> str:
        return self.chars[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le")


def gram_set(text: str) -> set:
    """The distinct shingles of a line."""
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _hashed(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line, as 64-bit hashes."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    h, ends = gram_hashes(chars), np.flatnonzero(chars == 10).tolist()
    return [np.unique(h[a + 1 : b - GRAM + 1]) for a, b in zip([-1, *ends], ends)]


def _fresh(keys: np.ndarray, seen: set) -> np.ndarray:
    """Places of the keys that the task has not met lately, each once."""
    if len(seen) > 300_000:
        seen.clear()
    _, at = np.unique(keys, return_index=True)
    out = [i for i in at.tolist() if int(keys[i]) not in seen]
    seen.update(keys[out].tolist())
    return np.array(sorted(out), dtype=np.int64)


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similarity: float = 0.75) -> DataFrame:
    """(doc_id, version, lines): for each document that loses lines, their numbers from 0, ascending.

    Lines are what stands between newlines; blank ones (ASCII white space only) take no part. Two lines link when they are
    equal, A-Z in lower case, or when the Jaccard similarity of their sets of GRAM-character shingles is ``similarity`` or
    more (candidates by MinHash bands, each checked exactly); lines of fewer characters link when they are equal. Of each
    connected component the line of the smallest (doc_id, number) stays; null ids come last. version is a hash of the
    text: rows with equal id and text are one document, all of whose copies lose the same lines; rows with an equal id and
    other texts are told apart by it. Texts of any length are read whole; one text has to fit a worker. Null texts have no
    lines; other columns aren't read; an empty table gives no rows. Stages run, and store what they find in the shared
    folder, when this is called.
    """
    own = pick(docs, doc_id=doc_id, text=text)
    own = own.select("doc_id", own["text"].cast("binary").alias("text"), F.xxhash64("text").alias("version"))
    kind = own.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                x = Lines(data, offsets)
                rows = pa.array(x.of + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.keys.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(x.number.astype(np.int32))], names=["key", "doc_id", "version", "line"]
                )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for signed in batch.column(0).drop_null().to_pylist():
                rows = np.frombuffer(signed, dtype="<u8").reshape(-1, 2 + BANDS)
                for key, sigs in zip(keys_of(rows[:, 0], rows[:, 1]).view(np.int64).tolist(), rows[:, 2:]):
                    if out := packer.add(sigs, key):
                        yield out
        if out := packer.flush():
            yield out

    lines = stored(own.mapInArrow(occurrences, f"key long, doc_id {kind}, version long, line int"), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "line")
    firsts = stored(lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines")
    parts = max(PARTS, parts_for(spark, firsts.count() * BANDS))
    found = stored(stars(own.select(F.call_udf(functions(spark, SOURCES, SignLines="binary")["SignLines"], "text").alias("signed")).mapInArrow(sign, PACKED), members=True), "pairs")
    pairs = stored(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    bloom = Bloom.of(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                x = Lines(data, offsets)
                at = np.flatnonzero(bloom.has(x.keys))
                chosen = at[_fresh(x.keys[at], seen)] if len(at) else at
                if len(chosen):
                    yield pa.RecordBatch.from_arrays([pa.array(x.keys[chosen].view(np.int64)), pa.array([x.text(i) for i in chosen.tolist()], pa.string())], names=["key", "chars"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(sum(pc.utf8_length(batch.column(k)).to_numpy().astype(np.int64) for k in (2, 3)))
            at = 0
            while at < len(batch):  # some rows at a time, by their characters
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHECKED, "right")))
                part = batch.slice(at, to - at)
                yield part.select(["a", "b"]).filter(pa.array(similar(part.column(2).to_pylist(), part.column(3).to_pylist(), similarity)))
                at = to

    chars = stored(own.select("text").mapInArrow(texts, "key long, chars string").groupBy("key").agg(F.first("chars").alias("chars")), "texts")

    def linked(pairs: DataFrame, chars: DataFrame) -> DataFrame:
        # Merged, not broadcast, however small: the plan is the same at every size.
        chars = chars.hint("merge")
        left, right = chars.select(F.col("key").alias("a"), F.col("chars").alias("ca")), chars.select(F.col("key").alias("b"), F.col("chars").alias("cb"))
        # Stored, so that no task needs the workers of two steps at once.
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(check, "a long, b long"), "links")

    links = linked(pairs, chars)
    known = components(links)
    rest = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("id"))
    rest = rest.join(known.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high").select("bucket", "m")
    rest = stored(rest.join(mixed, "bucket"), "large")
    small = rest.where(F.col("m") <= LARGE)
    left, right = small.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ga")), small.select("bucket", F.col("id").alias("b"), F.col("comp").alias("gb"))
    more = left.join(right, "bucket").where("a < b and ga <> gb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = stored(more, "pairs")
    few = Bloom.of(more.select(F.explode(F.array("a", "b")).alias("key")), "key")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(few.has(batch.column(0).to_numpy())))

    apart, more = more, linked(more, chars.mapInArrow(needed, chars.schema))
    sets = chars.select(F.col("key").alias("id"), F.col("chars").alias("s"), F.length("chars").alias("size"))
    whole = stored(across(rest.where(F.col("m") > LARGE).select("bucket", "id", "comp"), sets, _hashed, lambda common, both: common >= similarity * (both - common)), "links")
    before = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    known = stored(components(before.union(more).union(whole)), "components")
    drop_stored(found, pairs, apart, chars, links, rest, more, whole)
    # The line that stays in each component; a line that is near no other one matters if it occurs again.
    known = known.withColumnRenamed("node", "key")
    near = firsts.join(known, "key")
    kept = near.groupBy("component").agg(F.min("first").alias("stays"))
    again = firsts.where("n > 1").join(known, "key", "left_anti")
    stays = stored(near.join(kept, "component").select("key", "stays").unionByName(again.select("key", F.col("first").alias("stays"))), "stays")
    concerned = Bloom.of(stays, "key")

    def matter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(concerned.has(batch.column(0).to_numpy())))

    # Most lines are near no other one: they stay where they are.
    gone = lines.mapInArrow(matter, lines.schema).join(stays, "key").where(place != F.col("stays"))
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): a row for each row of docs; removed has the numbers of its lines that go."""
    own = pick(docs, doc_id=doc_id, text=text)
    gone = duplicate_lines(docs, doc_id, text, **how).withColumnRenamed("doc_id", "gone_id")
    counted = own.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = counted.join(gone, (counted["doc_id"].eqNullSafe(gone["gone_id"])) & (counted["version"] == gone["version"]), "left")
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select("doc_id", F.when(counted["n_lines"] > 0, counted["n_lines"]).otherwise(0).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, with its own columns, without the lines that go; documents of which no word is left go, too."""
    gone = duplicate_lines(docs, doc_id, text, **how)
    names = ["_gone_id", "_version", "_lines"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    gone = gone.toDF(*names)
    both = docs.join(gone, docs[f"`{doc_id}`"].eqNullSafe(gone[names[0]]) & (F.xxhash64(docs[f"`{text}`"]) == gone[names[1]]), "left")
    left = let(F.split(docs[f"`{text}`"], "\n"), lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(names[2])), lambda i: F.get(own, i)), "\n"))
    new = F.when(F.col(names[2]).isNull(), docs[f"`{text}`"]).otherwise(left)
    out = both.select(*[new.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])
    return out.where(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))


def query(spark, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
