"""Rows that share a signature: packed shuffles of signatures, stars and pairs of buckets, comparison of large ones in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import stored

U = np.uint64
#: Buckets of more ids than this are large: their members aren't paired one by one.
LARGE = 8
#: Signatures that a task holds before it deals them out; about as many make a part.
HELD, A_PART = 1_000_000, 3_000_000
#: Bits of a signature that are kept beside its part.
BITS = 40
#: Members, and features on average, of a block of a large bucket.
BLOCK, BLOCK_FEATURES = 512, 400_000
_PAIR = np.dtype([("a", np.int64), ("b", np.int64)])


class Packer:
    """Deals (signature, id) over parts as packed rows (part, sigs, ids, comps, counts): 5 bytes a signature, 8 an id, 8 a
    component where it is not the id, and 4 a count. The top bits of a signature choose the part, 40 others are kept; a
    part has about A_PART signatures, so false partners are a handful a part, and callers verify pairs. With most, of a
    signature with more than most + 1 ids in one task only so many go out, with the smallest and the largest component
    among them: enough to see that it is large, and whether its members are of one component."""

    def __init__(self, parts: int, most: int | None = None):
        self.parts, self.most, self.sigs, self.ids, self.n = parts, most, [], [], 0

    def add(self, sigs: np.ndarray, id_: int, comp: int | None = None) -> pa.RecordBatch | None:
        self.sigs.append(sigs)
        self.ids.append((id_, id_ if comp is None else comp, len(sigs)))
        self.n += len(sigs)
        return self.flush() if self.n >= HELD else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        sig = np.concatenate(self.sigs)
        ids, comps, lengths = (np.array(c, dtype=np.int64) for c in zip(*self.ids))
        of = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        self.sigs, self.ids, self.n = [], [], 0
        if self.most is not None:
            order = np.lexsort((comps[of], sig))
            run = sig[order]
            begin = np.concatenate([[True], run[1:] != run[:-1]])
            place = np.arange(len(run)) - np.maximum.accumulate(np.where(begin, np.arange(len(run)), 0))
            kept = order[(place <= self.most) | np.append(begin[1:], True)]
            kept.sort()
            sig, of = sig[kept], of[kept]
        part = part_of(sig, self.parts)
        order = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")  # inside a part, by id as before
        sig, of, part = sig[order], of[order], part[order]
        cut = np.searchsorted(part, np.arange(self.parts + 1))
        rows = []
        low = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
        for p in range(self.parts):
            a, b = int(cut[p]), int(cut[p + 1])
            if a < b:
                own, counts = _runs(of[a:b])
                alone = (ids[own] == comps[own]).all()
                rows.append((p, low[a:b].tobytes(), ids[own].tobytes(), b"" if alone else comps[own].tobytes(), counts.astype("<u4").tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "sigs", "ids", "comps", "counts"])


PACKED = "part int, sigs binary, ids binary, comps binary, counts binary"


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[at], np.diff(np.concatenate([at, [len(sorted_values)]]))


def part_of(sig: np.ndarray, parts: int) -> np.ndarray:
    return (((sig >> U(32)) * U(parts)) >> U(32)).astype(np.int32)


def low_bits(sig: np.ndarray) -> np.ndarray:
    return sig & U((1 << BITS) - 1)


def parts_for(spark, signatures: int) -> int:
    """So many parts that each has A_PART signatures or fewer on average."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), signatures // A_PART))


def _in_order(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values of BITS bits, where each was): values with their places in one number sort faster than places by values."""
    bits = len(sig).bit_length()
    if BITS + bits > 64:
        order = np.argsort(sig)
        return sig[order], order
    both = sig << U(bits) | np.arange(len(sig), dtype=np.uint64)
    both.sort()
    return both >> U(bits), (both & U((1 << bits) - 1)).view(np.int64)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, id, component) of a part in order of signature, each id once a bucket and lone ones left out; then
    where buckets begin and their sizes."""
    width, sigs, ids, comps = BITS // 8, [], [], []
    any_comps = any(table.column("comps").to_pylist())
    for s, i, g, c in zip(*(table.column(k).to_pylist() for k in ("sigs", "ids", "comps", "counts"))):
        low = np.zeros((len(s) // width, 8), dtype=np.uint8)
        low[:, :width] = np.frombuffer(s, dtype=np.uint8).reshape(-1, width)
        sigs.append(low.reshape(-1).view(np.uint64))
        counts = np.frombuffer(c, dtype="<u4")
        ids.append(np.repeat(np.frombuffer(i, dtype=np.int64), counts))
        if any_comps:
            comps.append(np.repeat(np.frombuffer(g or i, dtype=np.int64), counts))
    sig, own = np.concatenate(sigs), np.concatenate(ids)
    del sigs, ids
    comp = np.concatenate(comps) if any_comps else own
    del comps
    sig, order = _in_order(sig)
    same = np.concatenate([[False], sig[1:] == sig[:-1]])
    shared = same | np.append(same[1:], False)
    order = order[shared]
    sig, comp = sig[shared], comp[order] if any_comps else None
    own = own[order]
    order = np.lexsort((own, sig))
    sig, own, comp = sig[order], own[order], comp[order] if any_comps else None
    if len(sig):
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
        sig, own, comp = sig[fresh], own[fresh], comp[fresh] if any_comps else None
    comp = comp if any_comps else own
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return sig, own, comp, at, np.diff(np.append(at, len(sig)))


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    both = np.ascontiguousarray(np.concatenate([np.zeros((0, 2), np.int64), *pairs]))
    return np.unique(both.view(_PAIR)).view(np.int64).reshape(-1, 2)


def _rows(found: np.ndarray, named: np.ndarray) -> pa.Table:
    kind = np.concatenate([np.zeros(len(found), np.int32), np.ones(len(named), np.int32)])
    return pa.table({"a": np.concatenate([found[:, 0], named[:, 0]]), "b": np.concatenate([found[:, 1], named[:, 1]]), "kind": kind})


def stars(packed: DataFrame, members: bool = False) -> DataFrame:
    """(a, b, kind): kind 0: a < b, where each bucket's smallest id is paired with all others; in large buckets also one
    that the signature chooses. So pairs grow with the buckets, not with their squares. With members, rows of kind 1
    name the buckets of three ids or more: a is the bucket, b an id. A pair comes once from each part at most."""

    def reduce(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sig, own, _, at, size = _unpacked(table)
        centre = np.repeat(own[at], size)
        pairs = [np.stack([centre, own], axis=1)]
        chosen = np.repeat(own[at + (sig[at] % np.maximum(size, 1).astype(np.uint64)).astype(np.int64)], size)
        large = np.repeat(size, size) > LARGE
        pairs.append(np.stack([np.minimum(chosen, own), np.maximum(chosen, own)], axis=1)[large])
        found = _distinct(pairs)
        found = found[found[:, 0] != found[:, 1]]
        named = np.zeros((0, 2), np.int64)
        if members:
            more = np.repeat(size, size) > 2
            named = np.stack([(sig | U(part) << U(BITS)).view(np.int64), own], axis=1)[more]
        return _rows(found, named)

    return packed.groupBy("part").applyInArrow(reduce, "a long, b long, kind int")


def cross_pairs(packed: DataFrame) -> DataFrame:
    """(a, b, kind): of buckets whose ids are of several components: kind 0: a < b are ids of different components that
    share a bucket of at most LARGE; kind 1: a is the part and b the low bits of the signature of a larger one."""

    def reduce(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sig, own, comp, at, size = _unpacked(table)
        mixed = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at) if len(at) else np.zeros(0, bool)
        pairs = []
        for n in range(2, LARGE + 1):
            if len(begin := at[mixed & (size == n)]):
                i, j = np.triu_indices(n, 1)
                p, q = (begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()
                apart = comp[p] != comp[q]
                pairs.append(np.stack([own[p[apart]], own[q[apart]]], axis=1))
        large = sig[at[mixed & (size > LARGE)]].view(np.int64)
        return _rows(_distinct(pairs), np.stack([np.full(len(large), part, dtype=np.int64), large], axis=1))

    return packed.groupBy("part").applyInArrow(reduce, "a long, b long, kind int")


def across(rest: DataFrame, sets: DataFrame, features: Callable[[list], list[np.ndarray]], linked: Callable[[np.ndarray, np.ndarray], np.ndarray], *, spanning: bool = True) -> DataFrame:
    """(a, b): links, checked exactly, between ids of different components that share a bucket. rest: bucket, id, comp;
    sets: id, s, size (its features). features() turns values of s into arrays of whole numbers; linked(common, sum of
    both sizes) says which pairs link.

    A bucket belongs to the component of its first id, and all buckets of a component are compared as one: ids of other
    components with every id. Both sides have blocks, and a task holds one of each, however large a bucket is. With
    spanning, of the links of two blocks those go out that join components not joined by another one, so their number
    grows with the ids; else all do.
    """
    main = rest.groupBy("bucket").agg(F.min_by("comp", "id").alias("main"))
    both = rest.join(main, "bucket").select("main", "id", "comp").distinct().join(sets, "id")
    both = stored(both.withColumn("left", F.col("comp") != F.col("main")), "large")

    def blocks(which: Column) -> Column:
        return F.ceil(F.greatest(F.count(F.when(which, 1)) / BLOCK, F.sum(F.when(which, F.col("size"))) / BLOCK_FEATURES)).cast("int")

    sizes = both.groupBy("main").agg(blocks(F.col("left")).alias("nx"), blocks(F.lit(True)).alias("ny")).where("nx > 0")
    both = both.join(sizes, "main")
    own = ["main", "id", "comp", "s"]
    left = both.where("left").select(*own, F.lit(True).alias("left"), F.pmod(F.xxhash64("id"), "nx").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    right = both.select(*own, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), F.pmod(F.xxhash64("id"), "ny").cast("int").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        is_left = np.array(table.column("left").to_pylist())
        mine, theirs = np.flatnonzero(is_left).tolist(), np.flatnonzero(~is_left)
        if not mine or not len(theirs):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, comps = table.column("id").to_pylist(), table.column("comp").to_pylist()
        values = features(table.column("s").to_pylist())
        names, flat = np.unique(np.concatenate(values), return_inverse=True)
        ends = np.cumsum([len(v) for v in values])
        values = [flat[e - len(v) : e] for e, v in zip(ends.tolist(), values)]
        size = np.array([len(values[i]) for i in theirs])
        right_flat, begin = np.concatenate([values[i] for i in theirs]), np.cumsum(size) - size
        has, root, a, b = np.zeros(len(names), dtype=np.int32), {c: c for c in comps}, [], []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for k in mine:
            has[values[k]] = 1
            common = np.add.reduceat(has[right_flat], begin)
            has[values[k]] = 0
            for i in theirs[linked(common, len(values[k]) + size)].tolist():
                x, y = find(comps[k]), find(comps[i])
                if spanning and x != y:
                    root[max(x, y)] = min(x, y)
                if (x != y) if spanning else (ids[i] != ids[k]):
                    a.append(min(ids[k], ids[i]))
                    b.append(max(ids[k], ids[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).groupBy("main", "x", "y").applyInArrow(run, "a long, b long")


class Bloom:
    """A set of well-mixed 64-bit values in a bit field of 8 to 16 bits a value, of MOST words (32 MB) at most: false
    positives, no false negatives. Beyond that size more values pass, which costs rows to check, not results. Spark adds
    a column up as (word, bits) rows, so what the driver gets is bounded."""

    MOST, SHIFTS = 1 << 22, (0, 24)

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, values: DataFrame, column: str) -> Bloom:
        n = values.count()
        size = 1 << 8
        while size * 64 < 8 * n and size < cls.MOST:
            size *= 2
        places = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(size * 64 - 1).cast("long")) for s in cls.SHIFTS])
        rows = (
            values.select(F.explode(places).alias("at"))
            .groupBy(F.expr("at div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
        )
        words = np.zeros(size, dtype=np.uint64)
        table = rows.toArrow()
        if table.num_rows:
            words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
        return cls(words)

    def has(self, values: np.ndarray) -> np.ndarray:
        values = values.view(np.uint64) if values.dtype == np.int64 else values
        out = np.ones(len(values), dtype=bool)
        for s in self.SHIFTS:
            at = (values >> U(s)) & U(len(self.words) * 64 - 1)
            out &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
        return out


def batches_of(rows: Iterator[tuple], kinds: list, names: list[str], weight: Callable[[tuple], int], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so much weight."""
    held, w = [], 0
    for row in rows:
        held.append(row)
        w += weight(row)
        if w > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, w = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
