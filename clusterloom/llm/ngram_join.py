"""N-gram Jaccard self-join by PartEnum signatures, with exact checks, and its connected components.

Two sets of sizes s and t with a Jaccard similarity of 3/4 or more differ in k = (s + t) / 7 features at most. The
feature domain (64-bit shingle hashes) is cut into n1 first-level parts, more than k / 2, and each of those into SECOND
second-level parts. In a first-level part at least, two such sets differ in one feature at most, so they agree on one of
the subsets that leave out one of its second-level parts. Each subset is a signature: its key, its number and the sum of
the set's features in it. With more parts than needed, T of the n1 agree so. Keys are size bands a third wide; a set signs
under its own band and, for larger partners, under the next one. Sets of up to SMALL features are signed by their subsets.

The join goes in two stages. First, the signatures of the first HEADS parts: each of their buckets pairs its members with
one or two of them, and checked links give first components. These are nearly all. Then, all signatures: buckets of one
component are done, small ones pair their members of different components, and large ones (a passage in thousands of
documents) are named. A set with fewer than T named signatures can do without them: with each partner it shares another.
The other sets are compared inside the large buckets, in blocks and exactly, across components. No component is lost;
links inside one are left out, unless all links are asked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.buckets import BITS, LARGE, PACKED, Bloom, Packer, across, batches_of, cross_pairs, low_bits, part_of, parts_for, stars
from clusterloom.llm.common import drop_stored, pick, stored
from clusterloom.llm.components import components
from clusterloom.llm.hashing import mix, shingle_sets

U = np.uint64
#: Sets of up to SMALL features are signed by subsets; those of SIGNED_TOO more, too, for partners among them.
SMALL, SIGNED_TOO = 7, 2
#: Second-level parts of a first-level one, and first-level parts for each one needed. More: fewer features in each, larger T.
SECOND, SLACK = 3, 1.15
#: How often a set without a guaranteed shared signature is signed anew, over other cuts of the domain.
LEVELS = 8
#: First-level parts whose signatures, one each, make the first stage.
HEADS = 8
#: Up to so many first-level parts, a worker remembers what does not depend on the set.
FEW_PARTS = 4096


def bands(most: int = 1 << 40) -> list[int]:
    """The least size of each band: from SMALL + 1 on, each a third above the one before, rounded up."""
    out = [SMALL + 1]
    while out[-1] < most:
        out.append(-(-4 * out[-1] // 3))
    return out


BANDS = bands()


def parts_of_band(j: int) -> int:
    """First-level parts of the domain for a band whose pairs differ in k features at most: over k / 2, so in one part at least they differ in one feature at most."""
    least = (2 * (BANDS[j + 1] - 1) // 7) // 2 + 1
    return int(np.ceil(SLACK * least))


def _level(s: np.ndarray, level: int) -> np.ndarray:
    return s if level == 0 else np.sort(mix(s ^ U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


@lru_cache(maxsize=512)
def _numbered(parts: int, tag: int) -> np.ndarray:
    """What the number of each subset adds to its signature, (parts, SECOND): the same for all sets of a band."""
    return mix(np.arange(parts * SECOND, dtype=np.uint64).reshape(parts, SECOND) | U(tag << 32))


def _subsets(v: np.ndarray, mixed: np.ndarray, n1: int, tag: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, filled), both (parts, SECOND): of each first-level part (of the first ones only, if given) the subsets
    of SECOND - 1 second-level parts, that is, the part without one of them; filled: whether v has features there. mixed:
    what the features of v add to a signature."""
    parts = n1 if first is None else min(n1, first)
    if parts < n1:
        v = v[: int(np.searchsorted(v, U((((parts << 32) // n1) + 1) << 32)))]
    at = (((v >> U(32)) * U(n1 * SECOND)) >> U(32)).astype(np.int64)
    if parts < n1:
        v, at = v[at < parts * SECOND], at[at < parts * SECOND]
    sums, sizes = np.zeros(parts * SECOND, dtype=np.uint64), np.zeros(parts * SECOND, dtype=np.int64)
    if len(v):
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums[at[begin]], sizes[at[begin]] = np.add.reduceat(mixed[: len(v)], begin), np.diff(np.append(begin, len(v)))
    sums, sizes = sums.reshape(parts, SECOND), sizes.reshape(parts, SECOND)
    sums = sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums
    return mix(sums + (_numbered if parts <= FEW_PARTS else _numbered.__wrapped__)(parts, tag)), sizes.sum(axis=1, keepdims=True) > sizes


def _small(s: np.ndarray) -> np.ndarray:
    """The signatures of a small set: its subsets of three quarters or more."""
    n, e = len(s), mix(s + U(0x51ED270B))
    sums = [e[list(c)].sum(dtype=np.uint64) for size in range(-(-3 * n // 4), min(n, SMALL) + 1) for c in combinations(range(n), size)]
    return mix(np.array(sums, dtype=np.uint64))


def _keys(n: int) -> Iterator[tuple[int, int, int]]:
    """(band, parts, the features in which a set of n and one of the band differ at most) of each key."""
    own = bisect_right(BANDS, n) - 1
    for j in (own, own + 1):
        if (most := min(BANDS[j + 1] - 1, 4 * n // 3)) >= BANDS[j]:
            yield j, parts_of_band(j), (n + most) // 7


def signed(s: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(signatures, T, tag) of a sorted set, for each key and level, which the tag numbers: any set that links with it
    shares T of them or more, under one of its keys, at the first level where either T is positive."""
    n, out = len(s), []
    if 0 < n <= SMALL + SIGNED_TOO:
        out.append((_small(s), 1, 0))
    cuts: list[tuple[np.ndarray, np.ndarray]] = []  # the features at each level, and what they add
    for j, n1, differ in _keys(n) if n > SMALL else ():
        for level in range(LEVELS):
            if level == len(cuts):
                v = _level(s, level)
                cuts.append((v, mix(v + U(0x2545F491))))
            tag = j << 3 | level
            sig, filled = _subsets(*cuts[level], n1, tag)
            shared = n1 - differ // 2 - int((~filled).any(axis=1).sum())
            # Subsets without features are signatures only where no level guarantees another one, a chance of one in many millions.
            out.append((sig[filled] if shared > 0 or level < LEVELS - 1 else sig.ravel(), shared, tag + 1))
            if shared > 0:
                break
    return out


def heads(s: np.ndarray) -> np.ndarray:
    """The signatures of the first stage: one of each of the first parts, or all of a small set."""
    out, mixed = [np.zeros(0, np.uint64)], mix(s + U(0x2545F491))
    if 0 < len(s) <= SMALL + SIGNED_TOO:
        out.append(_small(s))
    for j, n1, _ in _keys(len(s)) if len(s) > SMALL else ():
        sig, filled = _subsets(s, mixed, n1, j << 3, HEADS)
        out.append(sig[:, 0][filled[:, 0]])
    return np.concatenate(out)


def class_of(s: np.ndarray) -> int:
    """A set's identity: a 64-bit hash of all its features and its size, as a signed number."""
    return int(mix(mix(s ^ U(0xD6E8FEB86659FD93)).sum(keepdims=True, dtype=np.uint64) + U(len(s))).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set over 2^m bits, four to eight a feature: two sets differ in as many features at least as their
    sketches differ in bits. A sketch folds to half its length by xor of its halves."""
    m = max(6, int(len(s)).bit_length() + 2)
    bits = np.bincount((mix(s + U(0x7F4A7C15)) & U((1 << m) - 1)).astype(np.int64), minlength=1 << m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def sketches_near(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """Whether sketches allow 100 * intersection >= 75 * union."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 7 * int(np.bitwise_count(x ^ y).sum()) <= na + nb


def _classes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of the non-empty sets of (doc_id, text) batches, those that the task has met lately left out."""
    seen: set[int] = set()
    for batch in batches:
        for _, s in shingle_sets(batch.column(1), n):
            if len(s) and (c := class_of(s)) not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                yield c, s


def _packed(rows: Iterator[tuple[np.ndarray, int, int | None]], parts: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    packer = Packer(parts, most)
    for sigs, c, comp in rows:
        if out := packer.add(sigs, c, comp):
            yield out
    if out := packer.flush():
        yield out


def _all(s: np.ndarray) -> np.ndarray:
    return np.concatenate([x[0] for x in signed(s)])


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, n_shingles, class) has a row for each row of docs, links (a, b) the pairs of
    classes, a < b, with 100 * intersection >= 75 * union; members of a class have equal sets.

    Sets: distinct ``words``-word shingles of the whole text, A-Z in lower case; the whole sequence as one if there are
    fewer words. Null and blank texts have an empty set, class null, and link with nothing. Texts of any length are read
    whole; a set and its signatures have to fit a worker. Repeated rows are members of one class; null ids stay; other
    columns aren't read; an empty table gives no rows. Features are compared by 64-bit hashes. Stages run, and store what
    they find in the shared folder, when this is called.
    """
    own, records, classes = _described(docs, doc_id, text, words)
    links = _searched(own, classes, None, None, words, parts_for(docs.sparkSession, _signatures(records)))
    return _members(records).drop("version"), links


def _members(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "version", F.col("n").alias("n_shingles"), F.col("cls").alias("class"))


def _described(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, records, classes): the rows (doc_id, text, version, a hash of the text); stored, for each the size of its set,
    its class, sketch and first signatures; and for each class size and sketch."""
    own = pick(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    own = own.select("doc_id", own["text"].cast("binary").alias("text"), F.xxhash64("text").alias("version"))

    def describe(batches):
        for batch in batches:
            rows = [(len(s), class_of(s), sketch(s), heads(s).tobytes()) if len(s) else (0, None, None, None) for _, s in shingle_sets(batch.column(1), words)]
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "version", "n", "cls", "sketch", "heads"])

    records = stored(own.mapInArrow(describe, f"doc_id {kind}, version long, n long, cls long, sketch binary, heads binary"), "sets")
    classes = records.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return own, records, classes


def _connected(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(members, components): members as join() gives them, and (node, component) of the classes that link."""
    spark = docs.sparkSession
    own, records, classes = _described(docs, doc_id, text, words)

    def first_stage(batches):
        rows = ((np.frombuffer(h, np.uint64), c, None) for batch in batches for c, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield from _packed(rows, parts)

    parts = parts_for(spark, int(records.agg(F.coalesce(F.sum(F.length("heads")), F.lit(0)).alias("n")).first()["n"]) // 8)
    first = records.where("n > 0").groupBy("cls").agg(F.first("heads").alias("heads")).mapInArrow(first_stage, PACKED)
    near = _near_pairs(stars(first).select("a", "b").distinct(), classes)
    sets, bloom = _sets_of(own, near, words)
    links = _verified(near, sets)
    drop_stored(near)
    known = stored(components(links), "components")
    more = _searched(own, classes, (sets, known), bloom, words, parts_for(spark, _signatures(records)))
    last = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    drop_stored(links, more, sets, known)
    return _members(records), last


def _signatures(records: DataFrame) -> int:
    """About how many signatures all classes have: SECOND for 3.5 features, under two keys."""
    return int(records.where("n > 0").groupBy("cls").agg(F.first("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) * 13 // 10


def _searched(own: DataFrame, classes: DataFrame, before: tuple[DataFrame, DataFrame] | None, bloom: Bloom | None, words: int, parts: int) -> DataFrame:
    """Links between classes of different components: sets and components (node, component) come from before, and the
    Bloom filter names the classes that have a row in those sets. Without them each class is a component and all links are found."""
    spanning = before is not None

    def sign(batches):
        rows = ((_all(s), c, None) for c, s in _classes(batches, words) if bloom is None or not bloom.has(np.array([c]))[0])
        yield from _packed(rows, parts, LARGE)

    def sign_known(batches):
        rows = ((_all(np.frombuffer(s, np.uint64)), c, g) for batch in batches for c, s, g in zip(*(batch.column(k).to_pylist() for k in range(3))))
        yield from _packed(rows, parts, LARGE)

    packed = own.mapInArrow(sign, PACKED)
    if before:
        sets, known = before
        named = sets.join(known.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "s", F.coalesce("component", "cls").alias("comp"))
        packed = packed.unionByName(named.mapInArrow(sign_known, PACKED))
    found = stored(cross_pairs(packed), "pairs")
    near = _near_pairs(found.where("kind = 0").select("a", "b").distinct(), classes)
    large = found.where("kind = 1").select("a", "b").distinct()
    hot, wanted = Bloom.of(large.select(F.col("b").bitwiseXOR(F.shiftleft("b", 24)).alias("name")), "name"), Bloom.of(_ends(near), "cls")

    def again(batches):
        def rows():
            for c, s in _classes(batches, words):
                sigs, tags, needs = [], [], []
                for sig, shared, tag in signed(s):
                    name = low_bits(sig)
                    of = sig[hot.has(name ^ name << U(24))]
                    if len(of) >= max(1, shared):
                        sigs.append(of)
                        tags.append(np.full(len(of), tag))
                        needs.append(np.full(len(of), max(1, shared)))
                if sigs or wanted.has(np.array([c]))[0]:
                    of = np.concatenate([*sigs, np.zeros(0, np.uint64)])
                    yield c, s.tobytes(), part_of(of, parts).astype(np.int64), low_bits(of).astype(np.int64), np.concatenate([*tags, np.zeros(0)]).astype(np.int64), np.concatenate([*needs, np.zeros(0)]).astype(np.int64)

        kinds = [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        yield from batches_of(rows(), kinds, ["cls", "s", "part", "low", "tag", "t"], lambda r: len(r[1]) // 8 + 4 * len(r[2]))

    # One pass for the sets of pairs to check and for those of the large buckets, with the large signatures of each.
    rows = own.mapInArrow(again, "cls long, s binary, part array<long>, low array<long>, tag array<long>, t array<long>")
    rows = stored(rows.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("s", "part", "low", "tag", "t")]), "sets")
    links = _verified(near, rows.select("cls", "s"))
    drop_stored(near)
    rest = rows.select("cls", F.explode(F.arrays_zip("part", "low", "tag", "t")).alias("x")).select("cls", "x.*")
    rest = rest.join(large.select(F.col("a").alias("part"), F.col("b").alias("low")), ["part", "low"])
    if spanning:
        rest = rest.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    else:
        rest = rest.withColumn("comp", F.col("cls"))
    sizes = rest.groupBy("part", "low").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("m")).where("least <> most")
    rest = _needed(rest.join(sizes.select("part", "low", "m"), ["part", "low"]))
    sets = rows.select(F.col("cls").alias("id"), "s", (F.length("s") / 8).alias("size"))
    more = across(rest, sets, lambda s: [np.frombuffer(x, np.uint64) for x in s], lambda common, both: 100 * common >= 75 * (both - common), spanning=spanning)
    out = stored(links.union(more).distinct(), "links")
    drop_stored(found, rows, links)
    return out


def _needed(rest: DataFrame) -> DataFrame:
    """(bucket, id, comp): partners share T signatures of a tag or more among these, so each set can do without T - 1 of
    them, those of the largest buckets. rest: part, low, cls, comp, t, tag and the bucket's size m."""
    bucket = F.col("low").bitwiseXOR(F.shiftleft("part", BITS))
    order = Window.partitionBy("cls", "tag").orderBy("m", "bucket")
    rest = rest.withColumn("bucket", bucket)
    rest = rest.withColumns({"at": F.row_number().over(order), "h": F.count("*").over(Window.partitionBy("cls", "tag"))})
    return stored(rest.where("at <= h - t + 1").select("bucket", F.col("cls").alias("id"), "comp"), "large")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a link: none is lost."""

    def near(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
            kept = [i for i in range(len(a)) if 4 * min(na[i], nb[i]) >= 3 * max(na[i], nb[i]) and sketches_near(sa[i], na[i], sb[i], nb[i])]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long"), "pairs")


def _sets_of(own: DataFrame, pairs: DataFrame, words: int) -> tuple[DataFrame, Bloom]:
    """(cls, s): the sets of all classes that pass a Bloom filter of the pairs' ends, and that filter."""
    bloom = Bloom.of(_ends(pairs), "cls")

    def run(batches):
        rows = ((c, s.tobytes()) for c, s in _classes(batches, words) if bloom.has(np.array([c]))[0])
        yield from batches_of(rows, [pa.int64(), pa.binary()], ["cls", "s"], lambda r: len(r[1]) // 8)

    return stored(own.mapInArrow(run, "cls long, s binary").groupBy("cls").agg(F.first("s").alias("s")), "sets"), bloom


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their sets."""

    def linked(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    left, right = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    return stored(near.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long"), "links")


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, itself included."""
    members, known = _connected(docs, doc_id, text, words)
    own = members.join(known, members["class"] == known["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("group"))
    least = own.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    # Documents without shingles look for no group: they are dealt evenly under groups that match nothing.
    keyed = own.withColumn("key", F.coalesce("group", F.xxhash64("doc_id"))).join(least.withColumnRenamed("group", "key"), "key", "left")
    return keyed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5) -> DataFrame:
    """docs with its own columns, one row of each component: that of the smallest id (null ids come last), of several texts
    under that id the one of the smallest hash, and of rows that repeat both any one. Rows with an equal id and different
    texts are documents of their own. Texts without words are near to nothing: all those rows stay."""
    members, known = _connected(docs, doc_id, text, words)
    own = members.join(known, members["class"] == known["node"], "left").withColumn("group", F.coalesce("component", "class"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    chosen = own.where("n_shingles > 0").groupBy("group", place.alias("place")).agg(F.count("*").alias("n"))
    chosen = chosen.groupBy("group").agg(F.min(F.struct("place", "n")).alias("x"))
    bare = own.where("n_shingles = 0").select("doc_id", "version").distinct().withColumn("n", F.lit(1).cast("long"))
    names = ["_stay_id", "_stay_version", "_stay_n"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    stay = stored(chosen.select("x.place.doc_id", "x.place.version", "x.n").unionByName(bare).toDF(*names), "stay")
    both = docs.join(stay, docs[f"`{doc_id}`"].eqNullSafe(stay[names[0]]) & F.xxhash64(docs[f"`{text}`"]).eqNullSafe(stay[names[1]]))
    if stay.where(F.col(names[2]) > 1).isEmpty():
        return both.drop(*names)
    once = both.where(F.col(names[2]) > 1).dropDuplicates(names[:2])
    return both.where(F.col(names[2]) == 1).unionByName(once).drop(*names)
