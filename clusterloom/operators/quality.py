"""Five measures of cluster quality, each (label, value); null for clusters of one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions import text as T
from clusterloom.functions.stats import ideal_reciprocal
from clusterloom.functions.vectors import dot, sum_vectors
from clusterloom.operators.graph import top
from clusterloom.operators.sampling import first_of_others, order_key, sample

SMOOTH = 1e-5
#: Query vectors that are broadcast at a time, and similarities that a task holds of them.
QUERIES, HELD = 4096, 4_000_000
#: For ranks: documents of a block, and similarities of a task's queries to their cluster.
DOCS, UNIT = 32_768, 4_000_000


def _named(vectors: DataFrame, label: str, doc_id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(label).alias("label"), F.col(doc_id).alias("doc_id"), F.col(vector).alias("embedding")).where("label is not null and embedding is not null")


def mean_similarities(vectors: DataFrame) -> DataFrame:
    """(label, doc_id, embedding, n, mean_sim): mean cosine to the others of the cluster, from the cluster's sum alone:
    v . (S - v) / (n - 1). One pass, no pairs. Null in clusters of one."""
    sums = sum_vectors(vectors, ["label"])
    n = vectors.groupBy("label").agg(F.count("*").alias("n"))
    both = vectors.join(n.join(sums, "label"), "label")
    mean = (dot(F.col("embedding"), F.col("total")) - dot(F.col("embedding"), F.col("embedding"))) / (F.col("n") - 1)
    return both.select("label", "doc_id", "embedding", "n", F.when(F.col("n") > 1, mean).alias("mean_sim"))


def medoids(vectors: DataFrame, label: str = "label", doc_id: str = "doc_id", vector: str = "embedding", cap: int | None = None, seed: int = 42) -> DataFrame:
    """(label, doc_id, mean_sim, embedding): the most central document of each cluster; ties go to the smaller id. All
    documents count, whatever a cluster's size; with a cap, those of a sample."""
    own = _named(vectors, label, doc_id, vector)
    own = mean_similarities(own if cap is None else sample(own, "label", "doc_id", cap, seed))
    return top(own.where("n > 1"), ["label"], [F.round("mean_sim", 10).desc(), F.col("doc_id")], 1).select("label", "doc_id", "mean_sim", "embedding")


def neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_label, query_id, label, doc_id, sim, rank): the k nearest documents of each query, itself left out.

    Queries go to the tasks in blocks of QUERIES; each task keeps k for each query, so k rows a query and task are
    shuffled, not all similarities.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))
    kinds = dict(vectors.dtypes)
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).select("doc_id", "embedding").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("doc_id").to_numpy()
        q = np.array(part.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        one = vectors.mapInArrow(_nearest(ids, q, k), f"query_id {kinds['doc_id']}, label {kinds['label']}, doc_id {kinds['doc_id']}, sim double")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = vectors.select(F.col("doc_id").alias("query_id"), "label", "doc_id", F.lit(0.0).alias("sim")).limit(0)
    best = top(found, ["query_id"], [F.round("sim", 10).desc(), F.col("doc_id")], k)
    return best.join(queries.select(F.col("doc_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


def _nearest(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            v = np.array(batch.column(batch.schema.get_field_index("embedding")).flatten(), dtype=np.float64).reshape(len(own), -1)
            labels = batch.column(batch.schema.get_field_index("label"))
            step = max(1, HELD // len(own))
            for at in range(0, len(ids), step):
                names = ids[at : at + step]
                sims = np.round(q[at : at + step] @ v.T, 10)
                sims[names[:, None] == own[None, :]] = -2.0
                # Ties at the k-th place are all kept; the last step picks by id.
                last = max(0, len(own) - k)
                kth = np.partition(sims, last, axis=1)[:, last]
                r, c = np.nonzero((sims >= kth[:, None]) & (sims > -2))
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), labels.take(pa.array(c)), pa.array(own[c]), pa.array(sims[r, c])], names=["query_id", "label", "doc_id", "sim"])

    return run


def voorhees(vectors: DataFrame, label: str = "label", doc_id: str = "doc_id", vector: str = "embedding", k: int = 10, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Share of the medoid's k nearest documents that are of its cluster; always divided by k. With a cap, the medoid is
    that of a sample."""
    own = _named(vectors, label, doc_id, vector)
    near = neighbours(medoids(own, cap=cap, seed=seed), own, k)
    share = near.groupBy(F.col("query_label").alias("label")).agg((F.sum((F.col("label") == F.col("query_label")).cast("long")) / k).alias("voorhees_nn"))
    return own.select("label").distinct().join(share, "label", "left")


def overlap(vectors: DataFrame, label: str = "label", doc_id: str = "doc_id", vector: str = "embedding", cap: int = 500, few: int = 200, seed: int = 42) -> DataFrame:
    """Mean similarity inside the cluster less the mean between its first documents and the first of all others.

    Both means come from sums of vectors: pairs inside from (|S|^2 - sum |v|^2) / 2, pairs between from the product of
    two sums. Clusters and complements above the cap are sampled; "first" is in sample order then, else by id.
    """
    own = _named(vectors, label, doc_id, vector)
    total = own.count()
    chosen = sample(own, "label", "doc_id", cap, seed)
    n = own.groupBy("label").agg(F.count("*").alias("c"))
    inside = sum_vectors(chosen, ["label"]).join(chosen.groupBy("label").agg(F.count("*").alias("m"), F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("squares")), "label")
    inside = inside.select("label", F.when(F.col("m") > 1, (dot(F.col("total"), F.col("total")) - F.col("squares")) / (F.col("m") * (F.col("m") - 1))).alias("intra"))
    by_hash, by_id = order_key(seed, F.col("doc_id")), F.col("doc_id")
    sized = own.join(n, "label")
    first = top(sized, ["label"], [F.when(F.col("c") > cap, by_hash), by_id], few)
    left = sum_vectors(first, ["label"], name="a").join(first.groupBy("label").agg(F.count("*").alias("na")), "label")
    # The complement's first documents, by hash where it is above the cap, else by id.
    sides = []
    for large, order in ((True, by_hash), (False, by_id)):
        labels = n.where((F.lit(total) - F.col("c") > cap) if large else (F.lit(total) - F.col("c") <= cap)).select(F.col("label").alias("own_label"))
        sides.append(first_of_others(own, "label", "doc_id", few, order).join(labels, "own_label"))
    others = sides[0].unionByName(sides[1])
    right = sum_vectors(others, ["own_label"], name="b").join(others.groupBy("own_label").agg(F.count("*").alias("nb")), "own_label").withColumnRenamed("own_label", "label")
    both = n.join(inside, "label", "left").join(left, "label", "left").join(right, "label", "left")
    return both.select("label", F.when(F.col("c") > 1, F.col("intra") - dot(F.col("a"), F.col("b")) / (F.col("na") * F.col("nb"))).alias("overlap"))


def nmrd(vectors: DataFrame, label: str = "label", doc_id: str = "doc_id", vector: str = "embedding", cap: int = 200, seed: int = 42) -> DataFrame:
    """Mean over sampled documents of the mean reciprocal rank of their cluster's other members among all documents,
    divided by its best value. The document itself ranks last; ties go to the smaller id.

    A member's rank is one more than the number of documents that beat it, which blocks of documents count apart. So no
    query's similarities are rows, nor sorted as a whole: a task holds some queries of a cluster (UNIT similarities to its
    members at most, one query at least), the cluster's members and one block of documents, and gives one list of counts a query.
    """
    own = _named(vectors, label, doc_id, vector)
    sizes = own.groupBy("label").agg(F.count("*").alias("m"))
    blocks = max(1, -(-own.count() // DOCS))
    units = sizes.select("label", "m", F.ceil(F.least(F.col("m"), F.lit(cap)) * F.col("m") / UNIT).cast("int").alias("units"))
    asked = sample(own, "label", "doc_id", cap, seed).join(units, "label").withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.col("units")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each = ["label", "unit", "doc_id", "embedding"]
    members = own.join(units, "label").select("label", "doc_id", "embedding", every).select(*each, F.lit(False).alias("asks"))
    left = asked.select(*each, F.lit(True).alias("asks")).unionByName(members).select("*", block)
    # Every unit meets every block: a row for each unit goes to all tasks.
    named = F.broadcast(units.select(F.col("label").alias("_label"), every))
    right = own.select(F.col("doc_id").alias("other_id"), F.col("embedding").alias("other"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")).join(named).withColumnsRenamed({"_label": "label"})
    kinds = dict(own.dtypes)

    def count(asked: pa.Table, docs: pa.Table) -> pa.Table:
        kind = asked.schema.field("label").type
        if not asked.num_rows or not docs.num_rows:
            return pa.table({"label": pa.array([], kind), "doc_id": pa.array([], asked.schema.field("doc_id").type), "beaten": pa.array([], pa.list_(pa.int64()))})
        asks = np.array(asked.column("asks").to_pylist())
        ids, v = asked.column("doc_id").to_numpy(), _matrix(asked)
        q, q_ids, of, of_ids = v[asks], ids[asks], v[~asks], ids[~asks]
        order = np.argsort(of_ids, kind="stable")
        of, of_ids, others, other_ids = of[order], of_ids[order], _matrix(docs, "other"), docs.column("other_id").to_numpy()
        beaten = []
        for x, own_id in zip(q, q_ids):
            s, t = np.round(others @ x, 10), np.round(of @ x, 10)
            s[other_ids == own_id] = -2.0
            at = np.lexsort((other_ids, -s))
            s, named = -s[at], other_ids[at]
            low, high = np.searchsorted(s, -t), np.searchsorted(s, -t, "right")
            for k in np.flatnonzero(high > low).tolist():  # equally near: the smaller ids beat it
                low[k] += np.searchsorted(named[low[k] : high[k]], of_ids[k])
            beaten.append(low[of_ids != own_id])
        return pa.table({"label": pa.array([asked.column("label")[0].as_py()] * len(q), kind), "doc_id": pa.array(q_ids), "beaten": pa.array(beaten, pa.list_(pa.int64()))})

    schema = f"label {kinds['label']}, doc_id {kinds['doc_id']}, beaten array<bigint>"
    parts = left.groupBy("label", "unit", "block").cogroup(right.groupBy("label", "unit", "block")).applyInArrow(count, schema)

    def rank(table: pa.Table) -> pa.Table:
        counts = np.sum([np.array(x, dtype=np.int64) for x in table.column("beaten").to_pylist()], axis=0)
        mean = float((1 / (counts + 1)).mean()) if len(counts) else None
        return pa.table({"label": table.column("label").slice(0, 1), "mrr": pa.array([mean], pa.float64())})

    mine = parts.groupBy("label", "doc_id").applyInArrow(rank, f"label {kinds['label']}, mrr double").join(sizes, "label")
    scored = mine.where("mrr is not null").groupBy("label").agg(F.avg(F.col("mrr") / ideal_reciprocal(F.col("m"))).alias("nmrd"))
    return sizes.select("label").join(scored, "label", "left")


def _matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    return np.array(table.column(column).combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def density(docs: DataFrame, label: str = "label", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (document, token) pairs over vocabulary times documents; null for clusters without any token. Texts are
    cut into tokens once; a token's documents are counted where it is read before anything is shuffled."""
    own = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    used = own.select("label", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("label", "token").agg(F.count("*").alias("df"))
    vocabulary = used.groupBy("label").agg(F.count("*").alias("v"), F.sum("df").alias("pairs"))
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(vocabulary, "label", "left").select("label", (F.col("pairs") / (F.col("v") * F.col("n"))).alias("density"))


def kl_divergence(docs: DataFrame, label: str = "label", doc_id: str = "doc_id", text: str = "text", max_docs: int = 200, max_pairs: int = 500, seed: int = 42) -> DataFrame:
    """Mean symmetric Kullback-Leibler divergence of the token distributions of document pairs, smoothed over the
    cluster's vocabulary. A cluster brings max_docs documents and max_pairs pairs to its task at most. Tokens that
    neither document has add one closed term, so no table as wide as the vocabulary is built."""
    own = docs.select(F.col(label).alias("label"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = sample(own, "label", "doc_id", max_docs, seed).select("label", "doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    kind = dict(chosen.dtypes)["label"]

    def run(table: pa.Table) -> pa.Table:
        import hashlib

        ids, tokens = table.column("doc_id").to_pylist(), table.column("tokens").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        ids, tokens = [ids[i] for i in order], [tokens[i] for i in order]
        names: dict[str, int] = {}
        docs = []
        for t in tokens:
            at, n = np.unique([names.setdefault(x, len(names)) for x in t], return_counts=True) if t else (np.zeros(0, int), np.zeros(0, int))
            docs.append((at, n, float(len(t))))
        v, m = len(names), len(docs)
        value = None
        if m > 1 and v:
            pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
            if len(pairs) > max_pairs:
                pairs = sorted(pairs, key=lambda p: (hashlib.md5(f"{seed}-{ids[p[0]]}-{ids[p[1]]}".encode()).hexdigest(), p))[:max_pairs]
            total = 0.0
            for i, j in pairs:
                (a, na, ta), (b, nb, tb) = docs[i], docs[j]
                da, db = ta + SMOOTH * v, tb + SMOOTH * v
                union = np.union1d(a, b)
                p, q = np.full(len(union), SMOOTH / da), np.full(len(union), SMOOTH / db)
                p[np.searchsorted(union, a)] += na / da
                q[np.searchsorted(union, b)] += nb / db
                both = 0.5 * ((p - q) * (np.log(p) - np.log(q))).sum()
                neither = (v - len(union)) * 0.5 * (SMOOTH / da - SMOOTH / db) * (np.log(SMOOTH / da) - np.log(SMOOTH / db))
                total += both + neither
            value = total / len(pairs)
        return pa.table({"label": table.column("label").slice(0, 1), "kl_divergence": pa.array([value], pa.float64())})

    return chosen.groupBy("label").applyInArrow(run, f"label {kind}, kl_divergence double")


def measures(docs: DataFrame, vectors: DataFrame, label: str = "label", doc_id: str = "doc_id", *, k: int = 10, medoid_sample: int | None = None, max_sample: int = 500, max_docs_kl: int = 200, max_pairs_kl: int = 500, max_sample_nmrd: int = 200, seed: int = 42) -> DataFrame:
    """(cluster, voorhees_nn, overlap, kl_divergence, density, nmrd) of every cluster in either table."""
    parts = [
        voorhees(vectors, label, doc_id, k=k, cap=medoid_sample, seed=seed),
        overlap(vectors, label, doc_id, cap=max_sample, seed=seed),
        kl_divergence(docs, label, doc_id, max_docs=max_docs_kl, max_pairs=max_pairs_kl, seed=seed),
        density(docs, label, doc_id),
        nmrd(vectors, label, doc_id, cap=max_sample_nmrd, seed=seed),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "label", "full")
    return out.withColumnRenamed("label", "cluster")
