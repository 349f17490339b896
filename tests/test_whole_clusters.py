"""Queries over clusters of more documents than the samples of the command line have, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clusterloom.plans import catalogue


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    rng = np.random.default_rng(9)
    label = np.repeat([0, 1, 2], [2600, 2300, 100])
    v = rng.normal(0, 1, (len(label), 8)) + 0.5 * np.eye(8)[label]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[2590:2600] = v[:10]  # equal vectors: the smaller id counts
    path = tmp_path_factory.mktemp("large")
    table = {"vec_id": pa.array(rng.permutation(len(label))), "embedding": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}
    pq.write_table(pa.table(table), path / "embeddings.parquet")
    return str(path)


def both(spark, d, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    return sorted(map(tuple, catalogue.queries()[name](spark, d).collect())), sorted(con.sql(catalogue.oracle_sql()[name]).fetchall())


def test_medoids_of_large_clusters(spark, large):
    got, want = both(spark, large, "medoids")
    assert got == want


def test_voorhees_of_large_clusters(spark, large):
    got, want = both(spark, large, "voorhees")
    assert got == want
