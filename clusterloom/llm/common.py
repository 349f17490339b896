"""What several operators share: column helpers and the folder all machines see."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs without ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in names.items()])


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent, as in tests on one machine, a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "clusterloom-checkpoints")
        if "local" not in spark.sparkContext.master or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders that stored() has made and that weren't dropped.
_made: list[str] = []


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    _made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def drop_stored(*frames: DataFrame | None) -> None:
    """Deletes the folders of stored() frames that nothing reads any more, through Hadoop, whatever the file system."""
    for df in frames:
        if df is not None:
            _drop(df.sparkSession, df.stored_at)


def settled(make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The rows of make(), stored; what make() itself has stored on the way goes."""
    before = set(_made)
    out = stored(make(), purpose)
    for path in [p for p in _made if p not in before and p != out.stored_at]:
        _drop(out.sparkSession, path)
    return out
