"""Files of a format of our own in the folder all machines share: written by tasks, listed in a stored manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(uri: str):
    """(file system, path) of a URI: local for file:, else by Arrow (hdfs:, s3:, gs:)."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def opened(uri: str):
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        yield f


class Writer:
    """A file under a name that no other attempt of the task uses, so a lost or repeated attempt can't harm it."""

    def __init__(self, folder: str, ending: str):
        import uuid

        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() if task else 0
        self.uri = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}{ending}"
        self.system, self.path = _at(self.uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = self.system.open_output_stream(self.path, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def write_files(df: DataFrame, folder: str, ending: str, put: Callable[[Writer, pa.RecordBatch, dict], None], finish: Callable[[Writer, dict], None] | None = None, lists: tuple[str, ...] = ()) -> DataFrame:
    """One file for each task with rows; the stored manifest (part, path, size, n, lists) names the files that count.

    put() writes a batch, with a dict of its own for the task; finish() writes what is left. Files of attempts that
    failed are in no manifest. n is the state's "n" when the file is closed; lists are lists of numbers that it holds.
    """
    from clusterloom.llm.common import stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, state = None, {"n": 0}
        for batch in batches:
            if len(batch):
                writer = writer or Writer(folder, ending)
                put(writer, batch, state)
        if writer:
            if finish:
                finish(writer, state)
            writer.close()
            task = TaskContext.get()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "path": [writer.uri], "size": pa.array([writer.size], pa.int64()), "n": pa.array([state["n"]], pa.int64())} | {k: pa.array([state.get(k, [])], pa.list_(pa.int64())) for k in lists})

    return stored(df.mapInArrow(run, "part long, path string, size long, n long" + "".join(f", {k} array<long>" for k in lists)), "manifest")


def splits(manifest: DataFrame, split: int) -> DataFrame:
    """(path, size, start, end): byte ranges of at most ``split`` bytes, dealt evenly over tasks."""
    out = manifest.where(F.col("size") > 0).select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    out = out.withColumn("end", F.least(F.col("size"), F.col("start") + split))
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split)), F.lit(1)).alias("n")).first()["n"]
    return out.repartition(int(min(max(n, 1), 100_000)))
