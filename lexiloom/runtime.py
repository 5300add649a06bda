"""Makes this package importable in Python workers, however the session was started."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of a batch that a kernel takes apart at once, and rows and characters that it holds before it hands them on.
SLICE, HELD_ROWS, HELD_CHARS = 64, 4096, 1 << 21


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples; no more than a slice of them is ever there as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def handed_on(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that are bounded in rows and in characters, however much a document gives."""
    held: list[tuple] = []
    n = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if type(x) is str)
        if n >= HELD_CHARS or len(held) >= HELD_ROWS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="lexiloom-"), "lexiloom.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexiloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_steps: list[Steps] = []


@atexit.register
def _clear() -> None:
    """Results read their last steps lazily, so those go when the driver ends."""
    for x in _steps:
        try:
            x.delete(x.root)
        except Exception:  # noqa: BLE001 - the session is gone
            return


class Steps:
    """Tables between the steps of an iteration, as Parquet in the shared folder: a lost executor costs one step."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        _steps.append(self)

    def settle(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, before: int) -> None:
        """Deletes all tables up to number `before`."""
        for k in range(1, before + 1):
            self.delete(f"{self.root}/{k}")

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
