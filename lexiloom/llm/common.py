"""Shared-folder scratch tables, table access and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.runtime import scratch_dir

#: The words of every contract: maximal runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else scratch_dir(spark)


_kept: list[Scratch] = []


@atexit.register
def _clear() -> None:
    """Results read their scratch tables lazily, so those go when the driver ends."""
    for x in _kept:
        try:
            x.delete("")
        except Exception:  # noqa: BLE001 - the session is gone
            return


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, so a lost executor costs one stage and not the whole plan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _kept.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def delete(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing still to run reads."""
        for name in names:
            self.delete(name)


def word_count(text):
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
