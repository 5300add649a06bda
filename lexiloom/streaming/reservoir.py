"""A reservoir over an unbounded stream: the k rows of least hash, kept batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.sampling import order


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reservoir(stream: DataFrame, k: int, key: list[str], path: str, checkpoint: str, seed: int = 0, most_rows: int | None = None) -> StreamingQuery:
    """Writes the reservoir after each batch to path/batch=N; the k rows of least MD5 of all rows so far are exactly those
    of a batch sample, and the state is k rows and a count. A batch that is run again overwrites its own folder; the one
    before it stays for that, older ones go. most_rows bounds the scan: what comes after so many rows is not looked at.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        seen = 0
        if most_rows is not None:
            seen = spark.read.schema("n long").parquet(f"{path}-seen/batch={n - 1}").first()["n"] if n else 0
            batch = batch.limit(max(0, most_rows - seen))
            spark.createDataFrame([(seen + batch.count(),)], "n long").write.mode("overwrite").parquet(f"{path}-seen/batch={n}")
        new = batch.orderBy(order(seed, *key), *key).limit(k)
        if n:
            new = spark.read.schema(batch.schema).parquet(f"{path}/batch={n - 1}").unionByName(new).orderBy(order(seed, *key), *key).limit(k)
        new.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n > 1:
            _delete(spark, f"{path}/batch={n - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The reservoir after the last batch."""
    rows = spark.read.parquet(path)
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of the batches that the engine still remembers."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
