"""Quality classifier by importance resampling of hashed n-grams.

Texts are bags of unigrams and bigrams of lower-cased tokens (runs of word characters or of punctuation) hashed to
BUCKETS. The raw model is the bucket frequencies of all documents; the target model those of labelled good documents, a
hash-ordered sample of at most TARGET_ROWS of them. A document's log weight is the sum of log(target / raw) over its
n-grams; adding Gumbel noise keyed by a hash of its id and text and keeping the k best samples k documents without replacement in
proportion to their weights. k is the share of good documents among the labelled ones, of all documents.

Scale: two scans of the texts; of the first, each task emits one row a bucket (BUCKETS of them, whatever the data), and
only the summed table of BUCKETS rows reaches the driver and the second scan. The k-th best key is found exactly by four
histograms of 16 bits each over thin rows, so nothing is sorted and at most 65536 counts are collected at a time.

Defined cases: null and empty texts have weight 0 and take part in the sampling; rows that repeat an id and text share
a key and are kept or dropped together, so where the k-th best is one of them more than k are kept; rows that repeat an id with
other texts, and null ids, are documents of their own; without good labels every weight is 0, and without any labels half the
documents are kept; labels of ids that are not there are ignored; repeated labels count once each; a very long text is counted
whole, in one task; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, table
from lexiloom.llm.words import Hasher, mix, slices, tokens
from lexiloom.runtime import ship

BUCKETS, TARGET_ROWS, SEED = 16384, 4096, 0
SMOOTHING = 1.0


def grams(texts: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of each n-gram, text of each n-gram counted from the first row) of runs of rows."""
    for a, b, data, offsets in slices(texts):
        starts, ends, first = tokens(data, offsets)
        h = Hasher(data, lower=True)(starts, ends)
        own = np.repeat(np.arange(b - a), np.diff(first))
        two = np.flatnonzero(own[1:] == own[:-1])
        pair = mix(h[two] * np.uint64(0x9E3779B97F4A7C15) + h[two + 1])
        yield a, (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64), np.concatenate([own, own[two]])


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, target = batch.columns
            target = np.asarray(target.fill_null(False).cast(pa.int8())).astype(bool)
            for a, bucket, own in grams(texts, buckets):
                raw += np.bincount(bucket, minlength=buckets)
                if target.any():
                    good += np.bincount(bucket[target[own + a]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return run


def _scorer(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, noise, texts = batch.columns
            n = len(texts)
            total, count = np.zeros(n), np.zeros(n, np.int64)
            for a, bucket, own in grams(texts, len(weights)):
                m = int(own.max(initial=-1)) + 1
                total[a : a + m] += np.bincount(own, weights[bucket], m)
                count[a : a + m] += np.bincount(own, minlength=m)
            u = (np.asarray(noise).view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54
            score = total - np.log(-np.log(u))
            bits = score.view(np.int64)
            key = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))  # orders as the score does
            yield pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(total), pa.array(score), pa.array(key)], names=["doc_id", "n_grams", "log_weight", "score", "key"])

    return run


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column `key`, by four histograms; null if there are fewer."""
    found, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        part = keys.where(F.shiftright("key", shift + 16) == found) if shift < 48 else keys
        counts = sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if n >= left:
                found = d
                break
            left -= n
        else:
            return None
    return found


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
             fraction: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, score, kept: one row a row of docs. fraction: kept share; null: that of good labels."""
    ship(spark)
    scratch = Scratch(spark, "dsir")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    fraction = fraction if fraction is not None else known[1] / known[0] if known[0] else 0.5
    good = labels.where(F.col(label) == 1).select(F.col(id_col).alias("good_id")).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(target_rows).distinct()
    marked = rows.join(F.broadcast(good), rows["doc_id"] == good["good_id"], "left").select("text", F.col("good_id").isNotNull().alias("target"))  # at most target_rows
    counts = marked.mapInArrow(_counter(buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for b, r, g in counts:
        raw[b] += r
        target[b] += g
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > SMOOTHING * buckets else np.zeros(buckets)
    scored = rows.select("doc_id", F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id", F.xxhash64("text")).alias("noise"), "text")
    scored = scratch.save(scored.mapInArrow(_scorer(weights), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double, score double, key long"), "scores")
    n = scored.count()
    k = round(fraction * n)
    bar = kth_largest(scored, k) if k else None
    kept = F.lit(False) if not k else F.lit(True) if bar is None else F.col("key") >= bar
    return scored.select("doc_id", "n_grams", "log_weight", "score", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
