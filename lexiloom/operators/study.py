"""Figures of layer and occurrence studies: rankings, extreme cells, block means, differences, spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V


def complex_norms(re: Column, im: Column) -> Column:
    """Norms of the real part, the imaginary part and both, and imaginary over real (null if there is no real part)."""
    a, b = V.dot(re, re), V.dot(im, im)
    return F.struct(F.sqrt(a).alias("re"), F.sqrt(b).alias("im"), F.sqrt(a + b).alias("total"), F.when(a > 0, F.sqrt(b) / F.sqrt(a)).alias("ratio"))


def stability(layers: DataFrame) -> DataFrame:
    """(layer, mean, std) -> layer, cv, rank, label: least variation first. One row a layer, so ranked in one task."""
    size = F.abs("cv")
    label = F.when(size < 0.01, "very stable").when(size < 0.02, "stable").when(size < 0.05, "moderate").otherwise("variable")
    rows = layers.select("layer", (F.col("std") / F.col("mean")).alias("cv"))
    return rows.select("layer", "cv", F.row_number().over(W.orderBy(size, "layer")).alias("rank"), label.alias("label"))


def extreme_pairs(p: DataFrame) -> DataFrame:
    """The most and the least similar pair of each word, ties to the first pair; partial aggregates only."""
    large = F.min(F.struct((-F.col("sim")).alias("s"), "i", "j")).alias("large")
    small = F.min(F.struct(F.col("sim").alias("s"), "i", "j")).alias("small")
    out = p.groupBy("word").agg(large, small)
    return out.select(
        "word", F.col("large.i").alias("large_i"), F.col("large.j").alias("large_j"), (-F.col("large.s")).alias("largest"),
        F.col("small.i").alias("small_i"), F.col("small.j").alias("small_j"), F.col("small.s").alias("smallest"),
    )


def layer_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Layer means of b less those of a: their mean, and the largest and least with its layer (ties: the first)."""
    d = a.select("layer", F.col("mean").alias("x")).join(b.select("layer", F.col("mean").alias("y")), "layer").select("layer", (F.col("y") - F.col("x")).alias("d"))
    top, low = F.min(F.struct((-F.col("d")).alias("d"), "layer")), F.min(F.struct("d", "layer"))
    out = d.agg(F.avg("d").alias("mean"), top.alias("top"), low.alias("low"))
    return out.select("mean", (-F.col("top.d")).alias("max"), F.col("top.layer").alias("max_layer"), F.col("low.d").alias("min"), F.col("low.layer").alias("min_layer"))


def block_means(units: DataFrame, width: int) -> DataFrame:
    """Mean similarity within each word (pairs once, no diagonal) and between each two words: a, b, n, mean.

    From sums of unit vectors: between words it is the product of the sums over the product of the counts, and within one
    (|sum|^2 - n) / 2 over n (n - 1) / 2. So the work is linear in vectors, and only the words themselves meet in pairs.
    """
    sums = units.groupBy("word").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(width)]).alias("s"), F.count("u").alias("n"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("own"))
    x, y = (sums.select(*[F.col(c).alias(f"{side}{c}") for c in sums.columns]) for side in ("x", "y"))
    one = F.col("xword") == F.col("yword")
    n = F.when(one, (F.col("xn") * (F.col("xn") - 1) / 2).cast("long")).otherwise(F.col("xn") * F.col("yn"))
    all_ = V.dot(F.col("xs"), F.col("ys"))
    rows = x.join(y, F.col("xword") <= F.col("yword")).withColumn("n", n).where("n > 0")
    return rows.select(F.col("xword").alias("a"), F.col("yword").alias("b"), "n", (F.when(one, (all_ - F.col("xown")) / 2).otherwise(all_) / F.col("n")).alias("mean"))


def cumulative(shares: DataFrame, share: str, key: str, percent: float = 95) -> DataFrame:
    """Running sum of shares, largest first, and the number of dimensions that `percent` needs; one row a dimension."""
    run = F.sum(share).over(W.orderBy(F.desc(share), key).rowsBetween(W.unboundedPreceding, 0))
    rows = shares.withColumn("cumulative", run)
    within = F.sum(F.when(F.col("cumulative") <= percent, 1).otherwise(0)).over(W.partitionBy())
    return rows.withColumn("effective", within + 1)
