"""Contours and pairwise similarity: the statistics that need all pairs, in linear time where moments allow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V
from lexiloom.operators import cells as C


#: Vectors of a word that meet those of another block in one task, and those of nearest terms.
BLOCK, TERMS = 2048, 8192


def unit_rows(rows: DataFrame, word: str, idx: str, vector: str) -> DataFrame:
    """(word, idx, u): unit vectors; a zero vector has NaN components, as a contour's cosine does."""
    v = V.doubles(F.col(vector))
    u = V.let(V.l2(v), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(V.NAN)).otherwise(x / F.when(n != 0, n))))
    return rows.where(F.col(vector).isNotNull()).select(F.col(word).alias("word"), F.col(idx).alias("idx"), u.alias("u"))


def pairs(units: DataFrame, places: int | None = None, both: bool = False) -> DataFrame:
    """(word, i, j, sim) for i < j of the same word, each pair once (both: each in either order); sim to so many places, if given."""
    kind = units.schema["idx"].dataType.simpleString()
    return C.by_cell(C.dealt(units, BLOCK), C.each(places, both), f"i {kind}, j {kind}, sim double")


def matrix(units: DataFrame, places: int | None = None) -> DataFrame:
    """The full matrix in long form, diagonal 1."""
    return pairs(units, places, True).union(units.select("word", "idx", "idx", F.lit(1.0)))


def _told(units: DataFrame, quantiles: list[float]) -> DataFrame:
    """One settled row a word that has pairs: what one pass over them gives, and where the quantiles are to be looked for."""
    from lexiloom.runtime import Steps

    return Steps(units.sparkSession, "pairs").settle(C.merged(C.by_cell(C.dealt(units, BLOCK), C.summary, C.SUMMARY), quantiles))


def _quantiles(units: DataFrame, quantiles: list[float]) -> DataFrame:
    """The settled rows with q, the quantiles; a second pass holds only the similarities about them, distinct ones with their number."""
    told = _told(units, quantiles)
    cells = C.by_cell(C.dealt(units, BLOCK, told.select("word", "lo", "hi")), C.bracketed, "k int, below long, values array<double>, times array<long>", ("lo", "hi"))
    return told.join(C.quantiles_of(cells, told, quantiles), "word")


def stats(units: DataFrame) -> DataFrame:
    """Mean, population deviation, least, largest, median and range of pairwise similarity; a word with one vector has no row."""
    median = F.col("q")[0].alias("median")
    return _quantiles(units, [0.5]).select("word", F.col("n").alias("n_pairs"), "mean", "std", F.col("least").alias("min"), F.col("largest").alias("max"), median, (F.col("std") * F.col("std")).alias("variance"), (F.col("largest") - F.col("least")).alias("range"))


def box(units: DataFrame) -> DataFrame:
    """Least, quartiles and largest pairwise similarity of each word."""
    q = [F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3"))]
    return _quantiles(units, [0.25, 0.5, 0.75]).select("word", "least", *q, "largest")


def histogram(units: DataFrame, bins: int = 20, places: int = 6) -> DataFrame:
    """(word, bin, lower, n) of pairwise similarities to some places: equal bins from each word's least to its largest, empty ones left out."""
    told = _told(units, []).select("word", F.round("least", places).alias("lo"), F.round("largest", places).alias("hi")).where("lo is not null")
    counts = C.by_cell(C.dealt(units, BLOCK, told), C.bins_of(places, bins), "bin int, lo double, hi double, n long", ("lo", "hi"))
    lower = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    return counts.groupBy("word", "bin").agg(F.min(lower).alias("lower"), F.sum("n").alias("n"))


def end_pairs(units: DataFrame) -> DataFrame:
    """(word, i, j, sim): the least and the most similar pair of each cell, ties to the first; those of a word are among them."""
    kind = units.schema["idx"].dataType.simpleString()
    return C.by_cell(C.dealt(units, BLOCK), C.extremes, f"i {kind}, j {kind}, sim double")


def moments(units: DataFrame) -> DataFrame:
    """Mean and deviation of pairwise similarity without any pair.

    The sum over pairs is (|S|^2 - n) / 2 for the sum S of unit vectors, and that of squares (|G|^2 - n) / 2 for the
    Frobenius norm of the sum G of their outer products: tasks add up both, and one row a word and task is shuffled.
    """
    from lexiloom.plans.linalg import grams_by_word

    rows = grams_by_word(units.select("word", F.col("u").alias("vector")))
    n, d = F.get("x", F.lit(0)), F.round((F.sqrt(4 * F.size("x") - 3) - 1) / 2).cast("int")
    s, g = F.slice("x", F.lit(2), d), F.slice("x", d + 2, d * d)
    both = rows.select("word", n.cast("long").alias("n"), (n * (n - 1) / 2).alias("m"), V.dot(s, s).alias("first"), V.dot(g, g).alias("second")).where("m > 0")
    first, second = (F.col("first") - F.col("n")) / 2 / F.col("m"), (F.col("second") - F.col("n")) / 2 / F.col("m")
    return both.select("word", "n", first.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), second - first * first)).alias("std"))


def average_per_vector(units: DataFrame, width: int) -> DataFrame:
    """Each vector's mean similarity to the others of its word: (u . S - 1) / (n - 1), so no pairs."""
    sums = units.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get(F.col("u"), i)) for i in range(width)]).alias("s"))
    return units.join(sums, "word").where("n > 1").select("word", "idx", ((V.dot(F.col("u"), F.col("s")) - 1) / (F.col("n") - 1)).alias("avg_sim"))


def extremes(avg: DataFrame, n: int = 3, typical: bool = False) -> DataFrame:
    key = F.desc("avg_sim") if typical else F.asc("avg_sim")
    rank = F.row_number().over(W.partitionBy("word").orderBy(key, "idx"))
    return avg.withColumn("rank", rank).where(F.col("rank") <= n)


def static_similarity(units: DataFrame, static: DataFrame) -> DataFrame:
    """Mean and deviation of the similarity to each word's static vector (word, s)."""
    sims = units.join(static, "word").select("word", V.dot(F.col("u"), F.col("s")).alias("sim"))
    return sims.groupBy("word").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.count(F.lit(1)).alias("n"))


def nearest(terms: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """The n most similar terms of each query by cosine; both (term, u). A block of queries and one of terms give the n of each in one task."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "term"))
    return C.nearest(terms, queries, n, TERMS).withColumn("rank", rank).where(F.col("rank") <= n)


def variance_label(v: Column) -> Column:
    return F.when(v < 0.005, "low").when(v < 0.01, "moderate").otherwise("high")


def coherence_label(mean: Column) -> Column:
    return F.when(mean > 0.75, "high").when(mean > 0.6, "moderate").otherwise("low")


def variation_label(std: Column) -> Column:
    return F.when(std > 0.15, "high").when(std > 0.08, "moderate").otherwise("low")


def stability_label(cv: Column) -> Column:
    return F.when(cv < 0.01, "very stable").when(cv < 0.02, "stable").when(cv < 0.05, "moderate").otherwise("variable")


def contour(rows: DataFrame, word: str, doc: str, start: str, vector: str, key: list[str]) -> DataFrame:
    """Rows with vectors, one a (doc, start): the first by key; rows without either are all kept."""
    rows = rows.where(F.col(vector).isNotNull())
    free = F.col(doc).isNull() & F.col(start).isNull()
    apart = F.when(free, F.xxhash64(*key))  # rows without a place are dealt out, and read once with the others
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(word, doc, start, apart).orderBy(*key))).where((F.col("__n") == 1) | free).drop("__n")


# statistics by layer

def layer_stats(units: DataFrame) -> DataFrame:
    """(layer, mean, std) of pairwise similarity, a layer being the word of unit rows; linear in vectors."""
    return moments(units).select(F.col("word").alias("layer"), "mean", "std")


def layer_bands(layers: DataFrame) -> DataFrame:
    """Means of layer means: 0-3 early, 4-7 middle, 8 and over late."""
    band = F.when(F.col("layer") < 4, "early").when(F.col("layer") < 8, "middle").otherwise("late")
    return layers.groupBy(band.alias("band")).agg(F.avg("mean").alias("mean"))


def layer_extremes(layers: DataFrame) -> DataFrame:
    s = F.struct(F.col("mean"), -F.col("layer"))
    return layers.agg((-F.max(s)["col2"]).alias("argmax"), F.min(F.struct("mean", "layer"))["layer"].alias("argmin"))


def spread(layers: DataFrame) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit(0.25), F.lit(0.75)))
    agg = layers.agg((F.stddev_pop("mean") / F.avg("mean")).alias("cv"), (F.max("mean") - F.min("mean")).alias("range"), q.alias("q"), F.regr_slope("mean", "layer").alias("slope"))
    return agg.select("cv", "range", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "slope")


def min_max(layers: DataFrame) -> DataFrame:
    lo, hi = F.min("mean").over(W.partitionBy()), F.max("mean").over(W.partitionBy())
    return layers.select("layer", F.when(hi > lo, (F.col("mean") - lo) / F.when(hi > lo, hi - lo)).otherwise(0.0).alias("scaled"))
