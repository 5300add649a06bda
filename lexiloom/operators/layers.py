"""Vectors by layer: stacks as rows, one occurrence's contextual vector, trends over layers and agreement of models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators.tokens import align
from lexiloom.sources.lexicons import select_layer

MAX_TOKENS = {"bert": 512, "gpt2": 1024}


def layer_rows(rows: DataFrame, stack: str, embedding_first: bool = True) -> DataFrame:
    """One row a layer 1 to L with its vector; the embedding layer, where it comes first, is left out."""
    layers = F.slice(stack, 2, F.greatest(F.size(stack) - 1, F.lit(0))) if embedding_first else F.col(stack)
    others = [c for c in rows.columns if c != stack]
    return rows.select(*others, F.posexplode(layers).alias("layer", "vector")).withColumn("layer", F.col("layer") + 1)


def with_static(layers: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Layer rows (key, layer, vector) with each key's static vector as layer 0."""
    return layers.select(key, "layer", "vector").unionByName(static.select(key, F.lit(0).alias("layer"), "vector"))


def occurrence(spans: Column, k: int = 0) -> Column:
    """The k-th span, from 0; out of range is an error."""
    told = F.raise_error(F.concat(F.lit("occurrence out of range (0.."), (F.size(spans) - 1).cast("string"), F.lit(")")))
    kind = "struct<start:int,end:int,text:string>"
    return F.when((F.lit(k) >= 0) & (F.lit(k) < F.size(spans)), F.get(spans, k)).otherwise(told.cast(kind))


def term_spans(text: Column, term: str, case_sensitive: bool = False) -> Column:
    """Spans of a term as it stands, anywhere."""
    escaped = re.sub(r"([^\w\s])", r"\\\1", term)
    return T.matches(text, escaped if case_sensitive else f"(?iu){escaped}")


def target_tokens(units: DataFrame, term: str, k: int = 0, text: str = "text", model: str = "bert", case_sensitive: bool = False) -> DataFrame:
    """units (with tokens) and `indices` of the tokens that overlap the k-th occurrence; one lost to truncation is an error.

    Two special tokens count towards a model's limit.
    """
    kept = F.slice("tokens", 1, MAX_TOKENS[model] - 2)
    span = occurrence(term_spans(F.col(text), term, case_sensitive), k)
    rows = units.withColumn("__span", span).withColumn("indices", align(kept, F.col("__span.start"), F.col("__span.end")))
    told = F.raise_error(F.lit("the term has no token")).cast("array<int>")
    return rows.withColumn("indices", F.when(F.size("indices") > 0, F.col("indices")).otherwise(told)).drop("__span")


def contextual_vector(units: DataFrame, width: int, how: str = "mean", output_layer: str | int = "last", complex_vector: bool = False) -> DataFrame:
    """units (layers: array<layer array<token vector>>, indices, n_tokens) and `vector`; complex: also `imaginary`.

    Tokens of the term are pooled within each layer; the imaginary part is the positional pattern of their mean place.
    """
    pooled = F.transform("layers", lambda layer: V.pool(F.transform("indices", lambda i: F.get(layer, i)), how, width))
    rows = units.withColumn("vector", select_layer(pooled, output_layer))
    if complex_vector:
        place = F.aggregate("indices", F.lit(0.0), lambda s, i: s + i) / F.size("indices") / F.col("n_tokens")
        rows = rows.withColumn("imaginary", V.positional(place, width))
    return rows


def band_trend(layers: DataFrame) -> DataFrame:
    """(layer, mean) -> means of layers 0-3, 4-7 and 8 on, and the differences early to middle, middle to late, early to late."""
    band = lambda a, b: F.avg(F.when((F.col("layer") >= a) & (F.col("layer") < b), F.col("mean")))
    out = layers.agg(band(0, 4).alias("early"), band(4, 8).alias("middle"), band(8, 2**30).alias("late"))
    e, m, late = F.col("early"), F.col("middle"), F.col("late")
    return out.select("early", "middle", "late", (m - e).alias("early_middle"), (late - m).alias("middle_late"), (late - e).alias("overall"))


def model_agreement(cells: DataFrame) -> DataFrame:
    """(model_a, kind_a, model_b, kind_b, r) -> mean r within a model, between models of a kind, their difference."""
    same = F.col("model_a") == F.col("model_b")
    out = cells.agg(
        F.avg(F.when(same & (F.col("kind_a") != F.col("kind_b")), F.col("r"))).alias("intra"), F.avg(F.when(~same & (F.col("kind_a") == F.col("kind_b")), F.col("r"))).alias("inter"),
    )
    return out.withColumn("difference", F.col("intra") - F.col("inter"))


def agreement(units: DataFrame, model: Column, kind: Column, width: int) -> DataFrame:
    """model_agreement of all pairs of a word's unit vectors, of a model and a kind each, without any pair.

    The sum over pairs of two groups is the product of their sums, so only the sums of groups of a word meet.
    """
    groups = units.groupBy("word", model.alias("m"), kind.alias("k")).agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(width)]).alias("s"), F.count("u").alias("n"))
    a, b = (groups.select("word", *[F.col(c).alias(c + side) for c in "mksn"]) for side in "ab")
    both = a.join(b, "word").select((F.col("ma") == F.col("mb")).alias("same"), (F.col("ka") == F.col("kb")).alias("alike"), V.dot(F.col("sa"), F.col("sb")).alias("r"), (F.col("na") * F.col("nb")).alias("n"))
    mean = lambda which: F.try_divide(F.sum(F.when(which, F.col("r"))), F.sum(F.when(which, F.col("n"))))
    out = both.agg(mean(F.col("same") & ~F.col("alike")).alias("intra"), mean(~F.col("same") & F.col("alike")).alias("inter"))
    return out.withColumn("difference", F.col("intra") - F.col("inter"))


def counts(units: DataFrame) -> DataFrame:
    """Units, aligned ones (some token index), those with a vector, and those without by reason."""
    c = lambda x: F.count_if(x)
    return units.agg(
        F.count(F.lit(1)).alias("n_units"), c(F.coalesce(F.size("indices") > 0, F.lit(False))).alias("n_aligned"), c(F.col("vector").isNotNull()).alias("n_vectors"),
        c(F.col("aggregation") == "no_tokens").alias("n_no_tokens"), c(F.col("aggregation") == "segment_not_aligned").alias("n_not_aligned"),
    )


def first_appearance(units: DataFrame, group: str, place: list[str]) -> DataFrame:
    """(group, position): groups in the order in which they first appear. One row a group meets in one task to be numbered."""
    first = units.groupBy(group).agg(F.min(F.struct(*place)).alias("p"))
    return first.select(group, (F.row_number().over(W.orderBy("p")) - 1).alias("position"))


def conclusion(std: Column, mean: Column) -> Column:
    """polysemous, flexible, controlled or stable, from the labels of variation and coherence."""
    from lexiloom.operators.similarity import coherence_label, variation_label

    v, c = variation_label(std), coherence_label(mean)
    return F.when((v == "high") & (c == "low"), "polysemous").when(v == "high", "flexible").when(v == "moderate", "controlled").otherwise("stable")
