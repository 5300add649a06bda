"""Lexicons: tables (term, vector) or (term, layers) that stand in for models, and the corpora of frequent words over them.

A model's vectors are a table; a lookup is an equi-join on the term, so neither vocabulary nor words pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V
from lexiloom.sources.corpora import lines, vector_response

#: Marks of a piece that goes on inside a word, by model type.
CONTINUES = {"bert": "##", "gpt2": ""}
LONGEST_PIECE = 24


def frequent_words(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(term, rank): the n most frequent lower-case words, ties by term."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")).alias("term")).where("term <> ''")
    top = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)
    return top.select("term", F.row_number().over(W.orderBy(F.desc("n"), "term")).alias("rank"))


def corpus(words: DataFrame, lexicon: DataFrame, missing: str = "drop") -> DataFrame:
    """(term, vector) of the words that the lexicon has; missing='raise' makes an absent word an error."""
    if missing not in ("drop", "raise"):
        raise ValueError("missing must be drop or raise")
    if missing == "drop":
        return words.select("term").distinct().join(lexicon, "term")
    told = F.raise_error(F.concat(F.lit("no vector for "), F.col("term")))
    rows = words.select("term").distinct().join(lexicon, "term", "left")
    return rows.select("term", F.when(F.col("vector").isNull(), told).otherwise(F.col("vector")).alias("vector"))


def with_fallback(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term, vector) of words as they are, else of their lower-case form; words without either go."""
    low = lexicon.select(F.col("term").alias("low"), F.col("vector").alias("low_vector"))
    rows = words.select("term").distinct().join(lexicon, "term", "left").withColumn("low", F.lower("term")).join(low, "low", "left")
    return rows.select("term", F.coalesce("vector", "low_vector").alias("vector")).where("vector is not null")


def select_layer(layers: Column, output_layer: str | int = "last") -> Column:
    """Of the vectors of layers 1 to L: the last, all, their average, or one by its number from 0; others are an error."""
    if output_layer == "all":
        return layers
    if output_layer == "last":
        return F.get(layers, F.size(layers) - 1)
    if output_layer == "average":
        width = F.size(F.get(layers, 0))
        zero = F.array_repeat(F.lit(0.0), width)
        return F.transform(F.aggregate(layers, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / F.size(layers))
    if isinstance(output_layer, bool) or not isinstance(output_layer, int):
        raise ValueError("output_layer must be last, all, average or a number")
    told = F.raise_error(F.concat(F.lit("output_layer out of range (0.."), (F.size(layers) - 1).cast("string"), F.lit(")"))).cast("array<double>")
    return F.when((F.lit(output_layer) >= 0) & (F.lit(output_layer) < F.size(layers)), F.get(layers, output_layer)).otherwise(told)


def layered_corpus(words: DataFrame, stacks: DataFrame, output_layer: str | int = "average") -> DataFrame:
    """(term, vector) from (term, layers)."""
    return words.select("term").distinct().join(stacks, "term").select("term", select_layer(F.col("layers"), output_layer).alias("vector"))


def pieces(words: DataFrame, vocabulary: DataFrame, model: str = "bert") -> DataFrame:
    """(word, pieces): greedy longest pieces of a model's vocabulary (term); null where a word cannot be cut.

    All spans of a word meet the vocabulary in one equi-join; the walk over a word's own spans is a fold.
    """
    mark = CONTINUES[model]
    w = words.select("word").distinct().withColumn("x", F.lower("word") if model == "bert" else F.col("word"))
    spans = w.select("word", "x", F.explode(F.sequence(F.lit(1), F.greatest(F.length("x"), F.lit(1)))).alias("a"))
    spans = spans.select("word", "x", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_PIECE), F.greatest(F.length("x") - F.col("a") + 1, F.lit(1))))).alias("n"))
    term = F.concat(F.when(F.col("a") > 1, mark).otherwise(""), F.substring("x", F.col("a"), F.col("n")))
    found = spans.select("word", "x", "a", "n", term.alias("term")).join(vocabulary.select("term").distinct(), "term")
    best = found.groupBy("word", "x", "a").agg(F.max(F.struct("n", "term")).alias("p"))
    held = best.groupBy("word", "x").agg(F.map_from_entries(F.collect_list(F.struct("a", "p"))).alias("m"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        p = F.try_element_at(F.col("m"), i)
        here = (acc["at"] == i) & p.isNotNull()
        return F.struct(F.when(here, i + p["n"]).otherwise(acc["at"]).alias("at"), F.when(here, F.array_append(acc["out"], p["term"])).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(F.sequence(F.lit(1), F.length("x")), start, step)
    rows = held.select("word", F.when(F.length("x") > 0, walk).alias("r"), "x")
    cut = rows.select("word", F.when(F.col("r.at") == F.length("x") + 1, F.col("r.out")).alias("pieces"))
    return words.select("word").distinct().join(cut, "word", "left")


def static_word_vectors(words: DataFrame, lexicon: DataFrame, width: int, model: str = "bert", how: str = "mean") -> DataFrame:
    """(word, vector): pooled vectors of the word's pieces by model type; a word that cannot be cut is an error in the column."""
    cut = pieces(words, lexicon, model)
    rows = cut.where("pieces is not null").select("word", F.posexplode("pieces").alias("pos", "term")).join(lexicon, "term")
    rows = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("p"))
    rows = rows.select("word", V.pool(F.transform("p", lambda x: x["vector"]), how, width).alias("vector"))
    return cut.select("word", F.when(F.col("pieces").isNull(), "no pieces").alias("error")).join(rows, "word", "left")


def from_responses(terms: DataFrame, responses: DataFrame) -> DataFrame:
    """(line, term) and (term, body) -> (term, vector): parsed vectors of the listed terms, a repeated term once."""
    return terms.select("term").distinct().join(responses, "term").select("term", vector_response(F.col("body")).alias("vector")).where(F.size("vector") > 0)


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(line, term) of a file with a term a line; blank lines go."""
    return lines(spark, path).select("line", F.trim("value").alias("term")).where("term <> ''")


def csv_vector(spark: SparkSession, path: str) -> DataFrame:
    """(vector): one vector from the last column of a CSV whose first column is a row number, which goes."""
    rows = spark.read.option("header", True).csv(path)
    key, value = F.col(f"`{rows.columns[0]}`").cast("int"), F.col(f"`{rows.columns[-1]}`").cast("double")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("i"), value.alias("x")))), lambda p: p["x"]).alias("vector"))


def max_tokens(models: DataFrame, fallback: int = 512) -> DataFrame:
    """(model, tokenizer_limit, config_limit) -> (model, max_tokens): the tokenizer's limit if sane, else the configured one."""
    sane = F.when((F.col("tokenizer_limit") > 0) & (F.col("tokenizer_limit") < 100000), F.col("tokenizer_limit"))
    return models.select("model", F.coalesce(sane, F.when(F.col("config_limit") > 0, F.col("config_limit")), F.lit(fallback)).cast("int").alias("max_tokens"))
