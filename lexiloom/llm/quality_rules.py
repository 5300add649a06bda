"""Quality rules: a threshold table compiled into one native projection (no user functions, no shuffle).

``measure`` derives length, symbol, stop-word, line and repetition figures of whole texts with built-in expressions;
``verdict`` compiles the rows of ``RULES`` over those figures. Null and empty texts measure 0 everywhere and fail the
base rule; rows with a null id are kept as rows; input columns of any name are untouched, since figures travel in one
struct column under a free name. Repeated rows are judged alike, an empty table gives an empty table, and a very long text is
measured whole, in one task.

Distinct words a word fall with the length of any text, so beyond ``BLOCK`` words that rule is held against the mean over
blocks of ``BLOCK`` words (the rest at the end counts by its words); up to there it is the ratio over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, table

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich und von zu "
    "como con del el es las lo los no para por se su y"
)

#: (rule, numerator, denominator, least, most); null: no bound. The base rule of the contract is apart.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    ("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    ("distinct_words_per_word", "n_unique_words", "n_words", 0.25, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.3),
)
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
BLOCK = 1000
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_unique_words", "n_lines")


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _covered(pairs: Column) -> Column:
    """Words in windows whose hash occurs twice: `pairs` is sorted (hash, position); coverage of sorted positions."""
    twice = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
    return F.array_sort(F.transform(twice, lambda p: p["i"]))


def measure(docs: DataFrame, text: str = "text", into: str = "figures") -> DataFrame:
    """docs and one struct column `into` with FIGURES and n_unique_in_blocks (long)."""
    w, h, p, at = (_free(docs, f"__{x}") for x in ("w", "h", "p", "at"))
    t = F.coalesce(F.col(text), F.lit(""))
    stop = r"(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(set(STOP_WORDS.split()))) + r")(?=[.,;:!?]?(?:[\x20\x09-\x0D]|$))"
    first = F.struct(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("symbols"),
        F.regexp_count(F.lower(t), F.lit(stop)).alias("stops"),
    )
    words = F.col(w)["words"]
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    windows = F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)])),
    )
    # sorting is only for texts in which some window recurs
    pairs = F.when(F.size(F.array_distinct(p)) < F.size(p), F.array_sort(F.transform(F.col(p), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    spans = F.col(at)
    reach = F.aggregate(
        F.transform(spans, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(spans, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x
    )
    lines = F.col(w)["lines"]
    unique = F.coalesce(F.size(F.array_distinct(h)), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / BLOCK).cast("int")), lambda i: F.size(F.array_distinct(F.slice(h, i * BLOCK + 1, BLOCK))))
    in_blocks = F.when(F.size(h) > BLOCK, F.aggregate(blocks, F.lit(0), lambda s, x: s + x)).otherwise(unique)
    figures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col(w)["symbols"].cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(reach, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col(w)["stops"].cast("long").alias("n_stop_words"),
        unique.cast("long").alias("n_unique_words"),
        F.size(lines).cast("long").alias("n_lines"),
        in_blocks.cast("long").alias("n_unique_in_blocks"),
    )
    out = docs.withColumn(w, first).withColumn(h, hashes).withColumn(p, windows).withColumn(p, pairs).withColumn(at, _covered(F.col(p)))
    return out.select(*[docs[f"`{c}`"] for c in docs.columns], figures.alias(into))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"])


def verdict(f: Column, rules=RULES) -> Column:
    """True where the base rule and every row of the table hold."""
    ok = ~base_failed(f)
    for _, num, den, least, most in rules:
        num = "n_unique_in_blocks" if num == "n_unique_words" else num
        if least is not None:
            ok &= f[num] >= F.lit(least) * f[den]
        if most is not None:
            ok &= f[num] <= F.lit(most) * f[den]
    return ok


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns.

    Rows are dropped by explode and not by a filter, which the optimizer would push below the projections that derive
    the figures and so repeat their expressions many times over.
    """
    name, ok = _free(docs, "__figures"), _free(docs, "__ok")
    passed = F.filter(F.array(verdict(F.col(name))), lambda x: x)
    return measure(docs, text, name).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(passed).alias(ok)).drop(ok)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = F.col("figures")
    return measure(docs).select("doc_id", *[f[x].alias(x) for x in FIGURES], base_failed(f).alias("base_failed"), verdict(f).alias("kept"))


def oracle() -> str:
    stops = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    tests = [f"{num} >= {least} * {den}" for _, num, den, least, _ in RULES if least is not None]
    tests += [f"{num} <= {most} * {den}" for _, num, den, _, most in RULES if most is not None]
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
keyed AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_replace(lower(x), '[.,;:!?]$', '') IN ({stops})))::BIGINT AS n_stop_words,
         len(list_distinct(ws))::BIGINT AS n_unique_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cover USING (doc_id)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM g"""
