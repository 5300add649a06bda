"""A whole study of a word from one configuration: concordance, preparation, tokens, vectors, contour, analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import layers as Y
from lexiloom.operators import similarity as S
from lexiloom.operators import tokens as K
from lexiloom.plans import concordance as C
from lexiloom.plans.trace import TraceLog

#: Model ids that are offered by name; any other may be given.
MODELS = (
    "bert-base-uncased", "bert-base-cased", "bert-base-multilingual-cased", "distilbert-base-uncased", "roberta-base", "albert-base-v2", "gpt2", "distilgpt2", "gpt2-medium",
)


@dataclass
class Config:
    concordance: C.Config
    steps: tuple[str, ...] = T.SAFE_DEFAULTS
    tokenizer: str | None = None
    max_tokens: int = 512
    layer: str = "last"
    n_last: int = 4
    pooling: str = "mean_pooling"
    encoder: K.Encoder = field(default_factory=K.HashEncoder)


def prepared(lines: DataFrame, steps=T.SAFE_DEFAULTS) -> DataFrame:
    """Concordance lines with the prepared context and where the occurrence stands in it."""
    whole = F.concat("left", "text", "right")
    start = T.prepare_offset(whole, F.length("left"), steps)
    end = T.prepare_offset(whole, F.length("left") + F.length("text"), steps)
    return lines.withColumn("prepared", T.prepare(whole, steps)).withColumn("p_start", start).withColumn("p_end", end)


def vectors(units: DataFrame, c: Config, lean: bool = False) -> DataFrame:
    """Units with the pooled vector of their occurrence, from a window of max_tokens around it.

    Units are encoded where they are, so neither they nor the vectors of their tokens are shuffled. lean: only doc_id,
    start, vector and aggregation, for which no more than the tokens of the occurrence are encoded.
    """
    t = K.tokenize_with(units, c.tokenizer, "prepared") if c.tokenizer else K.tokenize(units, "prepared")
    t = t.withColumn("indices", K.align(F.col("tokens"), F.col("p_start"), F.col("p_end"))).where(F.size("indices") > 0)
    first, last = F.element_at("indices", 1), F.element_at("indices", -1)
    t = t.withColumn("w", K.centre(F.size("tokens"), first, last, c.max_tokens))
    t = t.withColumn("words", F.transform(F.slice("tokens", F.col("w.a") + 1, F.col("w.b") - F.col("w.a")), lambda x: x["text"]))
    t = t.withColumn("indices", F.transform("indices", lambda i: i - F.col("w.a"))).drop("w", "tokens")
    if lean:
        t = t.select("doc_id", "start", F.col("words").alias("__words"), F.col("indices").alias("__at"))
        some = K.encode(t, c.encoder, ["doc_id", "start"], "__words", c.layer, c.n_last, "__at").withColumn("indices", F.lit(None).cast("array<int>"))
        return K.aggregate_units(some, c.encoder.width, c.pooling).select("doc_id", "start", "vector", "aggregation")
    return K.aggregate_units(K.encode(t.withColumn("__words", F.col("words")), c.encoder, t.columns, "__words", c.layer, c.n_last), c.encoder.width, c.pooling)


def run(documents: DataFrame, c: Config, log: TraceLog | None = None) -> dict[str, DataFrame]:
    """units (with vectors), contour (one vector a place) and analysis (figures and labels of its pairwise similarity)."""
    log = log if log is not None else TraceLog()
    C.check(c.concordance)
    lines = C.run(documents, c.concordance, log)
    ready = prepared(lines, c.steps)
    units = vectors(ready, c)
    log.record("vectors", {"layer": c.layer, "pooling": c.pooling, "max_tokens": c.max_tokens})
    placed = lambda u: S.contour(u.withColumn("word", F.lit(c.concordance.word)), "word", "doc_id", "start", "vector", ["doc_id", "start"])
    contour = placed(units)
    rows = placed(vectors(ready, c, lean=True)).withColumn("idx", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string")))
    m = S.moments(S.unit_rows(rows, "word", "idx", "vector"))
    labels = (S.variance_label(F.col("std") * F.col("std")).alias("variance"), S.variation_label(F.col("std")).alias("variation"), S.coherence_label(F.col("mean")).alias("coherence"))
    log.record("analysis", {"word": c.concordance.word})
    return {"units": units, "contour": contour, "analysis": m.select("word", "n", "mean", "std", *labels, Y.conclusion(F.col("std"), F.col("mean")).alias("conclusion"))}
