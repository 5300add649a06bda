"""Tokens, alignment, fragments, encoders and pooling: from prepared units to one vector a unit."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.runtime import SLICE, ship


_WORDS = re.compile(r"\w+|[^\w\s]")


def tokenize(units: DataFrame, text: str = "text") -> DataFrame:
    """units with tokens: runs of word characters and single marks. Linear in a text, however long."""
    return T.with_spans(units, text, T.found(_WORDS), "tokens")


@lru_cache(4)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core a task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their names in a text are ordinary text
    return t


def tokenize_with(units: DataFrame, path: str, text: str = "text") -> DataFrame:
    """units with tokens of a tokenizer file, with their offsets in the text; read once a Python worker.

    The file is a parameter and must lie where all workers read it.
    """

    def find(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        return [[(a, b, t) for (a, b), t in zip(e.offsets, e.tokens, strict=True)] for e in _loaded(path).encode_batch(texts, add_special_tokens=False)]

    return T.with_spans(units, text, find, "tokens")


def align(tokens: Column, start: Column, end: Column) -> Column:
    """Indices of the tokens that overlap [start, end); empty tokens are special and never do."""
    hit = F.transform(tokens, lambda t, i: F.when((t["end"] > t["start"]) & (t["start"] < end) & (start < t["end"]), i))
    return F.filter(hit, lambda i: i.isNotNull())


def fragments(units: DataFrame, n: str, max_tokens: int = 512, strategy: str = "sliding_windows", window: int | None = None, stride: int | None = None, special: int = 2) -> DataFrame:
    """One row a fragment of units with n tokens: fragment_index, n_fragments, fragmentation, from_token, to_token."""
    window = window or max_tokens
    budget = max(1, window - special)
    size = F.col(n)
    if strategy == "truncate":
        ranges = F.array(F.struct(F.lit(0).alias("a"), F.least(size, F.lit(budget)).alias("b")))
    else:
        if strategy not in ("fixed", "sliding_windows"):
            raise ValueError("strategy must be truncate, fixed or sliding_windows")
        step = budget if strategy == "fixed" else max((stride or window // 2) - special, 1)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + budget < size))
        ranges = F.transform(starts, lambda s: F.struct(s.alias("a"), F.least(s + budget, size).alias("b")))
    whole = size <= max_tokens
    ranges = F.when(whole, F.array(F.struct(F.lit(0).alias("a"), size.alias("b")))).otherwise(ranges)
    rows = units.withColumn("n_fragments", F.size(ranges)).withColumn("fragmentation", F.when(whole, "none").otherwise(strategy))
    return rows.select(*[c for c in rows.columns], F.posexplode(ranges).alias("fragment_index", "r")).withColumn("from_token", F.col("r.a")).withColumn("to_token", F.col("r.b")).drop("r")


def centre(n: Column, first: Column, last: Column, budget: int) -> Column:
    """struct<a, b>: a window of the budget around the tokens first..last of n; what one edge lacks goes to the other."""
    free = F.greatest(F.lit(budget) - (last - first + 1), F.lit(0))
    a = F.greatest(first - F.floor(free / 2).cast("int"), F.lit(0))
    b = F.least(F.greatest(a + budget, last + 1), n)
    a = F.greatest(F.least(a, F.greatest(b - budget, F.lit(0))), F.lit(0))
    return F.struct(a.alias("a"), b.alias("b"))


class Encoder(Protocol):
    """Vectors of the tokens of one unit: (layers, tokens, width).

    An encoder may have `reach`: a token's vector depends on so many tokens on either side and on none beyond.
    """

    width: int
    layers: int

    def __call__(self, tokens: list[str]) -> np.ndarray: ...


@lru_cache(1 << 16)
def _hashed(token: str, width: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.PCG64(seed)).standard_normal(width)


class HashEncoder:
    """A deterministic stand-in for a model: a token's vector by layer and position comes from its hash."""

    reach = 1

    def __init__(self, width: int = 16, layers: int = 4):
        self.width, self.layers = width, layers

    def static(self, token: str) -> np.ndarray:
        return _hashed(token, self.width)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        base = np.array([self.static(t) for t in tokens]).reshape(len(tokens), self.width)
        around, n = base.copy(), np.ones((len(tokens), 1))
        around[1:] += base[:-1]
        around[:-1] += base[1:]
        n[1:] += 1
        n[:-1] += 1
        around /= n
        k = np.arange(1, self.layers + 1).reshape(-1, 1, 1)
        return base * (1 - k / (2 * self.layers)) + around * k / (2 * self.layers)


def vectors_at(encoder: Encoder, tokens: list[str], at: list[int]) -> np.ndarray:
    """(layers, at, width): vectors of the tokens at some places; an encoder that says its reach sees no more than that around each."""
    if (reach := getattr(encoder, "reach", None)) is None or len(at) * (2 * reach + 1) >= len(tokens):
        return encoder(tokens)[:, at]
    out = np.empty((encoder.layers, len(at), encoder.width))
    for n, k in enumerate(at):
        low = max(0, k - reach)
        out[:, n] = encoder(tokens[low : k + reach + 1])[:, k - low]
    return out


def encode(units: DataFrame, encoder: Encoder, key: list[str], words: str = "words", layer: str = "last", n_last: int = 4, at: str | None = None) -> DataFrame:
    """key and token_vectors (array<array<double>>): the last layer, or the mean of the n last.

    at: a column of token indices, to have the vectors of those alone (an index that no token has gives null). A slice of
    units is encoded at once and its vectors go as flat arrays, so memory does not grow with a batch.
    """
    ship(units.sparkSession)
    inner = units.select(*key, words, *([at] if at else []))
    kinds = ", ".join(f"{k} {inner.schema[k].dataType.simpleString()}" for k in key)

    def picked(tokens: list[str], places: list[int] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Vectors, and which of the places have none."""
        if places is None:
            stack, none = encoder(tokens), None
        else:
            none = np.array([k is None or not 0 <= k < len(tokens) for k in places], bool)
            stack = vectors_at(encoder, tokens, [k for k, no in zip(places, none, strict=True) if not no])
        return stack[-1] if layer == "last" else stack[-n_last:].mean(axis=0), none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                tokens = part.column(len(key)).to_pylist()
                places = part.column(len(key) + 1).to_pylist() if at else [None] * len(tokens)
                both = [picked(t, p) for t, p in zip(tokens, places, strict=True)]
                flat = np.concatenate([x for x, _ in both])
                none = np.concatenate([np.zeros(len(x), bool) if no is None else no for x, no in both])
                sizes = [len(x) if no is None else len(no) for x, no in both]
                # a null list has no values, and its offset is where the next one begins
                ends = np.r_[0, np.cumsum(np.where(none, 0, encoder.width))].astype(np.int32)
                inner_lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False) if none.any() else None), pa.array(flat.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), inner_lists)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], lists], names=[*key, "token_vectors"])

    return inner.mapInArrow(run, f"{kinds}, token_vectors array<array<double>>")


def aggregate_units(units: DataFrame, width: int, strategy: str = "mean_pooling", representative: str = "first") -> DataFrame:
    """vector and aggregation of units with token_vectors and indices (null: a whole unit); the reason where there is none."""
    picked = F.when(F.col("indices").isNull(), F.col("token_vectors")).otherwise(F.transform("indices", lambda i: F.get(F.col("token_vectors"), i)))
    if strategy == "mean_pooling":
        vector = V.pool(picked, "mean", width)
    elif strategy == "representative_token":
        vector = F.get(picked, 0) if representative in ("first", "cls") else F.get(picked, F.size(picked) - 1)
    else:
        raise ValueError("strategy must be mean_pooling or representative_token")
    reason = F.when(F.size("token_vectors") == 0, "no_tokens").when(F.size(picked) == 0, "segment_not_aligned").otherwise(strategy)
    return units.withColumn("vector", F.when(F.size(picked) > 0, vector)).withColumn("aggregation", reason)


def static_vectors(words: DataFrame, lexicon: DataFrame, width: int, how: str = "mean", normalize: bool = True) -> DataFrame:
    """(word) and (term, vector) -> (word, vector): pooled vectors of the word's pieces; a word without any has no row."""
    pieces = words.select("word", F.posexplode(F.split(F.lower("word"), r"[\s_-]+")).alias("pos", "term")).join(lexicon, "term")
    rows = pieces.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("p"))
    vector = V.pool(F.transform("p", lambda x: x["vector"]), how, width)
    rows = rows.select("word", vector.alias("vector"))
    return rows.withColumn("vector", V.let(V.l2(F.col("vector")), lambda n: F.transform("vector", lambda x: x / (n + 1e-12)))) if normalize else rows
