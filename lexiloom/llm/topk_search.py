"""Exact top-k inner products by MaxScore over integer vectors.

A component d of a vector is a term; its signed weights form two posting lists, each in order of impact. For a query q
the score bound of term d is the largest contribution q_d * x_d of its list. With the k-th best score so far as the bar,
the terms of least bound whose bounds together stay under the bar are non-essential: a vector that no essential list
holds cannot compete. Essential lists are traversed from the largest bound down; the candidates they give are probed in
the other terms, and dropped as soon as their partial score and the bounds left cannot reach the bar. Shards of vectors
meet blocks of queries, each giving its own k best, and the shards are merged by rank.

Scale: rows are dealt by a hash of vec_id to SHARD_ROWS-sized shards (at least MIN_SHARDS) and queries to blocks of
BLOCK_ROWS, so a task holds one shard and one block whatever the table's size; vectors travel as packed 16-bit integers
where they fit. Merging keeps k rows a query and shard, cut again before the exchange.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null
vec_id; a shorter vector counts as padded with zeros; rows that repeat a vec_id and its components are one vector; rows
that repeat a vec_id with other components are all candidates, and if it is a query all are queried and share its ranks, but
none is a candidate of its own id; components of any finite size are exact (weights that 64-bit sums cannot hold are summed as
big integers), and a score among the best that a long cannot hold raises an error that names it; a query with no other
vector has no rows; an empty table gives none; ties go to the smaller vec_id; other columns, whatever their names, are not
read, and a very long vector only makes its shard's rows longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.runtime import ship

K, SCALE, EVERY = 5, 256, 50
SHARD_ROWS, BLOCK_ROWS, MIN_SHARDS = 16384, 16384, 32
_OUT = "query_id long, vec_id long, score long"


def integer_vector(v: Column) -> Column:
    """floor(SCALE * x) of each component, a whole double; null where the vector takes no part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # a double of 2^53 or more is whole, and floor() to a long would cap it
    whole = lambda y: F.when(F.abs(y) < F.lit(float(2**53)), F.floor(y).cast("double")).otherwise(y)
    return F.when((F.size(v) > 0) & finite, F.transform(v, lambda x: whole(F.lit(float(SCALE)) * x.cast("double"))))


def _kind(most: int, width: int) -> type:
    """The type in which inner products of weights up to `most` are exact; products of doubles are much the fastest."""
    return np.float64 if most * most * width < 2**53 else np.int64 if most * most * width < 2**63 else object


class Shard:
    """Postings of one shard: for each term and sign the vectors in order of impact, and the largest weight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type):
        order = np.argsort(ids, kind="stable")
        vectors = _as(vectors[order], kind)
        self.ids, self.columns, self.rows = ids[order], np.ascontiguousarray(vectors.T), vectors
        self.high = self.columns.max(axis=1)
        self.low = self.columns.min(axis=1)
        ranked = np.argsort(self.columns, axis=1, kind="stable")
        first_positive = (self.columns <= 0).sum(axis=1)
        last_negative = (self.columns < 0).sum(axis=1)
        self.positive = [r[n:][::-1] for r, n in zip(ranked, first_positive, strict=True)]
        self.negative = [r[:n] for r, n in zip(ranked, last_negative, strict=True)]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (vec_id, score), ties to the smaller id."""
        bound = np.maximum(np.maximum(q * self.high, q * self.low), 0)
        terms = np.argsort(-bound, kind="stable")
        lists = [self.positive[t] if q[t] > 0 else self.negative[t] for t in terms.tolist()]
        mine = slice(int(np.searchsorted(self.ids, query_id)), int(np.searchsorted(self.ids, query_id, "right")))

        # the bar starts from vectors of the greatest impact in the lists of the greatest bounds
        seeds = np.unique(np.concatenate([x[: 4 * k] for x in lists[:8]] or [np.zeros(0, np.int64)]))
        seeds = seeds[(seeds < mine.start) | (seeds >= mine.stop)]
        top = np.sort(self.rows[seeds] @ q)[::-1]
        bar = top[k - 1] if len(top) >= k else None

        suffix = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bounds from a term on, in order of traversal
        hit = np.zeros(len(self.ids), bool)
        if bar is None or bar <= 0:  # zero and negative scores compete: every vector is a candidate
            hit[:] = True
        else:
            essential = int(np.argmax(suffix < bar))  # terms from here on cannot reach the bar together
            for at in range(0, essential, 4):
                for x in lists[at : min(at + 4, essential)]:
                    hit[x] = True
                if hit.all():
                    break
        hit[mine] = False
        seen, score, step = None, np.zeros(len(self.ids), self.rows.dtype), 8
        for at in range(0, len(terms), step):
            some = terms[at : at + step]
            score = score + q[some] @ (self.columns[some] if seen is None else self.columns[np.ix_(some, seen)])
            live = score + suffix[min(at + step, len(terms))] >= bar if bar is not None else np.ones(len(score), bool)
            if seen is None:
                seen = np.flatnonzero(hit & live)
                score = score[seen]
            else:
                seen, score = seen[live], score[live]
            if len(seen) <= 16 * k:  # few are left: probe all their other terms at once
                rest = terms[at + step :]
                score = score + self.rows[np.ix_(seen, rest)] @ q[rest]
                break
        if seen is None:
            seen, score = np.flatnonzero(hit), score[hit]
        if score.dtype == object:  # big integers have no lexsort
            best = np.array(sorted(range(len(seen)), key=lambda i: (-score[i], self.ids[seen[i]]))[:k], np.int64)
            for i in best.tolist():
                if not -(2**63) <= score[i] < 2**63:
                    raise OverflowError(f"the score {score[i]} of query {query_id} and vector {self.ids[seen[i]]} does not fit a long")
        else:
            score = score.astype(np.int64)
            best = np.lexsort((self.ids[seen], -score))[:k]
        return self.ids[seen][best], score[best].astype(np.int64)


def _as(weights: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles in the type asked for; as objects they are Python integers."""
    if kind is not object:
        return weights.astype(kind)
    out = np.empty(weights.shape, object)
    out[...] = [[int(x) for x in row] for row in weights.tolist()]
    return out


def _unpack(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r[1:], np.int16 if r[:1] == b"2" else np.float64)
        out[i, : len(v)] = v
    return out


def _distinct(rows: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    pairs = sorted(set(zip(rows["vec_id"].to_pylist(), rows["v"].to_pylist(), strict=True)))
    return np.array([i for i, _ in pairs], np.int64), [v for _, v in pairs]


def _search(k: int):
    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked, queries = _distinct(left)
        ids, shard = _distinct(right)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries and shard:
            size = lambda r: (len(r) - 1) // (2 if r[:1] == b"2" else 8)
            width = max(map(size, [*queries, *shard]))
            wanted, held = _unpack(queries, width), _unpack(shard, width)
            kind = _kind(int(max(np.abs(wanted).max(), np.abs(held).max())), width)
            index = Shard(ids, held, kind)
            for i, q in zip(asked.tolist(), _as(wanted, kind), strict=True):
                ids, scores = index.search(i, q, k)
                found.append((np.full(len(ids), i), ids, scores))
        cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.columns
        flat, n = np.asarray(vectors.flatten()), np.asarray(vectors.value_lengths())
        at = np.r_[0, np.cumsum(n)].tolist()
        small = [len(x) == 0 or (x.min() >= -32768 and x.max() <= 32767) for x in (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
        packed = [(b"2" + flat[a:b].astype(np.int16).tobytes()) if s else (b"8" + flat[a:b].astype(np.float64).tobytes()) for a, b, s in zip(at[:-1], at[1:], small, strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], names=["vec_id", "v"])


def top_k(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row where `queries` holds."""
    ship(spark)
    n = vectors.count()
    shards = max(MIN_SHARDS, -(-n // SHARD_ROWS))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(F.col(vector)).alias("v"), queries.alias("q"))
    rows = rows.where("vec_id is not null and v is not null")
    asked = rows.where("q").select("vec_id", "v").mapInArrow(_pack, "vec_id long, v binary")
    blocks = max(1, -(-rows.where("q").count() // BLOCK_ROWS))
    held = rows.select("vec_id", "v").mapInArrow(_pack, "vec_id long, v binary")
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("vec_id", "v", deal(blocks, 1).alias("block")).select("vec_id", "v", "block", every(shards).alias("shard"))
    held = held.select("vec_id", "v", deal(shards, 2).alias("shard")).select("vec_id", "v", every(blocks).alias("block"), "shard")
    keys = ("block", "shard")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_search(k), _OUT)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def oracle() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
