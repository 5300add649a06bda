"""TF-IDF and latent semantic analysis over long (doc, term, weight) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words of the documents of a chunk.
CHUNK = 1 << 20


def _chunks(words: Iterator[tuple[pa.Array, pa.Array]], most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (doc_id, words), rows of a doc_id together -> chunks of whole documents of about `most` words:
    doc_ids, the distinct terms, and document, term and count of each pair of them that occurs."""
    names: dict[str, int] = {}
    docs, parts, held, last = [], [], 0, None

    def closed(whole: bool):
        """The chunk as far as its documents are whole, and what is left of the last one for the next."""
        nonlocal names, docs, parts, held
        d, t = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        terms, ids = pa.array(list(names), pa.string()), docs
        end = len(ids) if whole else len(ids) - 1
        rest = t[d >= end]
        names, docs, parts, held = {}, ids[end:], [], len(rest)
        if len(rest):
            own, t_rest = np.unique(rest, return_inverse=True)
            names = {x: k for k, x in enumerate(terms.take(pa.array(own)).to_pylist())}
            parts = [(np.zeros(len(rest), np.int64), t_rest.astype(np.int64))]
        keys, counts = np.unique(d[d < end] * max(1, len(terms)) + t[d < end], return_counts=True)
        d, t = np.divmod(keys, max(1, len(terms)))
        used, t = np.unique(t, return_inverse=True)
        return pa.array(ids[:end], kind), terms.take(pa.array(used)), d, t, counts

    kind = None
    for ids, lists in words:
        kind = ids.type
        for low in range(0, len(ids), 512):
            some, part = ids.slice(low, 512).to_pylist(), lists.slice(low, 512)
            at = np.empty(len(some), np.int64)
            for k, x in enumerate(some):
                if not docs or x != last:
                    docs.append(x)
                    last = x
                at[k] = len(docs) - 1
            coded = part.flatten().dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            parts.append((np.repeat(at, np.asarray(part.value_lengths().fill_null(0))), code[np.asarray(coded.indices)] if len(code) else np.zeros(0, np.int64)))
            held += len(parts[-1][1])
            if held >= most and len(docs) > 1:
                yield closed(False)
    if docs:
        yield closed(True)


def tfidf(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_df: int = 1, use_idf: bool = True) -> DataFrame:
    """(doc_id, term, w): words of two characters or more, idf = ln((1 + n) / (1 + df)) + 1, rows of length 1.

    Documents are counted in chunks that are written once; only the distinct terms of a chunk are shuffled, to the term and
    back with its idf, and never a row a document and term.
    """
    from lexiloom.runtime import Steps, ship

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")
    rows = rows.select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (ids, terms, d, t, tf) in enumerate(_chunks(((b.column(0), b.column(1)) for b in batches), CHUNK)):
            one = lambda x, of=None: pa.array([x], pa.list_(of or pa.int32()))
            none = lambda n, like: pa.nulls(n, like)
            lists = [pa.list_(ids.type), *[pa.list_(pa.int32())] * 3]
            head = [pa.array([task + k]), *(none(1, x) for x in (pa.string(), pa.int32(), pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(d.astype(np.int32)), one(t.astype(np.int32)), one(tf.astype(np.int32))]
            names = ["chunk", "term", "at", "df", "docs", "d", "t", "tf"]
            yield pa.RecordBatch.from_arrays(head, names=names)
            df = np.bincount(t, minlength=len(terms))
            for low in range(0, len(terms), 1 << 16):
                part = terms.slice(low, 1 << 16)
                n = len(part)
                own = [pa.array(np.full(n, task + k)), part, pa.array(np.arange(low, low + n, dtype=np.int32)), pa.array(df[low : low + n].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *(none(n, x) for x in lists)], names=names)

    packed = Steps(docs.sparkSession, "tfidf").settle(rows.mapInArrow(count, f"chunk long, term string, at int, df long, docs array<{kind}>, d array<int>, t array<int>, tf array<int>"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    terms = packed.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("chunk", "at")).alias("places")).where(F.col("df") >= min_df)
    terms = terms.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)).alias("idf"), F.explode("places").alias("p"))
    # one row a chunk, as wide as the chunk: rows with lists that are mostly null go to Python far more slowly
    told = terms.groupBy(F.col("p.chunk").alias("chunk")).agg(F.collect_list(F.struct(F.col("p.at").alias("at"), "idf", "term")).alias("told"))
    heads = packed.where("term is null").select("chunk", "docs", "d", "t", "tf")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, d, t, tf, pieces = (b.column(c)[row].values for c in ("docs", "d", "t", "tf", "told"))
                (at, idf), names = (np.asarray(pieces.field(c)) for c in ("at", "idf")), pieces.field("term")
                d, t, tf = (np.asarray(x) for x in (d, t, tf))
                where = np.full(max(t.max(initial=-1), at.max(initial=-1)) + 1, -1)
                where[at] = np.arange(len(at))
                some = where[t] >= 0
                d, t, tf = d[some], where[t[some]], tf[some]
                w = tf * idf[t]
                w /= np.sqrt(np.bincount(d, w * w, len(ids)))[d]
                for low in range(0, len(w), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d[part])), names.take(pa.array(t[part])), pa.array(w[part])], names=["doc_id", "term", "w"])

    return heads.join(told.hint("merge"), "chunk").mapInArrow(weigh, f"doc_id {kind}, term string, w double")


def documents_from_units(units: DataFrame) -> DataFrame:
    """(doc_id, left, text, right, start) -> one text a document, pieces in order."""
    piece = F.trim(F.concat_ws(" ", "left", "text", "right"))
    return units.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("p")))), lambda x: x["p"]), " ").alias("text"))


def lsa(weights: DataFrame, k: int = 100, oversample: int = 20, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Randomised SVD of terms x documents: (term, vector), (doc_id, vector), singular values.

    Each half round multiplies the long matrix by a table of short vectors with one join and one aggregate; only
    (k + oversample)^2 Gram matrices reach the driver. Tables of vectors are written between the steps and go two rounds later.
    """
    from lexiloom.runtime import Steps

    m = k + oversample
    steps = Steps(weights.sparkSession, "lsa")
    weights = Steps(weights.sparkSession, "lsa-weights").settle(weights.select("doc_id", "term", "w"))  # every product reads them
    seeded = lambda c: F.array(*[F.xxhash64(F.lit(seed + i), c).cast("double") / 2.0**63 for i in range(m)])

    def gram(df: DataFrame) -> np.ndarray:
        from lexiloom.plans.linalg import gram as g

        return g(df, "vector")[2]

    def orthonormal(df: DataFrame, key: str) -> DataFrame:
        values, axes = np.linalg.eigh(gram(df))
        keep = values > values.max() * 1e-12
        turn = axes[:, keep] / np.sqrt(values[keep])
        return turned(df, key, turn)

    def turned(df: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
        def run(batches):
            for pdf in batches:
                x = np.array(pdf["vector"].tolist()).reshape(len(pdf), -1)
                yield pd.DataFrame({key: pdf[key], "vector": (x @ turn).tolist() if len(pdf) else []})

        return df.select(key, "vector").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>")

    def times(vectors: DataFrame, on: str, to: str, width: int) -> DataFrame:
        joined = weights.join(vectors, on)
        return steps.settle(joined.groupBy(to).agg(F.array(*[F.sum(F.col("w") * F.get(F.col("vector"), i)) for i in range(width)]).alias("vector")))

    terms = weights.select("term").distinct()
    q = steps.settle(terms.select("term", seeded(F.col("term")).alias("vector")))
    for _ in range(rounds):
        steps.drop(steps.n - 3)
        q = steps.settle(orthonormal(q, "term"))
        b = times(q, "term", "doc_id", len(q.first()["vector"]))
        q = times(b, "doc_id", "term", len(b.first()["vector"]))
    q = steps.settle(orthonormal(q, "term"))
    b = times(q, "term", "doc_id", len(q.first()["vector"]))  # documents x m = A^T Q
    values, axes = np.linalg.eigh(gram(b))
    order = np.argsort(-values)[:k]
    s = np.sqrt(np.maximum(values[order], 0))
    inverse = np.divide(1.0, s, out=np.zeros_like(s), where=s > 1e-12)
    return turned(q, "term", axes[:, order]), turned(b, "doc_id", axes[:, order] * inverse), s
