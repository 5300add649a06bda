"""Substring dedup: lines hashed after normalisation, digests grouped globally, the earliest occurrence kept.

A unit is a line of at least ``MIN_WORDS`` words; it is normalised to its words with A-Z lower-cased, so white space does
not matter. Units are ranked by (doc_id, position); all but the first of a digest (128 bits) are removed and the rest of
the text is joined as it was, with the removed character spans of the original text retained.

Scale: one pass of NumPy kernels makes thin rows (id, position, span, digest) that are written once. Repeated digests
are found by a partial aggregate (a digest on a third of all lines leaves each task as one row), and only they are joined
back, in a plain join of two exchanges that adaptive execution splits where a digest is hot. Texts move once, by id.

Defined cases: null and empty texts have no units and stay; null ids rank first; rows that repeat an id and text are one
document, so they lose the same spans; shorter lines are never removed; a very long text is hashed whole, in one task; an empty
table gives an empty table; other columns are untouched, whatever their names, and one named as `details` is replaced. Passages inside
a line are not seen: `passage_dedup` finds those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, table
from lexiloom.llm.words import Hasher, mix, powers, slices, spans
from lexiloom.runtime import ship

MIN_WORDS = 4
_UNITS = "doc_id long, t long, unit int, start long, end long, n_words int, d1 long, d2 long"
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _units(min_words: int):
    inverses = [pow(b, -1, 2**64) for b in _BASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, texts = batch.columns
            for a, b, data, offsets in slices(texts):
                starts, ends, _ = spans(data, offsets)
                breaks = np.flatnonzero(data == 10)
                line = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
                line = line[line < len(data)]
                stop = np.append(line[1:], len(data))
                own = np.searchsorted(offsets, line, "right") - 1
                stop = np.where((stop > line) & (data[stop - 1] == 10), stop - 1, stop) if len(line) else stop
                first = np.searchsorted(starts, line)
                last = np.append(first[1:], len(starts))
                keep = last - first >= min_words
                unit = np.arange(len(line)) - np.searchsorted(line, offsets[:-1])[own]
                hashes = Hasher(data, lower=True)(starts, ends)
                digests = []
                for base, inverse in zip(_BASES, inverses, strict=True):
                    sums = np.zeros(len(starts) + 1, np.uint64)
                    np.cumsum(mix(hashes ^ np.uint64(base)) * powers(base, len(starts)), out=sums[1:])
                    digests.append(mix((sums[last] - sums[first]) * powers(inverse, len(starts) + 1)[first] + (last - first).astype(np.uint64))[keep])
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                own, line, stop = own[keep], line[keep], stop[keep]
                base = chars[offsets[:-1]][own]
                rows = pa.array(own + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), ts.take(rows), pa.array(unit[keep].astype(np.int32)), pa.array(chars[line] - base), pa.array(chars[stop] - base),
                     pa.array((last - first)[keep].astype(np.int32)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64))],
                    names=[x.split()[0] for x in _UNITS.split(", ")],
                )

    return run


def repeated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Every removed span: doc_id, t (hash of the text), unit, start, end, n_words, first_doc, first_unit (the occurrence kept)."""
    ship(spark)
    scratch = scratch or Scratch(spark, "lines")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    units = scratch.save(rows.mapInArrow(_units(min_words), _UNITS), "units")
    place = F.struct("doc_id", "unit", "t")
    twice = units.groupBy("d1", "d2").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l")
    twice = scratch.save(twice.select("d1", "d2", F.col("f.doc_id").alias("first_doc"), F.col("f.unit").alias("first_unit"), F.col("f.t").alias("first_t")), "repeated")
    held = units.join(twice, ["d1", "d2"])
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("unit") == F.col("first_unit")) & (F.col("t") == F.col("first_t"))
    return held.where(~kept).drop("d1", "d2", "first_t")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        where = batch.schema.get_field_index("__spans")
        texts, gone = batch.column(at).to_pylist(), batch.column(where).to_pylist()
        for i, cuts in enumerate(gone):
            if cuts:
                lost = {(c["start"], c["end"]) for c in cuts}
                pos, kept = 0, []
                for x in texts[i].split("\n"):
                    if (pos, pos + len(x)) not in lost:
                        kept.append(x)
                    pos += len(x) + 1
                texts[i] = "\n".join(kept)
        yield batch.set_column(at, "__text", pa.array(texts, batch.column(at).type))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, details: str | None = None) -> DataFrame:
    """docs with each text cut; details: name of a column for the removed spans (array of start, end, n_words; null: none)."""
    scratch = Scratch(spark, "lines")
    gone = repeated(spark, docs, id_col, text, min_words, scratch)
    gone = gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "end", "n_words"))).alias("__spans"))
    gone = gone.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__i"), F.col("t").alias("__t"), "__spans")
    rows = docs.select(
        *[F.col(f"`{c}`").alias("__text" if c == text else f"c{i}") for i, c in enumerate(docs.columns)],
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__i"), F.xxhash64(F.col(text)).alias("__t"),
    ).join(gone, ["__i", "__t"], "left").drop("__i", "__t")
    rows = rows.mapInArrow(_cut, rows.schema)
    names = [F.col("__text" if c == text else f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != details]
    return rows.select(*names, *([F.col("__spans").alias(details)] if details else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return dedup(spark, docs, details="spans").select(
        "doc_id",
        "n_chars",
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]), F.lit(0)).alias("removed_words"),
        F.array_join(F.transform(F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,n_words:int>>)")), lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("removed_spans"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS unit FROM d WHERE text IS NOT NULL),
o AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit))::BIGINT - length(line) - 1 AS start,
             regexp_extract_all(translate(line, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM u),
r AS (SELECT *, len(ws) >= {MIN_WORDS} AND row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, unit) > 1 AS gone FROM o),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(sum(len(ws)) FILTER (gone), 0)::BIGINT AS removed_words,
             coalesce(string_agg(start || '-' || (start + length(line)), ' ' ORDER BY start) FILTER (gone), '') AS removed_spans,
             coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_words, 0)::BIGINT AS removed_words,
       coalesce(removed_spans, '') AS removed_spans, coalesce(length(kept), 0)::BIGINT AS kept_chars, md5(kept) AS kept_md5
FROM d LEFT JOIN g USING (doc_id)"""
