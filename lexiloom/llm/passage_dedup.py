"""Substring dedup below the line: lines and short paragraphs cut by content, hashed after normalisation, the earliest kept.

Units of a text, all over its words with A-Z lower-cased:

* each line of at least ``MIN_WORDS`` words;
* paragraphs, which tile the whole text whatever its lines and punctuation. A paragraph begins where the hash of two
  adjacent words is the least of some ``WINDOW`` such hashes in a row, so two texts that share a passage cut it at the same
  places wherever it stands. Its digest covers ``LEAST`` words at least, running on into the next one where it is shorter.

Units are ranked by (doc_id, hash of the text, position); all but the first of a digest (96 bits) are repeats. Repeated lines
go. Repeated paragraphs that touch are one run, and runs of ``MIN_RUN`` words or more go. Removed spans are kept as character
offsets of the original text. A line that loses all its words goes with its line break.

What is found: a stretch of 2 * WINDOW + MIN_RUN + 2 = 50 words or more that stands in two places. The first and the last window
of it lie inside it and choose the same boundaries in both, at most WINDOW words from its ends; so MIN_RUN words or more
lie between them, and at most WINDOW + 1 words stay at each end. Shorter runs down to MIN_RUN words go too where their
boundaries lie well. Stretches of one repeated word are cut every WINDOW words instead.

Scale: one pass of NumPy kernels makes thin rows (id, position, length, digest), about one for 6 words, that are written
once. Repeated digests come from a partial aggregate (a digest that stands in a third of all documents leaves each task as
one row) and are joined back in a plain join of two exchanges that adaptive execution splits where a digest is hot.
Texts move once, by id. Nothing is broadcast by hint and no group is collected but the spans of one document.

Defined cases: null and empty texts have no units and stay; null ids rank first; rows that repeat an id and text are one
document, so they lose the same spans; rows that repeat an id with other texts are documents of their own; a very long text
is hashed whole, in one task; a repeat inside one text goes too; other columns are untouched, whatever their names, and one
named as `details` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, Scratch, table
from lexiloom.llm.words import Hasher, mix, powers, slices, spans
from lexiloom.runtime import ship

MIN_WORDS = 4
WINDOW = 12
LEAST = 8
MIN_RUN = 24
_UNITS = "doc_id long, t long, a int, n int, line boolean, d long, e int"
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_PAIR = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC13FA9A902A6328F))
_word = re.compile(WORD)


def boundaries(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Word numbers at which paragraphs begin; first: the first word of each text and the number of words."""
    n = len(hashes)
    heads = first[:-1][first[:-1] < first[1:]]
    if n <= window:
        return heads
    pairs = np.empty(n, np.uint64)
    pairs[:-1] = mix(hashes[:-1] * _PAIR[0] + hashes[1:] * _PAIR[1])
    pairs[-1] = 0
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # a window of pairs beginning at s reads the words s ... s + window
    least = np.arange(n - window) + np.lib.stride_tricks.sliding_window_view(pairs, window)[: n - window].argmin(axis=1)
    chosen = np.zeros(n, bool)
    chosen[least[own[: n - window] == own[window:]]] = True
    # within a stretch of one pair every place is least: keep each window-th
    new = np.r_[True, (pairs[1:] != pairs[:-1]) | (own[1:] != own[:-1])]
    since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    chosen &= since % window == 0
    chosen[heads] = True
    return np.flatnonzero(chosen)


def _units(min_words: int):
    inverses = [pow(b, -1, 2**64) for b in _BASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, texts = batch.columns
            for low, _, data, offsets in slices(texts):
                starts, ends, first = spans(data, offsets)
                if not len(starts):
                    continue
                n = len(starts)
                hashes = Hasher(data, lower=True)(starts, ends)
                own = np.repeat(np.arange(len(first) - 1), np.diff(first))
                begin = boundaries(hashes, first)
                stop = np.maximum(np.append(begin[1:], n), begin + LEAST)
                stop = np.minimum(stop, first[own[begin] + 1])
                breaks = np.flatnonzero(data == 10)
                line = np.unique(np.r_[first[:-1], np.searchsorted(starts, breaks)])
                line = line[line < n]
                over = np.append(line[1:], n)
                whole = over - line >= min_words
                a, b = np.r_[begin, line[whole]], np.r_[stop, over[whole]]
                is_line = np.r_[np.zeros(len(begin), bool), np.ones(int(whole.sum()), bool)]
                digests = []
                for base, inverse in zip(_BASES, inverses, strict=True):
                    sums = np.zeros(n + 1, np.uint64)
                    np.cumsum(mix(hashes ^ np.uint64(base)) * powers(base, n), out=sums[1:])
                    digests.append(mix((sums[b] - sums[a]) * powers(inverse, n + 1)[a] + (2 * (b - a) + is_line).astype(np.uint64)))
                rows = pa.array(own[a] + low)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), ts.take(rows), pa.array((a - first[own[a]]).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(is_line),
                     pa.array(digests[0].view(np.int64)), pa.array((digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    names=[x.split()[0] for x in _UNITS.split(", ")],
                )

    return run


def repeated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Every repeated unit: doc_id, t (hash of the text), a (its first word), n (its words), line; runs are not yet judged."""
    ship(spark)
    scratch = scratch or Scratch(spark, "passages")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    units = scratch.save(rows.mapInArrow(_units(min_words), _UNITS), "units")
    place = F.struct("doc_id", "t", "a")
    twice = units.groupBy("d", "e").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "e", "f")
    twice = scratch.save(twice, "repeated")
    return units.join(twice, ["d", "e"]).where(~F.struct("doc_id", "t", "a").eqNullSafe(F.col("f"))).select("doc_id", "t", "a", "n", "line")


def cut(text: str, units: list[tuple[int, int, bool]], min_run: int = MIN_RUN) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without its repeated lines and runs, and what went: (first character, end, words) in the original."""
    words = [m.span() for m in _word.finditer(text)]
    gone = bytearray(len(words))
    runs: list[list[int]] = []
    for a, n, line in sorted(units):
        if line:
            gone[a : a + n] = b"\1" * n
        elif runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], a + n)
        else:
            runs.append([a, a + n])
    for a, b in runs:
        if b - a >= min_run:
            gone[a:b] = b"\1" * (b - a)
    out, went, w, at, open_ = [], [], 0, 0, None
    for line in text.split("\n"):
        stop, first, kept = at + len(line), w, []
        while w < len(words) and words[w][0] < stop:
            if not gone[w]:
                kept.append(w)
            if gone[w] and open_ is None:
                open_ = w
            elif open_ is not None and not gone[w]:
                went.append((words[open_][0], words[w - 1][1], w - open_))
                open_ = None
            w += 1
        if len(kept) == w - first:
            out.append(line)
        elif kept:
            parts = [text[at : words[first][0]]] if kept[0] == first else []
            for x, y in zip(kept, [*kept[1:], None], strict=True):
                parts.append(text[words[x][0] : words[x][1]])
                if y is not None:
                    parts.append(text[words[x][1] : words[y][0]] if y == x + 1 else " ")
                elif x == w - 1:
                    parts.append(text[words[x][1] : stop])
            out.append("".join(parts))
        at = stop + 1
    if open_ is not None:
        went.append((words[open_][0], words[-1][1], len(words) - open_))
    return "\n".join(out), went


def _cutter(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where = batch.schema.get_field_index("__text"), batch.schema.get_field_index("__spans")
            texts, units = batch.column(at), batch.column(where)
            went: list = [None] * batch.num_rows
            hit = np.flatnonzero(units.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                new = texts.to_pylist()
                for i in hit.tolist():
                    new[i], spans_ = cut(new[i], [(u["a"], u["n"], u["line"]) for u in units[i].as_py()], min_run)
                    went[i] = [{"start": s, "end": e, "n_words": n} for s, e, n in spans_] or None
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
            batch = batch.set_column(where, batch.schema.field(where), pa.nulls(batch.num_rows, units.type))
            kind = batch.schema.field("__gone").type
            yield batch.set_column(batch.schema.get_field_index("__gone"), batch.schema.field("__gone"), pa.array(went, kind))

    return run


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN, details: str | None = None) -> DataFrame:
    """docs with each text cut; details: name of a column for the removed spans (array of start, end, n_words; null: none)."""
    scratch = Scratch(spark, "passages")
    found = repeated(spark, docs, id_col, text, min_words, scratch)
    found = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "n", "line")).alias("__spans"))
    found = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__i"), F.col("t").alias("__t"), "__spans")
    rows = docs.select(
        *[F.col(f"`{c}`").alias("__text" if c == text else f"c{i}") for i, c in enumerate(docs.columns)],
        F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null")).alias("__i"), F.xxhash64(F.col(f"`{text}`")).alias("__t"),
    ).join(found, ["__i", "__t"], "left").drop("__i", "__t")
    rows = rows.withColumn("__gone", F.lit(None).cast("array<struct<start:bigint,end:bigint,n_words:bigint>>"))
    rows = rows.mapInArrow(_cutter(min_run), rows.schema)
    names = [F.col("__text" if c == text else f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != details]
    return rows.select(*names, *([F.col("__gone").alias(details)] if details else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text after the cut, its length, and what went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(spark, docs, details="gone").select(
        "doc_id",
        "text",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]), F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: F.concat_ws("-", x["start"], x["end"])), " "), F.lit("")).alias("removed_spans"),
    )
