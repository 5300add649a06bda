"""Units of observation: one row a segment, sentence or document, pointing back into the unaltered body."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.runtime import handed_on, rows_of, ship

CUT = r"[.!?]+\s+"
# Section headers that begin an appendix, signs in titles and in texts of pages that are no articles.
APPENDIX = ("See also", "References", "External links", "Further reading", "Notes", "Bibliography", "Véase también", "Referencias", "Enlaces externos", "Notas", "Bibliografía")
JUNK_TITLE = ("disambiguation", "list of", "desambiguación", "anexo:", "lista de", "véase también")
JUNK_TEXT = ("may refer to", "may also refer to", "puede referirse a", "hace referencia a varios")
JUNK_HEAD = 400


def corpus(documents: DataFrame) -> DataFrame:
    """documents as (doc_id, body, source, language, meta)."""
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("language"), F.col("lang"))
    return documents.select("doc_id", F.col("text").alias("body"), "source", F.col("lang").alias("language"), meta.alias("meta"))


def _taken_apart(docs: DataFrame, of: Callable[[tuple], Iterator[tuple]], **kinds: str) -> DataFrame:
    """(doc_id, *kinds): what `of` gives of each row of docs, whose first column is doc_id. Bounded in memory, see `handed_on`."""
    ship(docs.sparkSession)
    arrow = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.types[0]), *((k, arrow[v]) for k, v in kinds.items())])
            yield from handed_on((x for row in rows_of([batch]) for x in of(row)), schema)

    return docs.mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{k} {v}" for k, v in kinds.items())]))


def validate(docs: DataFrame) -> DataFrame:
    """Defects: rows without a body or id, and ids that repeat."""
    bad = docs.where(F.col("body").isNull() | F.col("doc_id").isNull()).select("doc_id", F.lit("missing").alias("defect"))
    return bad.union(docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("repeated").alias("defect")))


def segments(docs: DataFrame, word: str, mode: str = "exact") -> DataFrame:
    """Every match of a word: doc_id, occ (0-based), start, end, text, body, source. No shuffle; texts without it go unread."""
    rule = re.compile(T.python_pattern(word, mode), re.IGNORECASE)
    rows = T.with_spans(with_word(docs, word, mode).select("doc_id", "source", "body"), "body", T.found(rule), "found")
    rows = rows.select("doc_id", "source", "body", F.posexplode("found").alias("occ", "m"))
    return rows.select("doc_id", "occ", "m.start", "m.end", "m.text", "body", "source")


def remapped(docs: DataFrame, word: str, mode: str = "exact") -> DataFrame:
    """Where each match of a word starts once white space is collapsed: doc_id, occ, start. One pass over a body, whatever its matches."""
    rule = re.compile(T.python_pattern(word, mode), re.IGNORECASE)

    def of(row: tuple) -> Iterator[tuple]:
        at = T.collapsed(row[1])
        return ((row[0], k, at(m.start())) for k, m in enumerate(rule.finditer(row[1])))

    return _taken_apart(with_word(docs, word, mode).select("doc_id", "body"), of, occ="int", start="int")


def _stripped(body: str) -> Iterator[tuple[int, int, str]]:
    """Pieces that end after each cut, stripped, with offsets; blank ones go."""
    at = 0
    for end in [*(m.end() for m in re.finditer(CUT, body)), len(body)]:
        piece = body[at:end]
        bare = piece.strip()
        if bare:
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(bare), bare
        at = end


def sentences(docs: DataFrame) -> DataFrame:
    """One row a sentence: doc_id, occ, start, end, text, source. One pass over each body, in Arrow batches."""

    def of(row: tuple) -> Iterator[tuple]:
        doc, body, source = row
        return ((doc, k, *p, source) for k, p in enumerate(_stripped(body or "")))

    return _taken_apart(docs.select("doc_id", "body", "source"), of, occ="int", start="int", end="int", text="string", source="string")


def whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(0).alias("start"), F.length("body").alias("end"), F.col("body").alias("text"), "source")


def with_word(docs: DataFrame, word: str, mode: str = "exact") -> DataFrame:
    return docs.where(F.col("body").rlike(T.pattern(word, mode)))


def clean_body(body: Column) -> Column:
    """The body up to the first appendix header on a line of its own, without white space before it."""
    cut = F.regexp_replace(body, r"(?isu)\n\s*(?:" + "|".join(APPENDIX) + r")\s*\n.*$", "")
    return F.when(cut != body, F.regexp_replace(cut, f"{T.WHITE}+$", "")).otherwise(body)


def is_junk(title: Column, body: Column) -> Column:
    """A disambiguation or list page, by any part of its title or the head of its text."""
    return title.rlike("(?iu)" + "|".join(JUNK_TITLE)) | F.substring(body, 1, JUNK_HEAD).rlike("(?iu)" + "|".join(JUNK_TEXT))


def hits(body: Column, terms: list[str]) -> Column:
    folded = T.casefold(body)
    return sum((F.regexp_count(folded, F.lit(T.pattern(t))) for t in terms[1:]), F.regexp_count(folded, F.lit(T.pattern(terms[0]))))


def _contexts(word: str, most: int | None) -> Callable[[str], Iterator[tuple[str, int, list[str]]]]:
    """(key, position, words) of each occurrence in the valid sentences of a body."""
    cut, rule, low = re.compile(r"(?<=[.!?])\s+(?=[A-Z])"), re.compile(rf"\b{re.escape(word.lower())}\b"), word.lower()
    other = re.compile(r"[^\w]")

    def contexts(body: str) -> Iterator[tuple[str, int, list[str]]]:
        ctx = 0
        for sentence in cut.split(body):
            if ctx == most:
                return
            if rule.search(sentence.lower()) and len(words := sentence.split()) >= 5:
                for occ, k in enumerate(k for k, w in enumerate(words) if other.sub("", w.lower()) == low):
                    yield f"ctx_{ctx:03d}_occ_{occ:02d}", k, words
                ctx += 1

    return contexts


def _holding(docs: DataFrame, word: str) -> DataFrame:
    return docs.select("doc_id", "body").where(F.lower("body").contains(word.lower()))


def word_contexts(docs: DataFrame, word: str, most: int | None = None) -> DataFrame:
    """Sentences with a word as library contours take them: split before a capital, at least five words, target marked.

    Only valid sentences are numbered, and `most` limits those. One row an occurrence: doc_id, key, position, marked.
    """
    contexts = _contexts(word, most)

    def of(row: tuple) -> Iterator[tuple]:
        for key, k, words in contexts(row[1]):
            yield row[0], key, k, " ".join([*words[:k], f"[TARGET]{words[k]}[/TARGET]", *words[k + 1 :]])

    return _taken_apart(_holding(docs, word), of, key="string", position="int", marked="string")


def context_windows(docs: DataFrame, word: str, most: int) -> DataFrame:
    """The words of `word_contexts` in a window of at most `most` of them around the marked one, position being that of the
    window: doc_id, key, position, words. No sentence is copied to its occurrences."""
    contexts = _contexts(word, None)

    def of(row: tuple) -> Iterator[tuple]:
        for key, k, words in contexts(row[1]):
            a = max(0, k - (most - 1) // 2)  # as tokens.centre: what one edge lacks goes to the other
            b = min(a + most, len(words))
            a = max(0, min(a, b - most))
            yield row[0], key, k - a, "\n".join([*words[a:k], f"[TARGET]{words[k]}[/TARGET]", *words[k + 1 : b]])

    rows = _taken_apart(_holding(docs, word), of, key="string", position="int", words="string")
    return rows.withColumn("words", F.split("words", "\n"))


# KWIC windows: where the context of each occurrence begins and ends, from positions taken once a body

def _chars(body: str, size: int) -> Callable[[int, int], tuple[int, int]]:
    return lambda start, end: (max(0, start - size), min(len(body), end + size))


def _words(body: str, size: int) -> Callable[[int, int], tuple[int, int]]:
    """Tokens are counted from the one that holds the start; a start on white space has no context."""
    spans = [m.span() for m in re.finditer(r"\S+", body)]
    first = [a for a, _ in spans]

    def at(start: int, end: int) -> tuple[int, int]:
        k = bisect_right(first, start) - 1
        if k < 0 or start >= spans[k][1]:
            return start, end
        return spans[max(0, k - size)][0], spans[min(len(spans) - 1, k + size)][1]

    return at


def _sentence(body: str, size: int) -> Callable[[int, int], tuple[int, int]]:
    starts, stops = [0, *(m.end() for m in re.finditer(CUT, body))], [*(m.end() for m in re.finditer(r"[.!?]+", body)), len(body)]
    return lambda start, end: (starts[bisect_right(starts, start) - 1], stops[min(bisect_left(stops, end), len(stops) - 1)])


def _paragraph(body: str, size: int) -> Callable[[int, int], tuple[int, int]]:
    gaps = [m.span() for m in re.finditer(r"\n\s*\n", body)]
    starts, stops = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(body)]
    return lambda start, end: (starts[bisect_right(starts, start) - 1], stops[min(bisect_left(stops, end), len(stops) - 1)])


_WINDOWS = {"chars": _chars, "words": _words, "sentence": _sentence, "paragraph": _paragraph}
_LINE = ["doc_id", "occ", "start", "end", "left", "text", "right", "w_start", "w_end", "source"]


def _lines(docs: DataFrame, found: Callable[[tuple], list[tuple[int, int, int, str]]], mode: str, size: int) -> DataFrame:
    """One row an occurrence of the rows (doc_id, body, source, ...); found gives (occ, start, end, text) of a row."""
    if mode not in _WINDOWS:
        raise ValueError("mode must be chars, words, sentence or paragraph")

    def of(row: tuple) -> Iterator[tuple]:
        doc, body, source = row[:3]
        window = None
        for occ, start, end, text in found(row) if body else []:
            window = window or _WINDOWS[mode](body, size)
            a, b = window(start, end)
            yield doc, occ, start, end, body[a:start], text, body[end:b], a, b, source

    kinds = dict.fromkeys(_LINE[1:], "int") | dict.fromkeys(("left", "text", "right", "source"), "string")
    return _taken_apart(docs, of, **kinds)


def concordance(docs: DataFrame, word: str, match: str = "exact", mode: str = "chars", size: int = 50) -> DataFrame:
    """All occurrences of a word with their context. Each body is read once, whatever the number of occurrences."""
    rule = re.compile(T.python_pattern(word, match), re.IGNORECASE)
    rows = with_word(docs, word, match).select("doc_id", "body", "source")
    return _lines(rows, lambda row: [(k, *m.span(), m.group()) for k, m in enumerate(rule.finditer(row[1]))], mode, size)


def kwic(seg: DataFrame, mode: str = "chars", size: int = 50, docs: DataFrame | None = None) -> DataFrame:
    """Segments with their context; docs: the bodies by doc_id, for segments that carry none (a sample, say).

    The segments of a document meet its body once, so no body is copied to an occurrence.
    """
    item = F.struct(*[F.col(c) for c in ("occ", "start", "end", "text")])
    held = seg.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("found"), *([] if docs is not None else [F.max("body").alias("body")]), F.max("source").alias("source"))
    held = held.join(docs.select("doc_id", "body"), "doc_id") if docs is not None else held
    return _lines(held.select("doc_id", "body", "source", "found"), lambda row: [(x["occ"], x["start"], x["end"], x["text"]) for x in row[3]], mode, size)
