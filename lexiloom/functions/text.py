"""Text expressions: search patterns, match offsets in code points, preparation steps and labels."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.runtime import SLICE, ship

MODES = ("exact", "variants", "loose")
_SPECIAL = re.compile(r"([^\w\s]|_)", re.UNICODE)
#: White space as Python understands it, spelt out since Java's \s differs.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"

_LONG_WHITE = re.compile(WHITE + "{2,}")


def pattern(word: str, mode: str = "exact") -> str:
    """A regular expression, ignoring case, for a word as such, with a short suffix, or anywhere."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = _SPECIAL.sub(r"\\\1", word).replace("\\_", "_")
    body = {"exact": rf"\b{w}\b", "variants": rf"\b{w}[a-záéíóúñ]{{0,3}}\b", "loose": w}[mode]
    return f"(?iuU){body}"


def python_pattern(word: str, mode: str = "exact") -> str:
    """The same for Python's regular expressions, which need IGNORECASE."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = re.escape(word)
    return {"exact": rf"\b{w}\b", "variants": rf"\b{w}[a-záéíóúñ]{{0,3}}\b", "loose": w}[mode]


def matches(body: Column, regex: str) -> Column:
    """array<struct<start, end, text>> of all matches, 0-based half-open code-point offsets.

    Offsets are running lengths of the pieces between matches and of the matches, since the engine's own regex positions
    count UTF-16 units.
    """
    found = F.regexp_extract_all(body, F.lit(regex), F.lit(0))
    gaps = F.split(body, regex, -1)
    step = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    folded = F.aggregate(
        F.filter(step, lambda s: s["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["g"] + F.length(s["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + s["g"]).alias("start"), (acc["at"] + s["g"] + F.length(s["m"])).alias("end"), s["m"].alias("text"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, folded).otherwise(none)


Spans = list[tuple[int, int, str]]


def found(rule: re.Pattern) -> Callable[[list[str]], list[Spans]]:
    """(start, end, text) of all matches of each text."""
    return lambda texts: [[(*m.span(), m.group()) for m in rule.finditer(x)] for x in texts]


def with_spans(rows: DataFrame, text: str, find: Callable[[list[str]], list[Spans]], into: str) -> DataFrame:
    """rows and a column (array<struct<start, end, text>>; null text: null) of what `find` gives for a batch of texts.

    One pass in Arrow batches, linear in a text; other columns of any name are kept.
    """
    ship(rows.sparkSession)
    inner = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    at = rows.columns.index(text)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(at)
                spans = find(texts.fill_null("").to_pylist())
                flat = [s for some in spans for s in some]
                start, end, words = (pa.array([s[k] for s in flat], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string())))
                ends = np.r_[0, np.cumsum([len(some) for some in spans])].astype(np.int32)
                mask = np.append(np.asarray(texts.is_null()), False)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=mask if mask.any() else None), pa.StructArray.from_arrays([start, end, words], ["start", "end", "text"]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "__spans"])

    return inner.mapInArrow(run, f"{kinds}, __spans array<struct<start:int,end:int,text:string>>").toDF(*rows.columns, into)


def collapse_whitespace(x: Column) -> Column:
    """Each run of white space as one space; the ends stay."""
    return F.regexp_replace(x, WHITE + "+", " ")


def collapse_offset(body: Column, at: Column) -> Column:
    """Where an offset lies after collapse_whitespace."""
    return F.length(collapse_whitespace(F.substring(body, F.lit(1), at)))


def collapsed(body: str) -> Callable[[int], int]:
    """collapse_offset for any number of offsets of one body, from its runs of white space taken once."""
    runs = [m.span() for m in _LONG_WHITE.finditer(body)]
    first, gone = [a for a, _ in runs], [0]
    for a, b in runs:
        gone.append(gone[-1] + b - a - 1)

    def at(x: int) -> int:
        k = bisect_left(first, x)
        return x if k == 0 else x - gone[k - 1] - (min(runs[k - 1][1], x) - runs[k - 1][0] - 1)

    return at


def _series(f: Callable[[str], str], plain: Callable[[str], str] | None = None):
    """f of texts that are not of ASCII characters alone (those stay, or are given to `plain`), a slice of a batch at a time."""
    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for low in range(0, max(1, len(batch)), SLICE):
                part = batch.slice(low, SLICE)
                if plain is None and pc.all(pc.string_is_ascii(part), min_count=0).as_py():
                    yield part
                else:
                    yield pa.array([None if x is None else f(x) if not x.isascii() else plain(x) if plain else x for x in part.to_pylist()], pa.string())

    return run


def nfc(x: Column, mode: str = "full") -> Column:
    """Unicode NFC; mode 'reference' composes each character by itself."""
    one = lambda s: unicodedata.normalize("NFC", s)
    return _series(one if mode == "full" else lambda s: s if one(s) == s else "".join(map(one, s)))(x)


class _Bare(dict):
    """What each character leaves without its marks, found once a character; a mark by itself stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn") or c
        return out


_BARE = _Bare()


def _bare(s: str) -> str:
    return s.translate(_BARE)


def strip_accents(x: Column) -> Column:
    return _series(_bare)(x)


def casefold(x: Column) -> Column:
    """Unicode case folding; texts of ASCII characters alone are lower-cased without Python."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), F.lower(x)).otherwise(_series(str.casefold)(F.when(~x.rlike(r"^\p{ASCII}*$"), x)))


#: name -> (expression, whether offsets survive it).
STEPS: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "unicode_nfc": (nfc, True),
    "collapse_whitespace": (collapse_whitespace, True),
    "lowercase": (F.lower, False),
    "strip_accents": (strip_accents, False),
}
SAFE_DEFAULTS = ("unicode_nfc", "collapse_whitespace")


def prepare(x: Column, steps=SAFE_DEFAULTS) -> Column:
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    return reduce(lambda c, s: STEPS[s][0](c), steps, x)


def prepare_offset(body: Column, at: Column, steps=SAFE_DEFAULTS) -> Column:
    """An offset into the prepared text: the length of the prepared prefix."""
    return F.length(prepare(F.substring(body, F.lit(1), at), steps))


def slugify(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"(?U)[^\w\s-]", ""), r"(?U)[\s-]+", "_")
    return F.when(s == "", "term").otherwise(s)


def clean_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)[^\w]", "")


def mark(words: Column, at: Column, left: str = "[TARGET]", right: str = "[/TARGET]") -> Column:
    """The words in one string, the one at a position marked."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(F.lit(left), w, F.lit(right))).otherwise(w)), " ")


def kwic_line(left: Column, text: Column, right: Column, most: int = 100) -> Column:
    return F.substring(F.translate(F.concat(left, F.lit("["), text, F.lit("]"), right), "\n", " "), 1, most)


def kwic_row(doc_id: Column, left: Column, text: Column, right: Column, width: int = 40) -> Column:
    """A line of a printed concordance: the id's first 12 characters, the left side set to the right, the right side cut."""
    one = lambda x: F.translate(x, "\n", " ")
    side = F.lpad(F.when(F.length(left) > width, F.substring(left, -width, width)).otherwise(left), width, " ")
    return F.concat(F.rpad(F.substring(doc_id.cast("string"), 1, 12), 12, " "), F.lit(" | "), one(side), F.lit(" ["), one(text), F.lit("] "), one(F.substring(right, 1, width)))


def model_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("^(distilbert|bert-|roberta-|albert-)"), "bert").when(n.rlike("gpt-?2|^gpt"), "gpt2").otherwise("bert")


def short_list(x: Column, most: int = 5) -> Column:
    return F.concat(F.array_join(F.slice(x, 1, most), ", "), F.when(F.size(x) > most, "...").otherwise(""))


def html_unescape(x: Column) -> Column:
    """The named entities of XML, and numeric ones by the standard library."""
    import html

    return _series(html.unescape, html.unescape)(x)


def highlight(words: Column, at: Column, most: int = 15) -> Column:
    """The first words in one string, the one at a position between **."""
    return F.concat(F.array_join(F.slice(F.transform(words, lambda w, i: F.when(i == at, F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w)), 1, most), " "), F.lit("..."))


def decode_separator(x: str) -> str:
    """A separator as typed: escapes are decoded, and none, empty or ninguno is no separator."""
    return "" if str(x).strip().lower() in ("none", "empty", "ninguno") else bytes(str(x), "utf-8").decode("unicode_escape")


def metadata_key(x: str) -> str | None:
    """A metadata key as typed; skip, none, no, - or nothing is no key."""
    value = str(x).strip()
    return None if value.lower() in ("", "skip", "none", "no", "-") else value


def entry_path(name: str, root: str = "corpora") -> str:
    """The path of a named corpus below the root; a name that leads out of it is an error."""
    import posixpath

    top = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(top, str(name).strip().strip("/\\")))
    if path != top and not path.startswith(top + "/"):
        raise ValueError(f"the corpus must be inside {root!r}")
    return path
