"""Cases of the behaviour that the corpus operators have to match, brute force for windows, null groups and spaced caps."""

import hashlib
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import sampling as P
from lexiloom.operators import units as U


@pytest.mark.parametrize(
    "title, text, junk",
    [
        ("Mercury (disambiguation)", "", True), ("LIST OF kings", "", True), ("Kings, a list of", "", True), ("Anexo:Reyes", "", True), ("Desambiguación de x", "", True),
        ("Lista de reyes", "", True), ("Véase también", "", True), ("Mercury", "Mercury may also refer to a planet", True), ("Mercury", "Mercury May Refer To:", True), ("Sol", "Sol puede referirse a una estrella", True),
        ("Sol", "x hace referencia a varios", True), ("Mercury", "x" * 400 + "may refer to", False), ("Category:Kings", "can refer to", False), ("Template:Kings", "puede hacer referencia a", False),
    ],
)
def test_junk_pages(spark, title, text, junk):
    assert spark.createDataFrame([(title, text)], "t string, b string").select(U.is_junk(F.col("t"), F.col("b"))).first()[0] is junk


@pytest.mark.parametrize(
    "body, clean",
    [("a\n\nSee also\nb", "a"), ("a \n  NOTAS  \nb", "a"), ("a\nFuentes\nb", "a\nFuentes\nb"), ("a\nReferences and\nb", "a\nReferences and\nb"), ("a\nNotes\nb\nReferences\nc", "a"), ("References\nb", "References\nb")],
)
def test_appendix(spark, body, clean):
    assert spark.createDataFrame([(body,)], "b string").select(U.clean_body(F.col("b"))).first()[0] == clean


def test_contexts_number_valid_sentences(spark):
    body = "The cat. This one has the word in it. Nothing here of note is told. And the other one, the last, is long. The end"
    d = spark.createDataFrame([(1, body)], "doc_id long, body string")
    got = sorted((r.key, r.position, r.marked) for r in U.word_contexts(d, "The").collect())
    assert got == [
        ("ctx_000_occ_00", 3, "This one has [TARGET]the[/TARGET] word in it."),
        ("ctx_001_occ_00", 1, "And [TARGET]the[/TARGET] other one, the last, is long."),
        ("ctx_001_occ_01", 4, "And the other one, [TARGET]the[/TARGET] last, is long."),
    ]
    assert [r.key for r in U.word_contexts(d, "the", 1).collect()] == ["ctx_000_occ_00"]


def window(body, start, end, mode, size):
    """Straight from the definitions, occurrence by occurrence."""
    if mode == "chars":
        return max(0, start - size), min(len(body), end + size)
    if mode == "words":
        spans = [m.span() for m in re.finditer(r"\S+", body)]
        k = next(i for i, (a, b) in enumerate(spans) if a <= start < b)
        return spans[max(0, k - size)][0], spans[min(len(spans) - 1, k + size)][1]
    cut, stop = (r"[.!?]+\s+", [m.end() for m in re.finditer(r"[.!?]+", body)]) if mode == "sentence" else (r"\n\s*\n", [m.start() for m in re.finditer(r"\n\s*\n", body)])
    return max([0, *(m.end() for m in re.finditer(cut, body) if m.end() <= start)]), min([x for x in stop if x >= end], default=len(body))


@pytest.mark.parametrize("mode", ["chars", "words", "sentence", "paragraph"])
def test_windows_brute_force(spark, mode):
    rng = random.Random(7)
    bodies = ["".join(rng.choice(["the", " ", " the ", "x", ". ", "\n\n", " \n \n", "?!", "é😀", "3.14", "The word"]) for _ in range(rng.randrange(60))) for _ in range(120)] + ["", "the", "a the"]
    d = spark.createDataFrame([(i, b, "s") for i, b in enumerate(bodies)], "doc_id long, body string, source string")
    for size in (0, 3):
        want = {(i, k, *m.span(), *window(b, *m.span(), mode, size)) for i, b in enumerate(bodies) for k, m in enumerate(re.finditer(r"\bthe\b", b, re.IGNORECASE))}
        for got in (U.concordance(d, "the", "exact", mode, size), U.kwic(U.segments(d, "the"), mode, size), U.kwic(U.segments(d, "the").drop("body"), mode, size, d)):
            rows = got.collect()
            assert {(r.doc_id, r.occ, r.start, r.end, r.w_start, r.w_end) for r in rows} == want and len(rows) == len(want)
            assert all((r.left, r.text, r.right) == (bodies[r.doc_id][r.w_start : r.start], bodies[r.doc_id][r.start : r.end], bodies[r.doc_id][r.end : r.w_end]) for r in rows)


def test_sentences_brute_force(spark):
    rng = random.Random(8)
    bodies = ["".join(rng.choice(["a b", " ", ". ", "!\n", "\n\n", "...", "é😀 x", "?"]) for _ in range(rng.randrange(40))) for _ in range(100)]
    d = spark.createDataFrame([(i, b, "s") for i, b in enumerate(bodies)], "doc_id long, body string, source string")
    want = set()
    for i, b in enumerate(bodies):
        ends, at, k = [*(m.end() for m in re.finditer(r"[.!?]+\s+", b)), len(b)], 0, 0
        for e in ends:
            t = b[at:e]
            if t.strip():
                a = at + len(t) - len(t.lstrip())
                want.add((i, k, a, a + len(t.strip()), t.strip()))
                k += 1
            at = e
    assert {(r.doc_id, r.occ, r.start, r.end, r.text) for r in U.sentences(d).collect()} == want


def digest(seed, *key):
    return hashlib.md5("|".join(map(str, (seed, *key))).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 5, 10, 11, 100])
def test_strata_with_a_null_group(spark, n):
    rows = [(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "b") for i in range(11)]
    d = spark.createDataFrame(rows, "id long, g string")
    got = sorted(r.id for r in P.stratified(d, n, "g", ["id"], 4).collect())
    groups = {g: sorted((i for i, x in rows if x == g), key=lambda i: digest(4, i)) for g in (None, "a", "b")}
    chosen = [i for g in groups.values() for i in g[: len(g) if n >= 11 else n * len(g) // 11]]
    rest = sorted((i for i, _ in rows if i not in chosen), key=lambda i: digest(5, i))
    assert got == sorted(chosen + rest[: max(0, n - len(chosen))]) and len(got) == min(n, 11)


def spaced(items, most, distance, seed):
    levels = []
    while distance > 0:
        levels.append(distance)
        distance //= 2
    out = []
    if len(items) <= most:
        return set(items)
    for level in [*levels, 0]:
        for x in sorted(items, key=lambda x: (digest(seed, level, x), x)):
            if len(out) < most and all(x != y and abs(x - y) >= level for y in out):
                out.append(x)
    return set(out)


def test_spaced_caps_brute_force(spark):
    rng = random.Random(9)
    rows = [(g, rng.randrange(3000)) for g in [None, "a", "b", "c"] for _ in range(12)] + [("d", 1), ("d", 2)]
    rows = sorted(set(rows), key=str)
    d = spark.createDataFrame(rows, "g string, start int")
    for most, distance in ((3, 500), (5, 800), (2, 100), (20, 500)):
        got = {(r.g, r.start) for r in P.cap_per_group_spaced(d, most, "g", ["start"], "start", distance, 2).collect()}
        assert got == {(g, x) for g in (None, "a", "b", "c", "d") for x in spaced([s for h, s in rows if h == g], most, distance, 2)}


def test_casefold_and_accents(spark):
    texts = ["Straße ǅ ﬁ Σς", "ÀÉ i̇ Å ́", "plain", "", None, "İ"]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [tuple(r) for r in d.select(T.casefold(F.col("x")), T.strip_accents(F.col("x"))).collect()]
    import unicodedata

    bare = lambda s: "".join("".join(y for y in unicodedata.normalize("NFD", c) if unicodedata.category(y) != "Mn") or c for c in s)
    assert got == [(None, None) if x is None else (x.casefold(), bare(x)) for x in texts]


def test_concordance_of_the_table(spark):
    d = U.corpus(spark.read.parquet(f"{SF}/documents.parquet"))
    assert U.concordance(d, "the").count() == U.segments(d, "the").count()
