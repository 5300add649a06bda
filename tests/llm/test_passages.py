"""Substring dedup below the line: planted passages, brute force on what goes and what stays, awkward rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from lexiloom.llm import passage_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]


def grams(text, k):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def prose(rng, n):
    out = []
    while len(out) < n:
        s = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 25))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + rng.choice([".", ",", "", "\n"])]
    return " ".join(out[:n])


def planted(rng, n_docs, lengths):
    """Texts that share passages at random places, mid-line too, and texts that share none."""
    clean = {i: prose(rng, rng.randrange(60, 400)) for i in range(n_docs)}
    docs, where = {k: v.split(" ") for k, v in clean.items()}, collections.defaultdict(list)
    for j, n in enumerate(lengths):
        p = prose(rng, n).split(" ")
        for i in rng.sample(range(n_docs // 2), rng.randrange(2, 6)):
            at = rng.randrange(len(docs[i]) + 1)
            docs[i][at:at] = p
            where[j].append(i)
    return {k: " ".join(v) for k, v in docs.items()}, clean


def run(spark, docs, **more):
    rows = passage_dedup.dedup(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7), details="gone", **more).collect()
    return {r.doc_id: r for r in rows}


def test_planted_passages(spark):
    rng = random.Random(5)
    docs, clean = planted(rng, 200, [50, 50, 51, 55, 60, 60, 75, 120, 300] * 3)
    got = run(spark, docs)
    left = collections.Counter(g for r in got.values() for g in set(grams(r.text, 50)))
    assert collections.Counter(g for t in docs.values() for g in set(grams(t, 50))).most_common(1)[0][1] > 1
    assert max(left.values()) == 1
    assert all(got[i].text == clean[i] and got[i].gone is None for i in range(100, 200))
    # each word that goes lies in eight words that stand in an earlier text
    earlier = collections.defaultdict(set)
    for i in sorted(docs):
        for r in got[i].gone or []:
            part = docs[i][r.start : r.end]
            assert len(words(part)) == r.n_words >= passage_dedup.MIN_RUN
            seen = [bool(earlier[g] - {i}) for g in grams(part, 8)]
            assert all(any(seen[max(0, k - 7) : k + 1]) for k in range(r.n_words))
        for g in grams(docs[i], 8):
            earlier[g].add(i)
    # every word of a text is kept once or gone once, in order
    for i, t in docs.items():
        rest, at = "", 0
        for r in got[i].gone or []:
            rest, at = rest + t[at : r.start] + " ", r.end
        assert words(rest + t[at:]) == words(got[i].text)


def test_passage_mid_line(spark):
    p = " ".join(f"shared{i}" for i in range(60))
    docs = {1: f"one two three {p} four five\nsix", 2: f"seven {p.upper()}  eight\nnine ten", 3: f"{p}\nrest", 4: f"x y\n{p}", 5: p}
    got = run(spark, docs)
    assert got[1].text == docs[1]
    for i in (2, 3, 4, 5):
        left = words(got[i].text)
        assert len([x for x in left if x.startswith("shared")]) <= 2 * (passage_dedup.WINDOW + 1) and [x for x in left if not x.startswith("shared")] == [x for x in words(docs[i]) if not x.startswith("shared")]
    assert got[5].text == ""


def test_boundaries_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 60, 6)
        hashes, first = rng.integers(0, 2**64, int(sizes.sum()), dtype=np.uint64), np.r_[0, np.cumsum(sizes)]
        pairs = passage_dedup.mix(hashes[:-1] * passage_dedup._PAIR[0] + hashes[1:] * passage_dedup._PAIR[1])
        want = set()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                want.add(int(a))
            for s in range(a, b - passage_dedup.WINDOW):
                want.add(int(s + pairs[s : s + passage_dedup.WINDOW].argmin()))
        assert set(passage_dedup.boundaries(hashes, first).tolist()) == want
    same = passage_dedup.boundaries(np.full(100, 7, np.uint64), np.array([0, 100]))
    assert same.tolist()[:3] == [0, 12, 24]


def test_real_texts_share_nothing_long(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = passage_dedup.dedup(spark, docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    before, after = (collections.Counter(g for r in x.select("text").collect() for g in set(grams(r.text, 50))) for x in (docs, out))
    assert before.most_common(1)[0][1] > 1 and after.most_common(1)[0][1] == 1


def test_passages_awkward(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    text = " ".join(f"word{i} the and" for i in range(60))
    rows = [(1, text), (1, text), (1, "another text of the same id"), (2, text), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "a b c"), (8, "a b c"), (None, "no id here at all"), (9, "no id here at all"), (10, "is " * 500), (11, text + " more")]
    d = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, __spans int, __i int, gone int, c1 int")
    out = passage_dedup.dedup(spark, d)
    assert out.columns == d.columns and out.count() == len(rows)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
        assert (r["__spans"], r["__i"], r.gone, r.c1) == (1, 2, 3, 4)
    assert sorted(got[1]) == sorted([text, text, "another text of the same id"]) and got[2] == [""] and got[3] == [None] and got[4] == [""] and got[5] == [" \n\t "]
    assert got[6] == [long] and got[7] == got[8] == ["a b c"] and got[None] == ["no id here at all"] and got[9] == [""] and 0 < len(words(got[10][0])) < 100
    named = passage_dedup.dedup(spark, d, details="gone")
    assert sorted(named.columns) == sorted(d.columns) and named.where(F.col("doc_id") == 2).first().gone[0].n_words == 180
    assert passage_dedup.dedup(spark, d.limit(0)).count() == 0


def test_query_over_the_table(spark):
    got = passage_dedup.query(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(got) == len(docs) and (got.n_chars == got.text.str.len()).all()
    same = got.merge(docs, on="doc_id")
    assert ((same.n_removed == 0) == (same.text_x == same.text_y)).all()


def brute(docs):
    """{id: kept words} from the definition: word tuples instead of digests, all units of all texts in one dictionary."""
    units = collections.defaultdict(list)
    for i, text in docs.items():
        w = words(text)
        if not w:
            continue
        ((_, _, data, offsets),) = passage_dedup.slices(pa.array([text]), 1 << 30)
        starts, ends, first = passage_dedup.spans(data, offsets)
        begin = passage_dedup.boundaries(passage_dedup.Hasher(data, lower=True)(starts, ends), first).tolist()
        for a, b in zip(begin, [*begin[1:], len(w)], strict=True):
            b = min(len(w), max(b, a + passage_dedup.LEAST))
            units["p", tuple(w[a:b])].append((i, a, b))
        at = 0
        for line in text.split("\n"):
            n = len(words(line))
            if n >= passage_dedup.MIN_WORDS:
                units["l", tuple(w[at : at + n])].append((i, at, at + n))
            at += n
    gone = collections.defaultdict(set)
    runs = collections.defaultdict(list)
    for (kind, _), places in units.items():
        for i, a, b in sorted(places)[1:]:
            if kind == "l":
                gone[i].update(range(a, b))
            else:
                runs[i].append((a, b))
    for i, spans in runs.items():
        for k in {x for a, b in spans for x in range(a, b)}:
            lo, hi = k, k + 1  # the run of touching spans that holds the word
            grew = True
            while grew:
                grew = False
                for a, b in spans:
                    if a <= hi and b >= lo and (a < lo or b > hi):
                        lo, hi, grew = min(lo, a), max(hi, b), True
            if hi - lo >= passage_dedup.MIN_RUN:
                gone[i].add(k)
    return {i: [x for k, x in enumerate(words(t)) if k not in gone[i]] for i, t in docs.items()}


def test_against_the_definition(spark):
    rng = random.Random(11)
    docs, _ = planted(rng, 60, [20, 24, 30, 40, 50, 60, 80, 120])
    for i in range(60):
        if rng.random() < 0.3:
            docs[i] += "\nthis line stands in many of them\nshort line"
        if rng.random() < 0.2:
            docs[i] = docs[i] + "\n" + docs[i][: len(docs[i]) // 2]
    docs |= {100: docs[0], 101: docs[1].upper(), 102: "a b\nc d e f\nc d e f", 103: "", 104: "x " * 300, 105: "x " * 200 + "y"}
    got = {i: words(r.text) for i, r in run(spark, docs).items()}
    want = brute(docs)
    assert got == want and any(len(want[i]) < len(words(t)) for i, t in docs.items())
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {i: t for i, t in real.items() if len(t) < 4000}
    assert {i: words(r.text) for i, r in run(spark, short).items()} == brute(short)
