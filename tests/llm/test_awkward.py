"""Resampling and pages by brute force; clashing names, empty tables, ties and awkward rows of the operators and the pipeline."""

import collections
import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import BASE, LONG, awkward, empty

from lexiloom.llm import html_layout, importance_resampling, language_id, license_scan, mixing, quality_rules, substring_dedup

TOKEN = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+|[^A-Za-z0-9_\u0080-\U0010ffff \t-\r]+")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def buckets_of(text, n):
    """n-grams as tuples of lower-case tokens, with the bucket of each by the kernel on that n-gram alone."""
    t = [low(x) for x in TOKEN.findall(text or "")]
    return [(x,) for x in t] + list(zip(t, t[1:], strict=False))


def test_resampling_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    size, own = 16384, {}

    def bucket(g):  # the kernel names a gram's bucket; what is counted, summed and kept is checked here
        if g not in own:
            ((_, b, _),) = importance_resampling.grams(pa.array([" ".join(g)]), size)
            own[g] = int(b[-1])
        return own[g]

    grams = {i: [bucket(g) for g in buckets_of(t, size)] for i, t in texts.items()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.ones(size), np.ones(size)
    for i, b in grams.items():
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(target, b, 1)
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = {r[0]: (r[1] % 2**64 >> 11) / 2**53 + 2.0**-54 for r in docs.select("doc_id", F.xxhash64(F.lit(0), F.lit("gumbel"), "doc_id", F.xxhash64("text"))).collect()}
    score = {i: float(sum(weight[b])) - math.log(-math.log(noise[i])) for i, b in grams.items()}
    n = labels.where("quality is not null").count()
    best = set(sorted(score, key=score.get, reverse=True)[: round(labels.where("quality = 1").count() / n * len(texts))])
    got = importance_resampling.resample(spark, docs, labels).collect()
    assert len(got) == len(texts) and {r.doc_id for r in got if r.kept} == best
    for r in got:
        assert r.n_grams == len(grams[r.doc_id]) and math.isclose(r.log_weight, sum(weight[grams[r.doc_id]]), abs_tol=1e-6) and math.isclose(r.score, score[r.doc_id], abs_tol=1e-6)


def test_resampling_ties(spark):
    d = spark.createDataFrame([(None, f"text {i} of many") for i in range(40)] + [(1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    out = importance_resampling.resample(spark, d, spark.createDataFrame([], "doc_id long, quality int"), fraction=0.5).collect()
    scores = collections.Counter(r.score for r in out)
    assert sorted(scores.values()) == [1] * 41 + [2] and sum(r.kept for r in out) in (22, 23)


class Words(HTMLParser):
    """Words of all text outside elements that show none; enough for pages whose markup is closed."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in html_layout.VOID:
            return
        gone = tag in html_layout.UNSEEN or "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""))
        self.hidden.append((tag, gone))

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.hidden):
            if self.hidden.pop()[0] == tag:
                break

    def handle_data(self, data):
        if not any(g for _, g in self.hidden):
            self.out += data.split()


def test_words_of_all_pages(spark):
    marker = re.compile(r"^(-|\d+\.)$")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Words()
        p.feed(r.html)
        p.close()
        want = collections.Counter("".join(x for x in p.out if not marker.match(x)))
        got = collections.Counter("".join(x for x in html_layout.render(r.html)[0].split() if not marker.match(x)))
        assert got == want, r.page_id


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><caption>Cap</caption>loose<tr><td><p>x<p>y<td>z</table>", "loose\n\nCap\nx  z\n\ny"),
        ("a<table><tr>b<td>c</table>d", "ab\n\nc\n\nd"),
        ("<table><tr><td colspan=2>a wide header<td>h<tr><td>1<td>2<td>3</table>", "a wide header  h\n1  2           3"),
        ("<table><tr><td colspan=3>abcdefghijkl<tr><td>1<td>2<td>3<td>4</table>", "abcdefghijkl\n1  2  3       4"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>long<td>cell<td>d</table>", "ab          c\nlong  cell  d"),
    ],
)
def test_tables(page, text):
    assert html_layout.render(page)[0] == text


def test_very_long_page():
    page = "<table>" + "<tr><td>a<td colspan=2>b" * 30000 + "</table>" + "<p>x " * 30000
    text, _, rows = html_layout.render(page)
    assert rows == 30000 and text.count("x") == 30000


CLASH = "__mix_key __mix_n __mix_size __all __n __cut c0 c1 i name t __i __t __text __spans details line m".split()


def clashing(spark):
    d = awkward(spark)
    return d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def test_clashing_names(spark):
    d = clashing(spark)
    out = mixing.mix(spark, d)
    assert out.columns == d.columns and all(tuple(r[c] for c in CLASH) == tuple(range(len(CLASH))) for r in out.collect())
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.plan(spark, d).agg(F.sum("taken")).first()[0]
    for details in (None, "details"):
        out = substring_dedup.dedup(spark, d, details=details)
        assert sorted(out.columns) == sorted(d.columns) and out.count() == 12
    assert mixing.plan(spark, d).count() == 12 and license_scan.scan(d).count() == license_scan.scan(awkward(spark)).count()
    assert license_scan.scan_runs(d).count() == license_scan.scan_runs(awkward(spark)).count()
    assert quality_rules.filter_quality(d).columns == d.columns


def test_empty_tables(spark):
    d = empty(spark)
    assert mixing.mix(spark, d).count() == mixing.plan(spark, d).count() == 0 and mixing.mix(spark, d).columns == d.columns
    assert license_scan.scan(d).count() == license_scan.scan_runs(d).count() == 0
    m = language_id.fit(d)
    assert language_id.identify(spark, d, m).count() == 0


def test_mix_is_the_same_again(spark):
    rows = [(None, f"some text number {i} here") for i in range(60)] + [(5, f"one id {i} again") for i in range(30)] + [(7, "same same")] * 6
    d = spark.createDataFrame([(i, t, "s" if k % 2 else "u", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, k int")
    first = sorted(map(tuple, mixing.mix(spark, d).collect()), key=str)
    for parts in (1, 7):
        assert sorted(map(tuple, mixing.mix(spark, d.repartition(parts)).collect()), key=str) == first
    p = mixing.plan(spark, d)
    assert sum(len(t.split()) for _, t, _, _ in first) == p.agg(F.sum("taken")).first()[0]
    assert p.select("doc_id", "t").distinct().count() == 91


def test_licences_of_repeated_rows(spark):
    mit = license_scan.TEMPLATES["mit"]
    d = spark.createDataFrame([(1, mit), (1, mit), (None, mit), (2, "x\n" + LONG)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.unit) for r in license_scan.scan(d).collect())
    assert got == {(1, "line"): 2, (1, "text"): 2, (None, "line"): 1, (None, "text"): 1}


def test_pipeline_of_awkward_rows(spark):
    import corpus_pipeline as cp

    words = "the of and to in a is that it for on with as was at by an be this which or from but not are".split()
    good = lambda k: " ".join(f"{words[(i * (k + 1) + j) % len(words)]} word{k}x{i}y{j}." for i in range(12) for j in range(4))
    texts = [(20 + k, good(k)) for k in range(6)] + [(20, good(9)), (20, good(0)), (None, good(7)), (30, good(8) + "\n" + " ".join(good(1).split()[:60]))]
    rows = [(i, t, "en", "s1" if k % 2 else None, len(t)) for k, (i, t) in enumerate(texts)]
    d = clashing(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(None).alias(c) for c in ["kept", "size", "figures", "ids", *CLASH]]))
    seen = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen.append((docs.columns, out.columns))
            return out

        return run

    for stages in (cp.STAGES, cp.PASSAGE_STAGES):
        seen.clear()
        out = cp._run(spark, SF, [(name, watched(stage)) for name, stage in stages], d)
        assert [b for _, b in seen[:-1]] == [d.columns] * 4 and [a for a, _ in seen] == [d.columns] * 5
        assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and {r.doc_id for r in out.collect()} >= {21, 22, None}
    assert cp._run(spark, SF, cp.PASSAGE_STAGES, d.limit(0)).count() == 0
    near = collections.Counter(r.text for r in cp.near_duplicates(spark, cp.quality(spark, d, SF), SF).collect())
    assert near[good(9)] == 1 and near[good(0)] == 1 and near[BASE] <= 1


def test_passages_of_the_pipeline(spark):
    import corpus_pipeline as cp
    import sentencepiece

    from lexiloom.llm import near_dedup, passage_dedup, sentencepiece_codec

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in passage_dedup.dedup(spark, near_dedup.dedup(spark, quality_rules.filter_quality(docs))).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = cp.run_passages(spark, SF).collect()
    assert got
    for r in got:
        text = model.decode(r.ids)
        assert left[r.doc_id].startswith(text) and r.ids == model.encode(text) and r.n_tokens == len(r.ids)
    words = lambda t: [low(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = collections.Counter(g for t in {r.doc_id: left[r.doc_id] for r in got}.values() for w in [words(t)] for g in {tuple(w[k : k + 50]) for k in range(len(w) - 49)})
    assert not seen or max(seen.values()) == 1
