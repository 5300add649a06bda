"""The ten operators and the pipeline: awkward rows, brute force, round trips and held-out accuracy."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from lexiloom.llm import (
    html_layout,
    importance_resampling,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    quality_rules,
    registry,
    sentencepiece_codec,
    substring_dedup,
    topk_search,
)
from lexiloom.llm.words import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30000))
BASE = " ".join(f"word{i} the and" for i in range(60))


def awkward(spark):
    """Null and empty texts, null ids and sources, repeated rows, ties, a very long text, clashing columns."""
    rows = [
        (1, BASE, "en", "s1"), (1, BASE, "en", "s1"), (2, BASE, "en", None), (3, None, None, "s2"), (4, "", "de", "s2"), (5, " \n\t ", "de", "s1"),
        (6, LONG, "en", "s3"), (7, "a b c", "fr", "s1"), (8, "a b c", "fr", "s1"), (None, "no id here at all", "es", "s1"), (9, BASE + " extra", "en", "s2"), (10, "!!! 123", "en", "s1"),
    ]
    extra = [(*r, len(r[1] or ""), "x", 1, 2, 3) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, figures int, ids int")


def empty(spark):
    return awkward(spark).limit(0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_rules(spark):
    d = awkward(spark)
    got = quality_rules.measure(d, into="m")
    assert got.columns == [*d.columns, "m"] and got.count() == 12
    n = {r.doc_id: r.m for r in got.collect()}
    assert n[3].n_words == 0 and n[6].n_words == 30000 and n[7].word_chars == 3
    kept = quality_rules.filter_quality(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 1, 2, 9]
    assert quality_rules.filter_quality(empty(spark)).count() == 0
    (r,) = quality_rules.measure(spark.createDataFrame([("a b c d e f g h x a b c d e f g h\nq\nq", )], "text string")).collect()
    assert (r.figures.n_repeat_words, r.figures.n_dup_lines, r.figures.n_lines) == (16, 1, 3)


def test_quality_of_long_texts(spark):
    """A long varied text passes, with 0.07 distinct words a word; a long text of few words does not."""
    r = random.Random(1)
    stops = "the of and to in".split()
    novel = [w for _ in range(50000) for w in (r.choice(stops), f"w{r.randrange(7000)}")]
    poor = [w for _ in range(50000) for w in (r.choice(stops), f"w{r.randrange(100)}")]
    short = [f"the w{i % 10} of" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(novel)), (2, " ".join(poor)), (3, " ".join(novel[:1000])), (4, " ".join(novel[:1001])), (5, " ".join(short))], "doc_id long, text string")
    got = {x.doc_id: x.figures for x in quality_rules.measure(d).collect()}
    assert len(set(novel)) < 0.1 * len(novel) and got[1].n_unique_words == len(set(novel))
    for k, words in ((1, novel), (2, poor), (3, novel[:1000]), (4, novel[:1001])):
        assert got[k].n_unique_in_blocks == sum(len(set(words[i : i + 1000])) for i in range(0, len(words), 1000))
    assert sorted(x.doc_id for x in quality_rules.filter_quality(d).collect()) == [1, 3, 4]


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = {k: shingle_set(t) for k, t in docs.items()}
    up, seen = {k: k for k in sets}, collections.defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        for j, n in collections.Counter(j for g in sets[i] for j in seen[g]).items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            seen[g].append(i)
    return sets, {k: root(k) for k in sets}


def test_near_dedup_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    for k in range(40):  # a group whose members are close to each other but mostly not linked
        w = list(base)
        for i in rng.sample(range(150), 3):
            w[i] = f"x{k}_{i}"
        docs[100000 + k] = " ".join(w)
    sets, want = brute_components(docs)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_dedup_awkward(spark):
    d = awkward(spark)
    got = near_dedup.near_duplicates(spark, d)
    assert got.count() == 12
    c = {r.doc_id: r.component_id for r in got.collect()}
    assert (c[1], c[2], c[3], c[4], c[7], c[8], c[None], c[9]) == (1, 1, 3, 4, 7, 7, None, 1)
    kept = near_dedup.dedup(spark, d)
    assert kept.columns == d.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 10]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    k, n = near_dedup.BANDS * near_dedup.ROWS, near_dedup.BITS
    for share in (0.7, 0.85, 0.95):
        found = []
        for _ in range(30):
            both = rng.integers(0, 2**64, 400, dtype=np.uint64)
            one = rng.integers(0, 2**64, round(400 * (1 / share - 1)), dtype=np.uint64)
            s = near_dedup.odd_sketches(near_dedup.minhashes([both, np.r_[both, one]]))
            found.append(1 + n / (4 * k) * np.log(1 - 2 * int(np.bitwise_count(s[0] ^ s[1]).sum()) / n))
        assert abs(np.mean(found) - share) < 0.03
        assert share < 0.85 or min(found) > near_dedup.ESTIMATE


def test_substring_dedup(spark):
    line = "this very line is in both texts"
    d = spark.createDataFrame([(2, f"x y\n{line.upper()}\nend"), (1, f"{line}\nshort one\nshort one"), (3, None), (4, ""), (5, f"😀 é\n{line}  ")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.gone) for r in substring_dedup.dedup(spark, d, details="gone").collect()}
    assert got[1] == (f"{line}\nshort one\nshort one", None) and got[2][0] == "x y\nend" and got[5][0] == "😀 é" and got[3][0] is None and got[4][0] == ""
    (g,) = got[5][1]
    assert (g.start, g.end, g.n_words) == (4, 4 + len(line) + 2, 7)
    a = substring_dedup.dedup(spark, awkward(spark))
    assert a.columns == awkward(spark).columns and a.count() == 12
    texts = {r.doc_id: r.text for r in a.collect()}
    assert texts[1] == BASE and texts[2] == "" and texts[7] == "a b c"
    assert substring_dedup.dedup(spark, empty(spark)).count() == 0


def test_mixing(spark):
    d = awkward(spark)
    p = mixing.plan(spark, d)
    assert p.count() == 12
    for r in p.groupBy("name").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum("size").alias("s")).collect():
        assert r.t == int(r.g) and r.g <= 3 * r.s
    assert p.where("taken > 3 * size").count() == 0
    m = mixing.mix(spark, d)
    assert m.columns == d.columns
    assert m.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == p.agg(F.sum("taken")).first()[0]
    assert mixing.plan(spark, empty(spark)).count() == 0
    assert sorted(map(tuple, mixing.plan(spark, d.repartition(5)).collect()), key=str) == sorted(map(tuple, p.collect()), key=str)


def test_sentencepiece(spark):
    import sentencepiece

    model, v = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL), sentencepiece_codec.load()
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a\tb", "ﬁ ①é", "▁a", "日本 é​", "x" * 700, "\x00 <s> <0x0A>", "😀😀 a😀"]
    texts += ["".join(rng.choice("abcdet in▁ .,\n12日é😀") for _ in range(rng.randrange(300))) for _ in range(200)]
    out = []
    for _, _, data, offsets in slices(pa.array(texts), 1 << 16):
        ids, at = sentencepiece_codec.encode_run(v, data, offsets)
        out += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
    assert out == model.encode(texts)
    d = awkward(spark)
    e = sentencepiece_codec.encode(spark, d, into="pieces")
    back = sentencepiece_codec.decode(spark, e.drop("text"), "pieces", "again")
    assert e.columns == [*d.columns, "pieces"]
    assert sorted((r.again or "") for r in back.collect()) == sorted((r.text or "") for r in d.collect())
    assert e.where("pieces is null").count() == 1 and sentencepiece_codec.encode(spark, empty(spark), into="p").count() == 0


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (305, rows[0][1]), (306, [-1.0] * 8), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(spark, df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in ok if i % 50 == 0]:
        assert got.pop(q) == sorted(((i, int(v @ ok[q])) for i, v in ok.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
    assert not got and topk_search.top_k(spark, df.limit(0), F.lit(True)).count() == 0


def test_resampling(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = importance_resampling.resample(spark, docs, labels).toPandas()
    k = int(r.kept.sum())
    assert len(r) == 200 and r.sort_values("score", ascending=False).kept[:k].all()
    both = r.merge(labels.toPandas(), on="doc_id")
    assert ((both.kept == (both.quality == 1)).mean()) > 0.9
    a = importance_resampling.resample(spark, awkward(spark), labels.limit(0))
    assert a.count() == 12 and {x.log_weight for x in a.collect()} == {0.0}
    assert importance_resampling.resample(spark, empty(spark), labels).count() == 0
    keys = spark.createDataFrame([(x,) for x in (5, -7, 5, 2**62, 0)], "key long")
    assert [importance_resampling.kth_largest(keys, i) for i in (1, 2, 3, 5, 6)] == [2**62, 5, 5, -7, None]


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language_id.fit(docs)
    r = language_id.identify(spark, docs, m).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and r.score.between(0, 1).all()
    a = {x.doc_id: x for x in language_id.identify(spark, awkward(spark), m).collect()}
    assert [a[i].lang_pred for i in (3, 4, 5, 10)] == ["und"] * 4 and a[None].held_out is False
    none = language_id.identify(spark, docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert none.where("lang_pred <> 'und'").count() == 0
    x = pa.array(["the of and with nicht der die sich das pour les dans une"])
    for _, _, data, offsets in slices(x):
        e, first = m.emissions(data, offsets)
        got = [m.labels[i] for i in m.posteriors(e, first).argmax(axis=1)]
    assert got[:4] == ["en"] * 4 and got[4:9] == ["de"] * 5 and got[9:] == ["fr"] * 4


def test_forward_backward_brute_force():
    rng = np.random.default_rng(4)
    m = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    e = rng.standard_normal((4, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(m.begins[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            want[t, y] += w
    assert np.allclose(m.posteriors(e, np.array([0, 4])), want / want.sum(axis=1, keepdims=True))


def test_html(spark):
    page = """<title>t</title><p>Hello <b>big</b>
 world<p>two<ul><li>one<li>x<ol start=3><li>a<li>b</ol></ul><table><tr><th>Name<th>Value<tr><td>long name<td>1<tr><td rowspan=2>r<td>x<tr><td>y</table>
<div style="display:none">no</div><span hidden>no</span><!-- c --><script>var a="<p>no"</script><pre>a
  b</pre>a&amp;b<br>c"""
    text, items, rows = html_layout.render(page)
    assert text == "Hello big world\n\ntwo\n\n- one\n- x\n   3. a\n   4. b\n\nName       Value\nlong name  1\nr          x\n           y\n\na\n  b\n\na&b\nc"
    assert (items, rows) == (4, 4)
    deep = html_layout.render("<b><div>" * 20000 + "x" + "</div></i>" * 20000)
    assert deep[0] == "x"
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "<p>a", 1), (3, "<p>a", 1), (3, "<p>a", 1)], "page_id long, html string, text int")
    got = sorted((r.page_id or 0, r.text or "") for r in html_layout.extract(spark, d).collect())
    assert got == [(0, "a"), (1, ""), (2, ""), (3, "a"), (3, "a")]
    assert html_layout.extract(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<script>for(i=0;i<n;i++){}</script><p>Hello</p>", "Hello"),
        ("<div>a<script>if(i<n&&b>'c'){}</script>b</div>", "ab"),
        ("<script><!-- code </script><p>Hello", "Hello"),
        ("<script><!-- x('<script></script>') --></script><p>Hello", "Hello"),
        ("<script><!--> x('<script>') </script><p>Hello", "Hello"),
        ("<style>a<b{content:'<!--'}</style><p>Hello", "Hello"),
        ("<p>it's <b don't>one</b> <i title=\"a>b\" x='>'>two</i> don't", "it's one two don't"),
        ("<p>a</p><a href=\"x>b<p>c</p>", "a"),
    ],
)
def test_html_raw_elements(page, text):
    assert html_layout.render(page)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
        ("<math><semantics><mi>y</mi><annotation>TeX</annotation></semantics></math>", "y"),
        ("<svg><title/><style/><defs><text>no</text></defs>no<rect/><text>one</text><g><text><tspan>t</tspan>wo</text></g></svg> end", "one two end"),
        ("<svg><title>no</title><desc>no</desc><text><![CDATA[a<b]]></text></svg>", "a<b"),
        ("<p>a<svg><foreignObject><p>b</p></foreignObject></svg>c</p>d", "a\n\nb\n\nc\n\nd"),
        ("<svg><g><p>out</p>", "out"),
        ("<table><tr><td><svg><g></svg>x<td>y</table>", "x  y"),
        ("<select><optgroup label=g><option>a<option selected>b<optgroup><option>c</select>", "b"),
        ("<select><optgroup><option>a<option>b</optgroup></select>", "a"),
    ],
)
def test_html_foreign_text(page, text):
    assert html_layout.render(page)[0] == text


def test_licences(spark):
    mit = license_scan.TEMPLATES["mit"]
    d = spark.createDataFrame([(1, "Copyright 2020 X\n\n" + mit), (2, "x\nReleased under the MIT license"), (3, None), (4, ""), (None, "All rights reserved"), (5, "all rights"), (6, LONG)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.unit, r.template) for r in license_scan.scan(d).collect())
    assert got == [(0, "line", "all-rights-reserved"), (0, "text", "all-rights-reserved"), (1, "line", "mit"), (1, "text", "mit"), (2, "line", "mit-notice"), (2, "text", "mit-notice")]
    assert license_scan.scan(d.limit(0)).count() == 0


def test_licence_runs(spark):
    import textwrap

    mit, isc = ("\n".join(" * " + x for x in textwrap.wrap(license_scan.TEMPLATES[k], 60)) for k in ("mit", "isc"))
    filler = "\n".join(f"some other line {i} of the text and its {i + 1} words" for i in range(150))
    apache = license_scan.full_texts()["apache-2.0"]
    texts = {1: f"{filler}\n{mit}\n{filler}\n\n{isc}\n{filler}", 2: f"{mit}\nx\n{filler}\n{mit}", 3: f"{filler}\n{apache}\n{filler}", 4: filler, 5: "", 6: None, 7: LONG, 8: "all rights\nreserved", 9: "word"}
    d = spark.createDataFrame([*texts.items(), (None, texts[8])], "doc_id long, text string")
    got = license_scan.scan_runs(d).collect()
    at = lambda t, x: (t[: t.index(x)].count("\n"), t[: t.index(x)].count("\n") + x.count("\n"))
    found = {(r.doc_id, r.template, r.line, r.last_line) for r in got}
    assert {(1, "mit", *at(texts[1], mit)), (1, "isc", *at(texts[1], isc)), (8, "all-rights-reserved", 0, 1), (None, "all-rights-reserved", 0, 1)} <= found
    n = mit.count("\n")
    assert {(2, "mit", 0, n), (2, "mit", n + 152, 2 * n + 152)} <= found
    assert (3, "apache-2.0") in {x[:2] for x in found} and not {x[0] for x in found} & {4, 5, 6, 7, 9}
    # brute force over all runs of the first text
    words = [re.findall(r"[^\W_]+", x.lower()) for x in texts[1].split("\n")]
    own = set(license_scan._template_bigrams(license_scan.TEMPLATES["isc"]))
    best = 0.0
    for i in range(len(words)):
        for j in range(i, min(i + 40, len(words))):
            w = [y for x in words[i : j + 1] for y in x]
            b = set(zip(w, w[1:], strict=False))
            best = max(best, 2 * len(b & own) / (len(b) + len(own)))
    assert [r.dice for r in got if (r.doc_id, r.template) == (1, "isc")] == [best]
    assert license_scan.scan_runs(d.limit(0)).count() == 0


def test_pipeline_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.run(spark, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.query(spark, SF).collect() if r.kept}
    _, component = brute_components({k: rows[k] for k in good})
    left = sorted(k for k in good if component[k] == k)
    seen, texts = set(), {}
    for k in left:
        lines = []
        for x in rows[k].split("\n"):
            w = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), y) for y in WORD.findall(x))
            if len(w) < substring_dedup.MIN_WORDS or w not in seen:
                lines.append(x)
            seen.add(w)
        if WORD.search("\n".join(lines)):
            texts[k] = "\n".join(lines)
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = collections.Counter()
    for k, t in texts.items():
        sizes[source[k]] += len(WORD.findall(t))
    names = sorted(sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[n] for n in capped)
        weights = sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and rest * weight[n] / weights > 3 * sizes[n]}
        if not over:
            target = {n: 3 * sizes[n] if n in capped else rest * weight[n] / weights for n in names}
            break
        capped |= over
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    words = collections.Counter()
    for r in got.collect():
        assert r.doc_id in texts and r.n_tokens == len(r.ids)
        text = model.decode(r.ids)
        assert texts[r.doc_id].startswith(text)
        assert r.ids == model.encode(text)
        words[r.source] += len(WORD.findall(text))
    assert {n: words[n] for n in names} == {n: int(target[n]) for n in names}
