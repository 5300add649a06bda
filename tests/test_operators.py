"""Fixtures with results worked out by hand, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import sampling as P
from lexiloom.operators import tokens as K
from lexiloom.operators import units as U
from lexiloom.plans import linalg as L
from lexiloom.plans import lsa as A
from lexiloom.plans.concordance import Config, run
from lexiloom.plans.trace import TraceLog
from lexiloom.sources import corpora as C


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b, "s") for i, b in enumerate(bodies)], "doc_id long, body string, source string")


def test_offsets_are_code_points(spark):
    got = [(r.start, r.end, r.text) for r in U.segments(docs(spark, "😀 China. north china!"), "china").collect()]
    assert got == [(2, 7, "China"), (15, 20, "china")]


@pytest.mark.parametrize(("mode", "n"), [("exact", 1), ("variants", 3), ("loose", 4)])
def test_modes(spark, mode, n):
    assert U.segments(docs(spark, "yellow yellows yellowish ñyellow"), "yellow", mode).count() == n


def test_windows(spark):
    d = docs(spark, "Pi is 3.14 now. Next one.")
    w = lambda word: [(r.w_start, r.w_end) for r in U.kwic(U.segments(d, word), "sentence").collect()]
    assert w("now") == [(0, 15)] and w("is") == [(0, 8)]
    (p,) = U.kwic(U.segments(docs(spark, "a b\n\nc target d\n \ne"), "target"), "paragraph").collect()
    assert (p.w_start, p.w_end, p.left + p.text + p.right) == (5, 15, "c target d")
    (k,) = U.kwic(U.segments(docs(spark, "one two North Korea five six"), "North Korea"), "words", 1).collect()
    assert (k.left, k.right) == ("two ", "")
    with pytest.raises(ValueError):
        U.kwic(U.segments(d, "is"), "lines")


def test_window_property(spark):
    d = docs(spark, "A b. The c the 😀 d? the.\nthe x", "the", "no")
    for mode in ("chars", "words", "sentence", "paragraph"):
        bodies = {r.doc_id: r.body for r in d.collect()}
        for r in U.kwic(U.segments(d, "the"), mode, 2).collect():
            assert r.left + r.text + r.right == bodies[r.doc_id][r.w_start : max(r.w_end, r.end)]


def test_preparation(spark):
    r = spark.createDataFrame([("a  b\n\nc", "e\u0301", "Straße")], "x string, y string, z string").select(
        T.collapse_whitespace(F.col("x")), T.collapse_offset(F.col("x"), F.lit(6)), T.nfc(F.col("y")), T.nfc(F.col("y"), "reference"), T.strip_accents(F.lit("\u00e9")), T.casefold(F.col("z")), T.slugify(F.lit("\u00c9l & yo!")),
    ).first()
    assert list(r) == ["a b c", 4, "\u00e9", "e\u0301", "e", "strasse", "\u00e9l_yo"]
    with pytest.raises(ValueError):
        T.prepare(F.lit("x"), ["rot13"])


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    r = spark.range(1).select(
        V.cosine(a(0, 0), a(1, 0)), V.cosine(a(0, 0), a(1, 0), V.NAN), V.angular(a(0, 0), a(1, 0)), V.unit(a(0, 0)), V.kl(a(1, 0), a(0.5, 0.5)), V.zscore(a(2, 2, 2)),
        V.minkowski(a(1, 5), a(4, 1), float("inf")), V.minkowski(a(1, 5), a(4, 5), 0), V.jaccard(a(0, 0), a(0, 0)), V.mahalanobis(a(1, 2), a(3, 5), [[1.0, 0.0], [0.0, 1.0]]),
    ).first()
    assert r[0] == 0 and np.isnan(r[1]) and r[2] == pytest.approx(0.5) and r[3] == [0, 0] and r[4] == pytest.approx(np.log(2)) and r[5] == [0, 0, 0]
    assert r[6] == 4 and r[7] == 1 and r[8] == 0 and r[9] == pytest.approx(13**0.5)


def test_sampling(spark):
    units = spark.createDataFrame([(i, "abc"[(i >= 7) + (i >= 9)], 100 * i) for i in range(10)], "id long, g string, start int")
    got = {r[0]: r[1] for r in P.stratified(units, 5, "g", ["id"], 1).groupBy("g").count().collect()}
    assert sum(got.values()) == 5 and got["a"] >= 3 and got.get("b", 0) >= 1
    assert P.random(units, 50, ["id"]).count() == 10
    assert P.random(units.repartition(7), 4, ["id"], 3).collect() == P.random(units.coalesce(1), 4, ["id"], 3).collect()
    spaced = P.cap_per_group_spaced(units, 3, "g", ["id"], "start", 250, 2).groupBy("g").count().collect()
    assert {r[0]: r[1] for r in spaced} == {"a": 3, "b": 2, "c": 1}


def test_fragments(spark):
    f = lambda **k: [(r.from_token, r.to_token) for r in K.fragments(spark.createDataFrame([(20,)], "n int"), "n", 10, window=10, special=2, **k).collect()]
    assert f(strategy="fixed") == [(0, 8), (8, 16), (16, 20)]
    assert f(strategy="sliding_windows", stride=6) == [(0, 8), (4, 12), (8, 16), (12, 20)]
    w = spark.range(1).select(K.centre(F.lit(20), F.lit(18), F.lit(18), 8).alias("w")).first().w
    assert (w.a, w.b) == (12, 20)
    t = F.expr("array(named_struct('start',0,'end',0),named_struct('start',0,'end',3),named_struct('start',3,'end',6),named_struct('start',7,'end',9),named_struct('start',0,'end',0))")
    assert spark.range(1).select(K.align(t, F.lit(2), F.lit(5))).first()[0] == [1, 2]


def test_linear_algebra(spark):
    rng = np.random.default_rng(0)
    x = rng.random((50, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    assert np.allclose(L.covariance(df, "v"), np.cov(x, rowvar=False))
    assert np.allclose(L.singular_values(df, "v"), np.linalg.svd(x, compute_uv=False))
    s = np.array([r.scores for r in L.subspace_scores(df, "v", 3).collect()])
    assert s.shape == (50, 3) and np.allclose(np.linalg.norm(s, axis=1), 1)
    h = L.horn(spark, x, 5)
    assert len(h["real"]) == len(h["random"]) == 5 and (np.diff(h["real"]) <= 1e-12).all()
    a, b = L.gram_schmidt(rng.standard_normal((2, 5))), L.gram_schmidt(rng.standard_normal((2, 5)))
    u, w = rng.standard_normal(5), rng.standard_normal(5)
    one, _ = L.entangle(a, b, False)
    assert L.expectation(a, b, u, w) == pytest.approx((np.linalg.norm(one @ np.kron(L.unit(u), L.unit(w)))) ** 2)
    rho = lambda m: m.T @ m / len(m)
    assert L.quantum_correlation(a, b) == pytest.approx(np.trace(rho(a) @ rho(b)))
    assert np.allclose(L.entangle(a, b)[2] @ L.entangle(a, b)[2].T, np.eye(4))


def test_lsa(spark):
    texts = ["aa bb cc", "aa bb dd", "ee ff", "ee gg aa"]
    w = A.tfidf(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    rows = w.toPandas().pivot(index="term", columns="doc_id", values="w").fillna(0).to_numpy()
    _, _, s = A.lsa(w, 3, 1, 2)
    assert np.allclose(s, np.linalg.svd(rows, compute_uv=False)[:3], atol=1e-6)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x 1.txt").write_text("hello")
    (tmp_path / "one.txt").write_text("id=a|year=2018\n\nBody A\n---\n\n---\nid=a\n\nBody B")
    (r,) = C.from_files(spark, str(tmp_path / "a"), folders=["year"], file_key="file", defaults={"k": "v"}).collect()
    assert (r.doc_id, r.body, r.meta) == ("x 1", "hello", {"source": "files", "k": "v", "file": "x 1"})
    got = C.from_single_file(spark, str(tmp_path / "one.txt"), "\n---\n", True, "\n\n").orderBy("doc_id").collect()
    assert [(g.doc_id, g.body, g.meta["document_index"]) for g in got] == [("a", "Body A", "1"), ("a_2", "Body B", "3")]
    c = C.from_rows(spark, [("d", "the body", {"m": "1"})])
    C.save(c, str(tmp_path / "out"), "full")
    assert C.load(spark, str(tmp_path / "out")).collect() == c.collect()
    (tmp_path / "c.json").write_text('{"summary": {}, "data": {"d": {"body": "the body", "meta": {"m": "1"}}}}')
    assert C.load_json(spark, str(tmp_path / "c.json")).collect() == c.collect()
    assert spark.range(1).select(C.vector_response(F.lit("<dim>1,5</dim><dim>-2</dim>"))).first()[0] == [1.5, -2.0]


def test_concordance(spark):
    log = TraceLog()
    d = docs(spark, "the cat. the dog", "no", "The end")
    out = run(d, Config("the", n_documents=2, n_occurrences=2, window="chars", size=3), log)
    assert out.count() == 2 and len(log) == 2 and log.entries(spark).count() == 2
