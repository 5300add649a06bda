"""Sources, lexicons, layers and plans on small fixtures; figures of linear algebra against NumPy, through the queries too."""

import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexiloom import registry
from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import layers as Y
from lexiloom.operators import tokens as K
from lexiloom.plans import concordance as C
from lexiloom.plans import linalg as L
from lexiloom.sources import articles, corpora, lexicons


@pytest.fixture(scope="module")
def table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    return e.vec_id.to_numpy(), np.array(e.embedding.tolist(), np.float32).astype(float), e.label.to_numpy()


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def same_up_to_sign(a, b):
    return all(np.allclose(x, y, atol=1e-8) or np.allclose(x, -y, atol=1e-8) for x, y in zip(a, b, strict=True))


# figures without SQL, against NumPy


def test_pca_and_singular_values(spark, table):
    _, x, _ = table
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    assert np.allclose(run(spark, "pca_ratio").sort_values("k").ratio, s[:10] / s.sum())
    assert np.allclose(run(spark, "singular_values").sort_values("k").sigma, np.linalg.svd(x, compute_uv=False))


def test_subspace_scores_and_description(spark, table):
    ids, x, _ = table
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    scores = c @ vt[:3].T
    scores /= np.linalg.norm(scores, axis=1, keepdims=True)
    got = run(spark, "subspace_scores").pivot(index="vec_id", columns="k", values="score").loc[ids].to_numpy()
    assert same_up_to_sign(got.T, scores.T)
    d = run(spark, "describe_subspace").sort_values(["dimension", "rank"])
    for k in range(2):
        mine = d[d.dimension == k]
        product = x @ vt[k]
        assert any(mine.term.tolist() == ids[np.argsort(-sign * product, kind="stable")[:5]].tolist() for sign in (1, -1))


def test_mahalanobis(spark, table):
    ids, x, _ = table
    got = run(spark, "dist_mahalanobis").sort_values("vec_id")
    inverse = np.linalg.pinv(np.cov(x.T))
    value = [c for c in got.columns if c != "vec_id"][0]
    at = {i: k for k, i in enumerate(ids)}
    want = [np.sqrt((x[at[i]] - x[at[i + 1]]) @ inverse @ (x[at[i]] - x[at[i + 1]])) for i in got.vec_id]
    assert np.allclose(got[value], want, rtol=1e-4)


def judged(sa, sb, va, vb):
    one = lambda v: v / np.linalg.norm(v)
    at = lambda s, v: one(s.T @ s @ one(v))
    space = np.kron(sa, sb)
    space /= np.linalg.norm(space, axis=1, keepdims=True)
    e = lambda x, y: float(np.sum((space @ np.kron(x, y)) ** 2))
    aA, bB, aB, bA = at(sa, va), at(sb, vb), at(sb, va), at(sa, vb)
    ra, rb = sa.T @ sa / len(sa), sb.T @ sb / len(sb)
    return [np.trace(ra @ rb), float(one(va) @ one(vb)), e(aA, bB) - e(aA, bA) + e(aB, bB) + e(aB, bA), e(aA, bB) - e(aA, aB) + e(bA, bB) + e(bA, aB), e(bB, aA) - e(bB, aB) + e(bA, aA) + e(bA, aB), e(bB, aA) - e(bB, bA) + e(aB, aA) + e(aB, bA)]


def test_pair_studies(spark, table):
    _, x, label = table
    spaces = {}
    for w in set(label.tolist()):
        c = x[label == w] - x[label == w].mean(axis=0)
        spaces[str(w)] = np.linalg.svd(c, full_matrices=False)[2][:2]
    first = {str(w): x[np.flatnonzero(label == w)[0]] for w in set(label.tolist())}
    names = ["correlation", "cosine", "chsh_c1", "chsh_c2", "chsh_c3", "chsh_c4"]
    got = run(spark, "pair_study")
    assert len(got) == 9 and got.error.isna().all()
    for r in got.itertuples():
        assert np.allclose([getattr(r, n) for n in names], judged(spaces[r.word_a], spaces[r.word_b], first[r.word_a], first[r.word_b]))
    got = run(spark, "pair_concept_study")
    assert len(got) == 8 and np.allclose(got.cosine, 1)
    for r in got.itertuples():
        concept = first[str(int(r.word_a) + 2)]
        assert np.allclose([getattr(r, n) for n in names], judged(spaces[r.word_a], spaces[r.word_b], concept, concept))


def test_a_pair_without_a_subspace_tells_its_error(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 1.0]), ("b", [0.0, 1.0]), ("b", [1.0, 0.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([("a", "b")], "word_a string, word_b string")
    (r,) = L.pair_study(pairs, d, spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])], "word string, vector array<double>")).collect()
    assert r.error and r.cosine is None


def test_spectrum_and_features(spark, table):
    ids, x, _ = table
    got = run(spark, "correlation_spectrum").sort_values("k")
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(got.eigenvalue, values) and np.isclose(got.percent.sum(), 100) and np.isclose(got.cumulative.iloc[-1], 100)
    assert (got.effective == (np.cumsum(values) / values.sum() * 100 <= 95).sum() + 1).all()
    got = run(spark, "feature_subspace").pivot(index="dim", columns="vec_id", values="x")[ids].to_numpy()
    t = x.T - x.T.mean(axis=0)
    want = np.linalg.svd(t, full_matrices=False)[2][:3]
    assert all(np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7) for a, b in zip(got, want, strict=True))
    assert np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)


def test_svd_factors(spark, table):
    ids, x, _ = table
    d = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    left, s, right = L.svd(d, "vec_id", "v")
    u = np.array([r.vector for r in left.orderBy("vec_id").collect()])
    assert np.allclose(u.T @ u, np.eye(len(s)), atol=1e-8) and np.allclose(right @ right.T, np.eye(len(s)), atol=1e-8)
    assert np.allclose(u * s @ right, x) and np.isclose(L.determinant(d, "v"), np.linalg.det(np.cov(x.T)))


def test_parallel_analysis(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 12)) + rng.standard_normal((60, 12)) * 0.1
    r = L.horn(spark, data, 30, 5)
    want = np.mean([L.ratios(np.random.default_rng(5 + i).standard_normal(data.shape)) for i in range(30)], axis=0)
    assert r["retain"] == 2 and np.allclose(r["random"], want) and len(r["real"]) == 11 and (np.diff(r["real"]) <= 1e-12).all()
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    s = np.linalg.svd(z - z.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(r["real"], s[:11] / s.sum())


@pytest.mark.parametrize("n, d", [(400, 6), (7, 6), (6, 6), (5, 8)])
def test_parallel_analysis_of_a_table(spark, n, d):
    rng = np.random.default_rng(n)
    data = rng.standard_normal((n, d)) + 2 * rng.standard_normal((n, 1))
    rows = spark.createDataFrame([(x.tolist(),) for x in data], "v array<double>")
    got, want = L.horn_rows(rows, "v", 300, 3), L.horn(spark, data, 300, 4)
    assert len(got["real"]) == min(n, d) - 1 and np.allclose(got["real"], want["real"])
    assert np.allclose(got["random"], [np.mean([noise(n, d, i)[k] for i in range(300)]) for k in range(min(n, d) - 1)], atol=0.02)


def noise(n, d, seed):
    """Ratios of random rows as they are, not z-scored."""
    x = np.random.default_rng(1000 + seed).standard_normal((n, d))
    v = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    return v / v.sum()


def test_lsa_values(spark):
    import re

    rows = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    texts = [re.findall(r"\b\w\w+\b", r.text) for r in rows]
    vocabulary = sorted({w for t in texts for w in t})
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for i, t in enumerate(texts):
        for w in t:
            x[i, at[w]] += 1
    x *= np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = run(spark, "lsa_singular_values").sort_values("k").sigma.to_numpy()
    assert np.allclose(got, np.linalg.svd(x, compute_uv=False)[:10], rtol=2e-2) and np.isclose(got[0], np.linalg.svd(x, compute_uv=False)[0], rtol=1e-6)


def test_pooled_units(spark):
    got = run(spark, "pooled_units").pivot(index=["conv_id", "turn"], columns="dim", values="x")
    enc = K.HashEncoder()
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("w")).collect()
    assert len(got) == len(rows)
    for r in rows[::7]:
        assert np.allclose(got.loc[(r.conv_id, r.turn)].to_numpy(), enc(r.w)[-1].mean(axis=0))


def test_orthogonality_and_both_orders():
    rng = np.random.default_rng(2)
    a, b = (np.linalg.qr(rng.standard_normal((6, 2)))[0].T for _ in range(2))
    ok, worst = L.orthogonality(a, b)
    spaces = [np.kron(a, b), np.kron(b, a)]
    off = [np.abs(np.corrcoef(x / np.linalg.norm(x, axis=1, keepdims=True)))[~np.eye(4, dtype=bool)].max() for x in spaces]
    assert np.isclose(worst, max(off)) and ok == (max(off) <= 0.01)
    x, y = L.quantum_correlations(a, b)
    assert abs(x - y) < 2e-15 and np.isclose(x, np.trace(a.T @ a @ b.T @ b) / 4)
    centred = np.array([[1.0, -1, 0, 0], [0, 0, 1.0, -1]])
    assert L.orthogonality(centred, centred)[0]


# sources


def test_articles(spark):
    page = lambda **p: json.dumps({"query": {"pages": p.pop("pages", {"7": p})}})
    rows = [(1, "a", page(title="A", extract="old")), (2, "A", page(title="A", extract="new")), (3, "x", page(pages={"-1": {"title": "x", "missing": ""}})), (4, "y", page(pages={"9": {"title": "y", "missing": ""}})), (5, "z", "{}"), (6, "e", page(title="E"))]
    d = spark.createDataFrame(rows, "n int, asked string, response string")
    got = {r.doc_id: r for r in articles.load(d, "es").collect()}
    assert set(got) == {"A", "E"} and got["A"].body == "new" and got["E"].body == "" and got["A"].meta == {"source": "wikipedia", "via": "api", "language": "es", "title": "A", "page_id": "7"}
    with pytest.raises(Exception, match="article not found: [xyz]"):
        articles.load(d, skip_missing=False).collect()


def test_retries():
    waits = []
    answers = [(429, {}, ""), (503, {"Retry-After": "7"}, ""), (200, {}, "text")]
    assert articles.fetch(lambda t: answers[len(waits)], "x", sleep=waits.append) == "text" and waits == [1, 7]
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        articles.fetch(lambda t: (429, {}, ""), "x", 3, lambda s: None)
    with pytest.raises(RuntimeError, match="status 404"):
        articles.fetch(lambda t: (404, {}, ""), "x")


def test_scan_order(spark):
    body = "China " * 3
    rows = [("A", body + "x" * 100 + " china"), ("A", body + "x" * 100), ("list of x", body * 50), ("B", "china may refer to " + "x" * 100), ("C", body), ("D", "x" * 95 + "\nNotes\n" + body * 20), ("E", "x" * 120 + " china china")]
    d = spark.createDataFrame(rows, "title string, text string")
    got = {r.title: (r.hits, len(r.body)) for r in articles.scan(d, ["china"], 10, 1, None, 2, 100, 50).collect()}
    assert set(got) == {"A", "E"} and got["E"] == (2, 50)  # hits count before the cut


def test_minimum(spark):
    have = spark.createDataFrame([("a", "the x"), ("b", "none")], "doc_id string, body string")
    more = spark.createDataFrame([("a", "the other the"), ("c", "the"), ("d", "the the"), ("e", "no")], "doc_id string, body string")
    assert sorted(map(tuple, articles.ensure_minimum(have, more, "the", 2).collect())) == [("a", "the x"), ("b", "none"), ("c", "the"), ("d", "the the")]
    assert articles.ensure_minimum(have, more, "the", 1).count() == 2


def test_lists_by_line(spark, tmp_path):
    (tmp_path / "p.txt").write_text("bread-butter\nbad line\na-b-c\nred - wine\n")
    (tmp_path / "c.txt").write_text('"food"\nx\ny\n"drink"\n')
    p, c = corpora.pairs(spark, str(tmp_path / "p.txt")), corpora.concepts(spark, str(tmp_path / "c.txt"))
    assert sorted(map(tuple, corpora.by_line(p, c).collect())) == [(1, "bread", "butter", "food"), (4, "red", "wine", "drink")]


def test_csv_vector_and_terms(spark, tmp_path):
    (tmp_path / "v.csv").write_text('"","x"\n' + "".join(f'"{i}",{i / 4}\n' for i in range(1, 301)))
    assert lexicons.csv_vector(spark, str(tmp_path / "v.csv")).first()[0] == [i / 4 for i in range(1, 301)]
    (tmp_path / "t.txt").write_text("uno\n\n dos \nuno\n")
    terms = lexicons.terms(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, terms.collect())) == [(1, "uno"), (3, "dos"), (4, "uno")]
    said = spark.createDataFrame([("uno", "<r><dim>1,5</dim><dim>-2</dim></r>"), ("dos", "<r/>"), ("tres", "<dim>1</dim>")], "term string, body string")
    assert [tuple(r) for r in lexicons.from_responses(terms, said).collect()] == [("uno", [1.5, -2.0])]


@pytest.mark.parametrize(
    "path, want",
    [("x/1999/news/a/b.txt", ("1999", "news", "b")), ("1999/news/b.txt", ("1999", "news", "b")), ("x/1999/b.txt", None), ("1999/b.txt", None), ("12345/n/b.txt", None), ("1998/1999/n/b", ("1998", "1999", "b")), ("b.txt", None)],
)
def test_year_newspaper(spark, path, want):
    m = spark.createDataFrame([(path,)], "p string").select(corpora.year_newspaper(F.col("p"))).first()[0]
    assert m == ({} if want is None else dict(zip(("year", "newspaper", "article_id"), want, strict=True)))


def test_lsa_sink(spark, tmp_path):
    t, d = (spark.createDataFrame([(k, [1.0, 2.0])], f"{n} string, vector array<double>") for k, n in (("w", "term"), ("d", "doc_id")))
    out = corpora.save_lsa(str(tmp_path / "lsa"), t, d, [3.0, 2.0], {"word_vectors": "U"})
    assert spark.read.parquet(out["word_vectors"]).first().term == "w" and [r.value for r in spark.read.parquet(out["singular_values"]).orderBy("k").collect()] == [3.0, 2.0]
    assert spark.read.json(out["metadata"]).first().metadata.n_components == "2"


def test_file_tree(spark, tmp_path):
    for p in ("b/x/1.txt", "a/2.txt", "3.txt", "a/y/4.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("t")
    r = corpora.file_tree(spark, str(tmp_path)).first()
    assert (r.n_files, r.min_depth, r.max_depth, r.examples) == (4, 0, 2, ["3.txt", "a/2.txt", "a/y/4.txt", "b/x/1.txt"])
    values = corpora.folder_values(corpora.files(spark, str(tmp_path), recursive=True).select("path"))
    assert sorted(map(tuple, values.collect())) == [(0, "a", 1), (0, "b", 2), (1, "x", 1), (1, "y", 2)]


# lexicons and layers


def greedy(word, vocabulary, mark):
    at, out = 0, []
    while at < len(word):
        n = next((n for n in range(len(word) - at, 0, -1) if (mark if at else "") + word[at : at + n] in vocabulary), None)
        if n is None:
            return None
        out.append((mark if at else "") + word[at : at + n])
        at += n
    return out or None


def test_pieces(spark):
    vocabulary = ["un", "##aff", "##able", "##a", "##b", "u", "##n", "a", "ab", "##bab", "é", "##é"]
    words = ["unaffable", "Unaffable", "ababab", "aba", "abx", "éé", "u", "x", ""]
    v = spark.createDataFrame([(x,) for x in vocabulary], "term string")
    got = {r.word: r.pieces for r in lexicons.pieces(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()}
    assert got == {w: greedy(w.lower(), vocabulary, "##") for w in words}
    got = {r.word: r.pieces for r in lexicons.pieces(spark.createDataFrame([("abab",), ("Ab",)], "word string"), spark.createDataFrame([("ab",), ("a",), ("b",)], "term string"), "gpt2").collect()}
    assert got == {"abab": ["ab", "ab"], "Ab": None}


def test_static_word_vectors(spark):
    lexicon = spark.createDataFrame([("un", [1.0, 0.0]), ("##do", [3.0, 2.0]), ("x", [9.0, 9.0])], "term string, vector array<double>")
    words = spark.createDataFrame([("Undo",), ("zzz",), ("x",)], "word string")
    for how, want in (("mean", [2.0, 1.0]), ("first", [1.0, 0.0]), ("sum", [4.0, 2.0]), ("max", [3.0, 2.0])):
        got = {r.word: (r.vector, r.error) for r in lexicons.static_word_vectors(words, lexicon, 2, "bert", how).collect()}
        assert got == {"Undo": (want, None), "zzz": (None, "no pieces"), "x": ([9.0, 9.0], None)}
    with pytest.raises(Exception, match="no vector for zzz"):
        lexicons.corpus(spark.createDataFrame([("zzz",)], "term string"), lexicon, "raise").collect()


def test_layers(spark):
    d = spark.createDataFrame([("w", [[0.0, 0.0], [1.0, 2.0], [3.0, 6.0]])], "k string, layers array<array<double>>")
    assert [tuple(r) for r in Y.layer_rows(d, "layers").orderBy("layer").collect()] == [("w", 1, [1.0, 2.0]), ("w", 2, [3.0, 6.0])]
    pick = lambda x: d.select(lexicons.select_layer(F.col("layers"), x)).first()[0]
    assert pick("last") == pick(2) == [3.0, 6.0] and pick("average") == [4 / 3, 8 / 3] and pick("all") == [[0.0, 0.0], [1.0, 2.0], [3.0, 6.0]]
    for bad in (3, -1):
        with pytest.raises(Exception, match="out of range"):
            pick(bad)
    with pytest.raises(ValueError):
        lexicons.select_layer(F.col("layers"), "middle")


def test_target_of_a_text(spark):
    t = K.tokenize(spark.createDataFrame([(1, "A bank, banked. Bank")], "id int, text string"))
    at = lambda k, **m: Y.target_tokens(t, "bank", k, **m).first().indices
    assert [at(0), at(1), at(2)] == [[1], [3], [5]] and at(1, case_sensitive=True) == [3]
    for k, more in ((3, {}), (2, {"case_sensitive": True}), (-1, {})):
        with pytest.raises(Exception, match="occurrence out of range"):
            at(k, **more)
    long = K.tokenize(spark.createDataFrame([(1, "x " * 600 + "bank")], "id int, text string"))
    with pytest.raises(Exception, match="no token"):
        Y.target_tokens(long, "bank").collect()
    assert Y.target_tokens(long, "bank", model="gpt2").first().indices == [600]


# plans and answers


def test_feasibility():
    assert C.cap_feasibility(10, 3, 100) == {"feasible": False, "ceiling": 30, "needed_articles": 34, "needed_cap": 10}
    assert C.cap_feasibility(40, 3, 100)["feasible"] and C.cap_feasibility(5, None, 9)["feasible"] and C.cap_feasibility(0, 3, 9)["needed_cap"] is None
    assert C.strategies(1) == ["exhaustive", "random", "reservoir"] and "stratified" in C.strategies(2)
    with pytest.raises(ValueError, match="needs a number"):
        C.check(C.Config("x", n_documents=0))
    with pytest.raises(ValueError, match="unknown"):
        C.check(C.Config("x", occurrence_strategy="some"))
    C.check(C.Config("x"))


def test_counters_and_units(spark):
    from lexiloom.operators import units as U

    d = U.corpus(spark.read.parquet(f"{SF}/documents.parquet"))
    rows, seen = C.counted(d, "documents")
    assert rows.select("doc_id").collect() and seen.get["n_rows"] == 200
    c = C.Config("the", n_occurrences=7)
    assert C.sentence_or_document(d, "sentence", c).count() == 7 and C.sentence_or_document(d, "document", C.Config("the", n_occurrences=None)).count() == 200
    out = C.run(d, C.Config("the", n_documents=20, n_occurrences=9, per_document=2, min_distance=50, window="sentence"))
    assert out.count() == 9 and all(r.left + r.text + r.right for r in out.collect())


def test_answers():
    assert [T.decode_separator(x) for x in ("none", " Empty ", "ninguno", "\\n\\n", "--", "\\t")] == ["", "", "", "\n\n", "--", "\t"]
    assert [T.metadata_key(x) for x in ("skip", "NONE", "no", "-", "", " year ")] == [None] * 5 + ["year"]
    assert [T.entry_path(x) for x in ("a/b", " /a/ ", "a/../b", "")] == ["corpora/a/b", "corpora/a", "corpora/b", "corpora"]
    for bad in ("../x", "a/../../x", "..", "../corpora2"):
        with pytest.raises(ValueError):
            T.entry_path(bad)


def test_study(spark):
    from lexiloom.operators import similarity as S
    from lexiloom.operators import units as U
    from lexiloom.plans import study

    d = U.corpus(spark.read.parquet(f"{SF}/documents.parquet"))
    c = study.Config(C.Config("the", n_documents=30, n_occurrences=40, per_document=4, window="words", size=8))
    out = study.run(d, c)
    units = out["units"].collect()
    (a,) = out["analysis"].collect()
    assert len(units) == 40 == a.n and {r.aggregation for r in units} == {"mean_pooling"}
    x = np.array([r.vector for r in units])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = (x @ x.T)[np.triu_indices(40, 1)]
    assert np.isclose(a["mean"], sims.mean()) and np.isclose(a["std"], sims.std())
    for r in units:
        assert r.prepared[r.p_start : r.p_end].lower() == "the"
    assert len(study.MODELS) == 9 and out["contour"].count() == 40
    rows = out["units"].select(F.lit("w").alias("w"), F.concat_ws("|", "doc_id", "start").alias("i"), "vector")
    assert S.pairs(S.unit_rows(rows, "w", "i", "vector")).count() == 780


def test_pairs_in_blocks(spark, monkeypatch):
    from lexiloom.operators import similarity as S

    rng = np.random.default_rng(1)
    rows = [("a", i, rng.standard_normal(3).tolist()) for i in range(50)] + [("b", i, rng.standard_normal(3).tolist()) for i in range(3)] + [("c", 1, [1.0, 0.0, 0.0])]
    u = S.unit_rows(spark.createDataFrame(rows, "w string, k int, v array<double>"), "w", "k", "v")
    want = sorted((r.word, r.i, r.j, round(r.sim, 9)) for r in S.pairs(u).collect())
    assert len(want) == 50 * 49 // 2 + 3
    monkeypatch.setattr(S, "BLOCK", 7)
    assert sorted((r.word, r.i, r.j, round(r.sim, 9)) for r in S.pairs(u).collect()) == want
    m = {r.word: (r.n, r["mean"], r["std"]) for r in S.moments(u).collect()}
    for w in "ab":
        sims = [x[3] for x in want if x[0] == w]
        assert np.isclose(m[w][1], np.mean(sims)) and np.isclose(m[w][2], np.std(sims))
    assert set(m) == {"a", "b"}


def test_tokenizer_file(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["The quick é fox. 😀 <|endoftext|> China", "", None, "a  b"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, c0 int")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for r in K.tokenize_with(d, path).collect():
        e = t.encode(texts[r.id] or "", add_special_tokens=False)
        assert (r.tokens is None) == (texts[r.id] is None) and [(x.start, x.end, x.text) for x in r.tokens or []] == [(*o, x) for o, x in zip(e.offsets, e.tokens, strict=True)]


def test_bounded_stream(spark, tmp_path):
    from lexiloom.operators import sampling as P
    from lexiloom.streaming.reservoir import kept, progress, reservoir

    src = tmp_path / "in"
    for k in range(4):
        spark.range(k * 25, k * 25 + 25).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(src))
    for bound, name in ((None, "a"), (60, "b")):
        q = reservoir(stream, 10, ["id"], str(tmp_path / name), str(tmp_path / f"{name}-log"), 3, bound)
        q.awaitTermination()
        rows = sorted(r.id for r in kept(spark, str(tmp_path / name)).collect())
        assert len(rows) == 10 and len(progress(q)) == 4
        if bound is None:
            assert sum(n for _, n in progress(q)) == 100 and rows == sorted(r.id for r in P.reservoir(spark.range(100), 10, ["id"], 3).collect())
        else:
            assert spark.read.parquet(str(tmp_path / "b-seen")).agg(F.max("n")).first()[0] == 60
        assert len([p for p in (tmp_path / name).iterdir() if p.name.startswith("batch=")]) == 2


def test_groups_by_expression(spark):
    from lexiloom.operators import sampling as P

    d = spark.createDataFrame([(i, i * 7 % 50) for i in range(40)], "id long, start int")
    for out in (P.cap_per_group(d, 2, F.col("id") % 4, ["id"]), P.stratified(d, 8, F.col("id") % 4, ["id"]), P.cap_per_group_spaced(d, 2, F.col("id") % 4, ["id"], "start", 5)):
        rows = out.collect()
        assert out.columns == ["id", "start"] and len(rows) == 8 and sorted(r.id % 4 for r in rows) == [0, 0, 1, 1, 2, 2, 3, 3]


# Published rows of a pair study (chances in both spaces, correlations, CHSH 1 to 4), rounded to three places.
PUBLISHED = [
    ((1.003, 0.001, 0.003, 1.005, 0.051, 0.032, 0.055, 0.035), (0.015658517866638764, 0.015658517866638733), (1.009, 2.005, 1.004, 0.004)),
    ((1.007, 0.008, 0.009, 1.015, 0.094, 0.095, 0.095, 0.082), (0.02750181851409981, 0.027501818514099646), (1.017, 2.009, 1.036, 0.018)),
]


def test_identities_between_figures(spark):
    for p, (ab, ba), c in PUBLISHED:
        assert abs(p[0] - p[4] + p[6] + p[2] - c[0]) < 0.003 and abs(ab - ba) < 2e-15
    got = run(spark, "pair_study")
    assert np.allclose(got.p_aa_bb_s1 - got.p_aa_ba_s1 + got.p_ab_bb_s1 + got.p_ab_ba_s1, got.chsh_c1)
    assert np.allclose(got.p_aa_bb_s2 - got.p_aa_ba_s2 + got.p_ab_bb_s2 + got.p_ab_ba_s2, got.chsh_s2_c1)
    assert (abs(got.correlation - got.correlation_ba) < 2e-15).all() and (got.orthogonal == (got.max_correlation <= 0.01)).all()
    chances = got[[c for c in got.columns if c.startswith("p_")]].to_numpy()
    assert (chances >= 0).all() and (chances <= 1 + 1e-9).all()
    concepts = run(spark, "pair_concept_study")
    assert np.allclose(concepts.cosine, 1) and (concepts.error.isna()).all()
