"""TF-IDF in chunks of documents against its definition."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.plans import lsa as A


def want(rows, min_df=1, use_idf=True):
    tf = {}
    for d, text in rows:
        tf.setdefault(d, Counter()).update(w for w in (text or "").split() if len(w) > 1)
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for d, c in tf.items():
        w = {t: k * (np.log((1 + len(rows)) / (1 + df[t])) + 1 if use_idf else 1) for t, k in c.items() if df[t] >= min_df}
        norm = np.sqrt(sum(x * x for x in w.values()))
        out |= {(d, t): x / norm for t, x in w.items()}
    return out


@pytest.mark.parametrize("args", [{}, {"min_df": 2}, {"use_idf": False}])
def test_weights_with_repeated_and_empty_documents(spark, args):
    rng = np.random.default_rng(4)
    rows = [(int(i % 17), " ".join(f"w{x}" for x in rng.integers(0, 30, 12))) for i in range(40)] + [(50, None), (51, ""), (52, "x y"), (53, "only")]
    got = {(r.doc_id, r.term): r.w for r in A.tfidf(spark.createDataFrame(rows, "doc_id int, text string"), **args).collect()}
    assert got == pytest.approx(want(rows, **args))


@pytest.mark.parametrize("most", [1, 10, 100])
def test_chunks_hold_whole_documents_and_are_bounded(most):
    rows = [(i // 3, [f"w{(i * k) % 7}" for k in range(i % 5)]) for i in range(90)]
    batches = [(pa.array([d for d, _ in part]), pa.array([w for _, w in part], pa.list_(pa.string()))) for part in (rows[:50], rows[50:])]
    monkey = [(x.slice(k, 1), y.slice(k, 1)) for x, y in batches for k in range(len(x))]
    chunks = list(A._chunks(iter(monkey), most))
    assert [d for ids, *_ in chunks for d in ids.to_pylist()] == list(range(30))
    got = Counter()
    for ids, terms, d, t, tf in chunks:
        assert tf.sum() <= most + 12 and len(set(t.tolist())) == len(terms)
        got.update({(ids[int(i)].as_py(), terms[int(k)].as_py()): int(c) for i, k, c in zip(d, t, tf, strict=True)})
    assert got == Counter((d, w) for d, ws in rows for w in ws)


def test_no_row_a_document_and_term_is_shuffled(spark):
    plan = A.tfidf(spark.createDataFrame([(1, "aa bb")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(places" in plan and plan.count("Generate") == 1


def test_lsa_reads_its_weights_once(spark):
    """Every product computed the weights anew, with the whole TF-IDF below it."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    w = A.tfidf(spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (3, "cc dd ee")], "doc_id int, text string"))
    _, _, s = A.lsa(w.mapInArrow(counted, w.schema), 2, 1, 2)
    assert len(s) == 2 and seen.value == 7 and w.agg(F.count("*")).first()[0] == 7
