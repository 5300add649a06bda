"""Pairs in cells of blocks against all pairs by a join, with equal vectors, zero vectors and words of one vector."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V
from lexiloom.operators import cells as C
from lexiloom.operators import layers as Y
from lexiloom.operators import similarity as S
from lexiloom.operators import study


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    v = lambda: rng.standard_normal(5).tolist()
    same = v()
    rows = [("a", i, v()) for i in range(40)] + [("dup", i, same if i % 3 else v()) for i in range(30)] + [("equal", i, same) for i in range(6)] + [("one", 1, v()), ("two", 4, v()), ("two", 9, v())]
    rows += [("zero", i, [0.0] * 5 if i == 3 else v()) for i in range(12)] + [("grid", i, rng.integers(-1, 2, 5).astype(float).tolist()) for i in range(25)] + [(None, 1, v()), ("nokey", None, v()), ("nokey", 2, v())]
    return S.unit_rows(spark.createDataFrame(rows, "w string, i long, v array<double>"), "w", "i", "v").cache()


@pytest.fixture(scope="module")
def every(units):
    a, b = (units.select("word", F.col("idx").alias(i), F.col("u").alias(u)) for i, u in (("i", "x"), ("j", "y")))
    return a.join(b, "word").where("i < j").select("word", "i", "j", V.dot(F.col("x"), F.col("y")).alias("sim")).cache()


def same(a, b):
    key = lambda r: tuple(f"{x:.7f}" if isinstance(x, float) else str(x) for x in r)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and (np.isnan(p) and np.isnan(q) or abs(p - q) < 2e-8)), (x, y)


@pytest.fixture(params=[3, 7, 2048])
def blocks(request, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", request.param)
    monkeypatch.setattr(S, "TERMS", request.param)


def test_pairs_are_those_of_a_join_to_the_last_bit(units, every, blocks):
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(S.pairs(units)) == text(every)
    for places in (3, 8):
        assert text(S.pairs(units, places)) == text(every.withColumn("sim", F.round("sim", places)))


def test_statistics_are_those_of_a_join(units, every, blocks):
    agg = every.groupBy("word").agg(F.count("*"), F.avg("sim"), F.stddev_pop("sim"), F.min("sim").alias("a"), F.max("sim").alias("b"), F.median("sim"), F.var_pop("sim"))
    same(S.stats(units), agg.withColumn("range", F.col("b") - F.col("a")))


def test_boxes_are_those_of_a_join(units, every, blocks):
    q = [F.percentile("sim", F.lit(p)) for p in (0.25, 0.5, 0.75)]
    same(S.box(units), every.groupBy("word").agg(F.min("sim"), *q, F.max("sim")))


def test_histograms_are_those_of_a_join(units, every, blocks):
    p = every.withColumn("sim", F.round("sim", 6))
    p = p.join(p.groupBy("word").agg(F.min("sim").alias("lo"), F.max("sim").alias("hi")), "word")
    wide = F.col("hi") > F.col("lo")
    at = F.when(wide, F.least(F.floor((F.col("sim") - F.col("lo")) / F.when(wide, F.col("hi") - F.col("lo")) * 20), F.lit(19))).otherwise(0).cast("int")
    want = p.where("word <> 'zero'").groupBy("word", at.alias("bin")).agg(F.min(F.col("lo") + at * (F.col("hi") - F.col("lo")) / 20), F.count("*"))
    same(S.histogram(units).where("word <> 'zero'"), want)
    assert S.histogram(units).where("word = 'zero'").agg(F.sum("n")).first()[0] == 66


def test_extreme_pairs_are_those_of_a_join(units, every, blocks):
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(study.extreme_pairs(S.end_pairs(units))) == text(study.extreme_pairs(every))


def test_agreement_without_pairs_is_that_of_pairs(units, every):
    model, kind = (lambda c: F.col(c) % 2), (lambda c: F.col(c) % 4 >= 2)
    few = lambda df: df.where("word <> 'zero'")
    cells = few(every).select(model("i").alias("model_a"), kind("i").alias("kind_a"), model("j").alias("model_b"), kind("j").alias("kind_b"), F.col("sim").alias("r"))
    same(Y.agreement(few(units), model("idx"), kind("idx"), 5), Y.model_agreement(cells))
    assert tuple(Y.agreement(units.limit(0), model("idx"), kind("idx"), 5).first()) == (None, None, None)


def test_nearest_terms_are_those_of_a_join(units, blocks):
    terms = units.where("word = 'grid' or word = 'zero'").select((F.col("idx") + F.when(F.col("word") == "grid", 0).otherwise(100)).alias("term"), "u")
    q = terms.where("term % 4 = 0")
    p = terms.crossJoin(q.select(F.col("term").alias("query"), F.col("u").alias("q"))).where("term <> query").select("query", "term", V.dot(F.col("u"), F.col("q")).alias("sim"))
    p.createOrReplaceTempView("every_term")
    want = p.sparkSession.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, term) AS rank FROM every_term) WHERE rank <= 5")
    assert sorted(map(repr, S.nearest(terms, q, 5).collect())) == sorted(map(repr, want.collect()))


def test_a_tile_does_not_grow_with_the_block():
    n = 3000
    x = np.random.default_rng(0).standard_normal((n, 4))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(x.ravel()))
    cell = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(range(n)), flat], names=["mine", "idx", "u"])
    got = list(C.tiles([cell]))
    assert max(t.s.size for t in got) <= C.TILE and sum(int(t.pair.sum()) for t in got) == n * (n - 1) // 2


def test_vectors_of_other_widths_have_no_similarity(spark):
    rows = [("w", 1, [1.0, 0.0]), ("w", 2, [0.0, 1.0]), ("w", 3, [1.0]), ("w", 4, [1.0, None])]
    u = spark.createDataFrame(rows, "word string, idx int, u array<double>")
    assert sorted((r.i, r.j, r.sim) for r in S.pairs(u).collect()) == [(1, 2, 0.0), (1, 3, None), (1, 4, None), (2, 3, None), (2, 4, None), (3, 4, None)]
    assert [(r.n_pairs, r["min"], r["median"]) for r in S.stats(u).collect()] == [(6, 0.0, 0.0)]
