"""Study figures on small inputs worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import vectors as V
from lexiloom.operators import similarity as S
from lexiloom.operators import study


def test_block_means_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.standard_normal(4).tolist()) for i in range(20)] + [(20, 9, [1.0, 0.0, 0.0, 0.0])]
    u = S.unit_rows(spark.createDataFrame(rows, "i int, w int, v array<double>"), "w", "i", "v")
    got = {(r.a, r.b): (r.n, r.mean) for r in study.block_means(u, 4).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    assert (9, 9) not in got and len(got) == 9  # a word of one vector has no pair of its own
    for (a, b), (n, mean) in got.items():
        sims = [unit[i] @ unit[j] for i, x, _ in rows for j, y, _ in rows if (x, y) == (a, b) and (a != b or i < j)]
        assert n == len(sims) and abs(mean - np.mean(sims)) < 1e-12
    assert study.block_means(u.limit(0), 4).count() == 0


def test_ties_go_to_the_first(spark):
    p = spark.createDataFrame([("w", 1, 2, 0.5), ("w", 1, 3, 0.5), ("w", 2, 3, 0.5)], "word string, i int, j int, sim double")
    (r,) = study.extreme_pairs(p).collect()
    assert (r.large_i, r.large_j, r.small_i, r.small_j, r.largest, r.smallest) == (1, 2, 1, 2, 0.5, 0.5)
    a = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 1.0)], "layer int, mean double")
    (r,) = study.layer_differences(a, a.withColumn("mean", F.col("mean") + 1)).collect()
    assert tuple(r) == (1.0, 1.0, 0, 1.0, 0)


def test_ranking_and_spectrum(spark):
    layers = spark.createDataFrame([(0, 1.0, 0.03), (1, -1.0, 0.005), (2, 1.0, 0.2), (3, 1.0, 0.015)], "layer int, mean double, std double")
    got = [(r.layer, r.rank, r.label) for r in study.stability(layers).orderBy("rank").collect()]
    assert got == [(1, 1, "very stable"), (3, 2, "stable"), (0, 3, "moderate"), (2, 4, "variable")]
    shares = spark.createDataFrame([(0, 10.0), (1, 60.0), (2, 30.0)], "dim int, share double")
    got = [(r.dim, r.cumulative, r.effective) for r in study.cumulative(shares, "share", "dim").orderBy("cumulative").collect()]
    assert got == [(1, 60.0, 3), (2, 90.0, 3), (0, 100.0, 3)]


def test_norms_and_mahalanobis(spark):
    d = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    n = [r.n for r in d.select(study.complex_norms(F.col("a"), F.col("b")).alias("n")).collect()]
    assert (n[0].re, n[0].im, n[0].total, n[1].ratio) == (3.0, 4.0, 5.0, None)
    inverse = np.array([[2.0, 0.5], [0.5, 1.0]])
    got = [r.x for r in d.select(V.mahalanobis(F.col("a"), F.col("b"), inverse.tolist()).alias("x")).collect()]
    want = [np.sqrt(x @ inverse @ x) for x in (np.array([3.0, -4.0]), np.array([-1.0, 0.0]))]
    assert np.allclose(got, want)
