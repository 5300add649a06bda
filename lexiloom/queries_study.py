"""Registered queries of vector studies (distances, layers, blocks, spectra) and of token texts; and their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import similarity as S
from lexiloom.operators import study
from lexiloom.plans import linalg
from lexiloom.queries_vectors import _E, _L, _P, _U, _rounded, both, emb, units


def _mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each vector to the next, under the pseudo-inverse of the covariance of all."""
    inverse = np.linalg.pinv(linalg.covariance(emb(spark, sf), "v"))
    return both(spark, sf).select("vec_id", F.round(V.mahalanobis(F.col("a"), F.col("b"), inverse.tolist()), 6).alias("value"))


def _complex_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of each vector as real part, the second as imaginary."""
    v = F.col("v")
    norms = study.complex_norms(F.slice(v, 1, 32), F.slice(v, 33, 32))
    return _rounded(emb(spark, sf).select("vec_id", norms.alias("n")).select("vec_id", "n.*"), "re", "im", "total", "ratio")


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    return S.layer_stats(units(spark, sf))


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    half = lambda a: S.layer_stats(S.unit_rows(e.select("vec_id", "label", F.slice("v", a, 32).alias("v")), "label", "vec_id", "v"))
    return _rounded(study.layer_differences(half(1), half(33)), "mean", "max", "min")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


_HALVES = _E + """, h AS (SELECT label, vec_id, k, v[k * 32 + 1 : k * 32 + 32] AS w FROM e, (SELECT unnest([0, 1]) AS k)),
u AS (SELECT label, vec_id, k, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM h),
l AS (SELECT x.k, x.label AS layer, avg(list_inner_product(x.u, y.u)) AS mean FROM u x JOIN u y ON x.k = y.k AND x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.k, x.label),
d AS (SELECT b.layer, b.mean - a.mean AS d FROM l a JOIN l b ON a.k = 0 AND b.k = 1 AND a.layer = b.layer)"""

_SPEC: dict[str, tuple] = {
    "dist_mahalanobis": (_mahalanobis, None),
    "complex_norms": (
        _complex_norms,
        _E + """, n AS (SELECT vec_id, list_inner_product(v[1:32], v[1:32]) AS a, list_inner_product(v[33:64], v[33:64]) AS b FROM e)
SELECT vec_id, round(sqrt(a), 8) AS re, round(sqrt(b), 8) AS im, round(sqrt(a + b), 8) AS total, round(sqrt(b) / sqrt(a), 8) AS ratio FROM n""",
    ),
    "stability_ranking": (
        lambda s, d: _rounded(study.stability(_layers(s, d)), "cv"),
        _L + """ SELECT layer, round(std / mean, 8) AS cv, row_number() OVER (ORDER BY abs(std / mean), layer)::INTEGER AS rank,
CASE WHEN abs(std / mean) < 0.01 THEN 'very stable' WHEN abs(std / mean) < 0.02 THEN 'stable' WHEN abs(std / mean) < 0.05 THEN 'moderate' ELSE 'variable' END AS label FROM l""",
    ),
    "extreme_pairs": (
        lambda s, d: _rounded(study.extreme_pairs(S.end_pairs(units(s, d))), "largest", "smallest"),
        _P + """ SELECT DISTINCT word, first_value(i) OVER a AS large_i, first_value(j) OVER a AS large_j, round(first_value(sim) OVER a, 8) AS largest,
first_value(i) OVER b AS small_i, first_value(j) OVER b AS small_j, round(first_value(sim) OVER b, 8) AS smallest
FROM p WINDOW a AS (PARTITION BY word ORDER BY sim DESC, i, j), b AS (PARTITION BY word ORDER BY sim, i, j)""",
    ),
    "layer_differences": (
        _differences,
        _HALVES + """ SELECT round(avg(d), 8) AS mean, round(max(d), 8) AS max, arg_max(layer, d) AS max_layer, round(min(d), 8) AS min, arg_min(layer, d) AS min_layer FROM d""",
    ),
    "series_correlation": (
        lambda s, d: _layers(s, d).agg(F.round(F.corr("mean", "std"), 8).alias("r")),
        _L + " SELECT round(corr(mean, std), 8) AS r FROM l",
    ),
    "block_means": (
        lambda s, d: _rounded(study.block_means(units(s, d), 64), "mean"),
        _U + """, m AS (SELECT x.word AS a, y.word AS b, avg(list_inner_product(x.u, y.u)) AS mean, count(*) AS n FROM u x JOIN u y
ON (x.word < y.word) OR (x.word = y.word AND x.idx < y.idx) GROUP BY ALL) SELECT a, b, n, round(mean, 8) AS mean FROM m""",
    ),
    "cumulative_variance": (
        lambda s, d: _rounded(study.cumulative(_spread(s, d), "share", "dim"), "share", "cumulative"),
        _E + """, x AS (SELECT unnest(range(64))::INTEGER AS dim, unnest(v) AS x FROM e), q AS (SELECT dim, var_samp(x) AS v FROM x GROUP BY dim),
s AS (SELECT dim, 100 * v / sum(v) OVER () AS share FROM q), c AS (SELECT *, sum(share) OVER (ORDER BY share DESC, dim) AS cumulative FROM s)
SELECT dim, round(share, 8) AS share, round(cumulative, 8) AS cumulative, (SELECT count(*) FROM c WHERE cumulative <= 95) + 1 AS effective FROM c""",
    ),
    "distinct_sources": (
        lambda s, d: _documents(s, d).select("source", "lang").distinct(),
        "SELECT DISTINCT source, lang FROM documents",
    ),
    "keep_last": (
        lambda s, d: _documents(s, d).groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars")),
        "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
    ),
    "clean_tokens": (
        lambda s, d: _documents(s, d).select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).select(T.clean_token(F.col("w")).alias("token")).where("token <> ''").groupBy("token").count(),
        r"SELECT token, count(*) AS count FROM (SELECT regexp_replace(lower(w), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]', '', 'g') AS token FROM (SELECT unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents)) WHERE token <> '' GROUP BY token",
    ),
    "marked_target": (
        lambda s, d: _documents(s, d).where("text is not null").select("doc_id", F.md5(T.mark(F.split("text", r"[\x20\x09-\x0D]+"), F.lit(2)).cast("binary")).alias("marked")),
        r"SELECT doc_id, md5(array_to_string(list_transform(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w, i: CASE WHEN i = 3 THEN '[TARGET]' || w || '[/TARGET]' ELSE w END), ' ')) AS marked FROM documents WHERE text IS NOT NULL",
    ),
    "short_lists": (
        lambda s, d: _documents(s, d).groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("x")).select("lang", T.short_list(F.col("x"), 2).alias("sources")),
        "SELECT lang, array_to_string(x[1:2], ', ') || CASE WHEN len(x) > 2 THEN '...' ELSE '' END AS sources FROM (SELECT lang, list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS x FROM documents GROUP BY lang)",
    ),
}


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Each dimension's share of the total variance, in percent: dim, share."""
    dims = emb(spark, sf).agg(F.array(*[F.var_samp(F.get("v", F.lit(i))) for i in range(64)]).alias("v"))
    return dims.select(V.total(F.col("v")).alias("t"), F.posexplode("v").alias("dim", "x")).select("dim", (100 * F.col("x") / F.col("t")).alias("share"))


def queries() -> dict:
    return {k: x[0] for k, x in _SPEC.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x[1] for k, x in _SPEC.items() if x[1]}
