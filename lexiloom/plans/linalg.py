"""Linear algebra on vector tables: distributed sums reduce any number of rows to width x width, the rest is small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gram(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, their sum, and the sum of their outer products. Only width^2 numbers reach the driver, whatever the rows."""

    def partial(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), float)
            if len(x):
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"i": range(len(s) + 1), "x": [np.r_[s, n].tolist(), *g.tolist()]})

    out = rows.select(vector).where(F.col(vector).isNotNull()).mapInPandas(partial, "i int, x array<double>")
    out = out.select("i", F.posexplode("x").alias("j", "y")).groupBy("i", "j").agg(F.sum("y").alias("y")).collect()
    if not out:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = max(r["i"] for r in out)
    s, g = np.zeros(d + 1), np.zeros((d, d))
    for r in out:
        if r["i"] == 0:
            s[r["j"]] = r["y"]
        else:
            g[r["i"] - 1, r["j"]] = r["y"]
    return round(s[d]), s[:d], g


def covariance(rows: DataFrame, vector: str) -> np.ndarray:
    """ddof 1; zeros for fewer than two rows."""
    n, s, g = gram(rows, vector)
    return (g - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros_like(g)


def pca(rows: DataFrame, vector: str, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explained-variance ratios, components (k x width) and mean."""
    n, s, g = gram(rows, vector)
    values, axes = np.linalg.eigh((g - np.outer(s, s) / n) / max(1, n - 1))
    order = np.argsort(-values)[: k or min(n, len(s))]
    total = values.sum()
    return np.maximum(values[order], 0) / (total if total > 0 else 1), axes[:, order].T, s / n


def singular_values(rows: DataFrame, vector: str) -> np.ndarray:
    _, _, g = gram(rows, vector)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))


def svd(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Thin SVD of the rows as a matrix: (key, vector) of left vectors, singular values, right vectors (as rows).

    The right ones come from the Gram matrix, and each row of the left ones from its own row alone.
    """
    from lexiloom.functions import vectors as V

    n, _, g = gram(rows, vector)
    values, axes = np.linalg.eigh(g)
    order = np.argsort(-values)[: min(n, len(values))]
    s, right = np.sqrt(np.maximum(values[order], 0)), axes[:, order].T
    turn = right / np.where(s > s.max(initial=0) * 1e-10, s, np.inf)[:, None]
    lit = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in turn])
    left = rows.where(F.col(vector).isNotNull()).select(key, F.transform(lit, lambda a: V.dot(a, F.col(vector).cast("array<double>"))).alias("vector"))
    return left, s, right


def feature_subspace(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, vector): PCA of the transposed matrix, whose k components of length 1 have a coordinate a row.

    A row is centred by its own mean; the components are the left singular vectors of the centred rows.
    """
    from lexiloom.functions import vectors as V

    v = F.col(vector).cast("array<double>")
    centred = rows.where(F.col(vector).isNotNull()).select(key, V.let(V.mean(v), lambda m: F.transform(v, lambda x: x - m)).alias("c"))
    left, _, _ = svd(centred, key, "c")
    return left.select(key, F.slice("vector", 1, k).alias("vector"))


def spectrum(matrix: np.ndarray, percent: float = 95) -> dict:
    """Eigenvalues of a symmetric matrix, largest first, their percentages and running sums, and the effective dimension."""
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    run = np.cumsum(values) / values.sum() * 100
    return {"eigenvalues": values, "percent": values / values.sum() * 100, "cumulative": run, "effective": int((run <= percent).sum()) + 1}


def determinant(rows: DataFrame, vector: str) -> float:
    """Of the covariance matrix."""
    return float(np.linalg.det(covariance(rows, vector)))


def correlation(rows: DataFrame, vector: str) -> np.ndarray:
    """Of the components over all rows; a constant component correlates with nothing."""
    c = covariance(rows, vector)
    sd = np.sqrt(np.diag(c))
    out = np.divide(c, np.outer(sd, sd), out=np.zeros_like(c), where=np.outer(sd, sd) > 0)
    np.fill_diagonal(out, 1.0)
    return out


def ratios(x: np.ndarray) -> np.ndarray:
    """Explained-variance ratios of z-scored columns, min(shape) - 1 of them."""
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    v = np.linalg.svd(z - z.mean(axis=0), compute_uv=False) ** 2
    return v[: min(x.shape) - 1] / v.sum()


def horn(spark: SparkSession, data: np.ndarray, simulations: int = 100, seed: int = 0) -> dict:
    """Parallel analysis: mean ratios of random data of the same shape, simulated by executors; ratios above are retained."""
    shape = data.shape

    def simulate(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, float(v)) for i in pdf["id"] for k, v in enumerate(ratios(np.random.default_rng(seed + int(i)).standard_normal(shape)))], columns=["k", "v"])

    mean = spark.range(simulations).mapInPandas(simulate, "k int, v double").groupBy("k").agg(F.avg("v").alias("v")).orderBy("k").collect()
    real, random = ratios(data), np.array([r["v"] for r in mean])
    return {"real": real, "random": random, "retain": int((real > random).sum())}


def horn_rows(rows: DataFrame, vector: str, simulations: int = 100, seed: int = 0) -> dict:
    """Parallel analysis of a table of any number of rows: neither it nor any random table of its size is ever in one place.

    The ratios of z-scored columns are the eigenvalues of their correlations, which come from Gram sums. The covariance of
    n rows of noise in d columns is a Wishart matrix of n - 1 degrees, drawn from its d x d triangular factor (of a table
    with no more rows than columns, whose factor is not square, noise of its own small size is drawn).
    """
    spark = rows.sparkSession
    n, _, _ = gram(rows, vector)
    c = correlation(rows, vector)
    d = len(c)
    keep = max(0, min(n, d) - 1)
    values = np.sort(np.maximum(np.linalg.eigvalsh(c), 0))[::-1] if d else np.zeros(0)

    def one(rng: np.random.Generator) -> np.ndarray:
        if n - 1 < d:
            x = rng.standard_normal((n, d))
            v = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
        else:
            a = np.tril(rng.standard_normal((d, d)), -1)
            a[np.diag_indices(d)] = np.sqrt(rng.chisquare(n - 1 - np.arange(d)))
            v = np.linalg.svd(a, compute_uv=False) ** 2
        return v[:keep] / v.sum()

    def simulate(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, float(v)) for i in pdf["id"] for k, v in enumerate(one(np.random.default_rng(seed + int(i))))], columns=["k", "v"])

    mean = spark.range(simulations).mapInPandas(simulate, "k int, v double").groupBy("k").agg(F.avg("v").alias("v")).orderBy("k").collect()
    real, random = values[:keep] / values.sum() if keep else values[:0], np.array([r["v"] for r in mean])
    return {"real": real, "random": random, "retain": int((real > random).sum())}


def subspace_scores(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """rows with `scores`: PCA scores of length 1 (NaN for a zero row)."""
    _, axes, mean = pca(rows, vector, k)
    lit = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in axes])
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    from lexiloom.functions import vectors as V

    s = V.let(centred, lambda c: F.transform(lit, lambda a: V.dot(a, c)))
    return rows.withColumn("scores", V.let(s, lambda v: V.let(V.l2(v), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(V.NAN)).otherwise(x / F.when(n != 0, n))))))


def describe(rows: DataFrame, term: str, vector: str, components: np.ndarray, top: int = 10) -> DataFrame:
    """(dimension, rank, term, score): the terms of the greatest raw product with each component."""
    from pyspark.sql import Window as W

    from lexiloom.functions import vectors as V

    lit = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in components])
    scored = rows.select(F.col(term).alias("term"), F.posexplode(F.transform(lit, lambda a: V.dot(a, F.col(vector).cast("array<double>")))).alias("dimension", "score"))
    rank = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


# Pair study: subspaces are k x d arrays of unit rows

def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan, dtype=float), where=n != 0)


def projector(space: np.ndarray) -> np.ndarray:
    return space.T @ space


def quantum_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """trace(rho_A rho_B) as a squared product of component rows, without a matrix root."""
    return float(((a @ b.T) ** 2).sum() / (len(a) * len(b)))


def quantum_correlations(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Both orders; equal but for rounding."""
    return quantum_correlation(a, b), quantum_correlation(b, a)


def orthogonality(a: np.ndarray, b: np.ndarray, most: float = 0.01) -> tuple[bool, float]:
    """Whether the rows of both product spaces are uncorrelated, and the largest correlation off the diagonal."""
    worst = 0.0
    for space in entangle(a, b, reorthogonalize=False):
        if len(space) > 1:
            r = np.corrcoef(space)
            worst = max(worst, float(np.abs(r[~np.eye(len(r), dtype=bool)]).max()))
    return worst <= most, worst


def project(space: np.ndarray, v: np.ndarray) -> np.ndarray:
    return unit(space.T @ (space @ unit(v)))


def gram_schmidt(rows: np.ndarray) -> np.ndarray:
    """Orthonormal rows of a copy; a dependent row becomes zero."""
    out = np.array(rows, float)
    for i in range(len(out)):
        for j in range(i):
            out[i] -= (out[i] @ out[j]) * out[j]
        n = np.linalg.norm(out[i])
        out[i] = out[i] / n if n > 1e-12 else 0
    return out


def entangle(a: np.ndarray, b: np.ndarray, reorthogonalize: bool = True) -> tuple[np.ndarray, ...]:
    """Row-normalised Kronecker products in both orders, and their orthonormal forms."""
    one, two = unit(np.kron(a, b)), unit(np.kron(b, a))
    return (one, two, gram_schmidt(one), gram_schmidt(two)) if reorthogonalize else (one, two)


def expectation(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """|S (x (x) y)|^2 for S the normalised product of a and b, in factors: no product is formed."""
    return float((unit(a) @ unit(x)) @ (unit(a) @ unit(x)) * ((unit(b) @ unit(y)) @ (unit(b) @ unit(y))))


def chsh(e, aA, bB, aB, bA) -> tuple[float, float, float, float]:
    """The four configurations of a function e of two projected words."""
    return (
        e(aA, bB) - e(aA, bA) + e(aB, bB) + e(aB, bA),
        e(aA, bB) - e(aA, aB) + e(bA, bB) + e(bA, aB),
        e(bB, aA) - e(bB, aB) + e(bA, aA) + e(bA, aB),
        e(bB, aA) - e(bB, bA) + e(aB, aA) + e(aB, bA),
    )


def bg_chsh(va: np.ndarray, vb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[float, ...]:
    """CHSH over squared cosines of the coordinates of two words in two subspaces, rounded to 3."""
    at = lambda s, v: unit(s @ v)
    e = lambda x, y: float((x @ y) ** 2)
    return tuple(round(x, 3) for x in chsh(e, at(sa, va), at(sb, vb), at(sb, va), at(sa, vb)))


#: Correlations in both orders, cosine, CHSH of coordinates, the chances of the four pairs of projections in both product spaces
#: (S1: a then b, S2: b then a), CHSH in both, and the largest correlation of rows of those spaces.
PAIR_FIGURES = (
    "correlation", "correlation_ba", "cosine", *[f"bg_c{i}" for i in range(1, 5)], *[f"p_{x}_{s}" for x in ("aa_bb", "ab_ba", "aa_ba", "ab_bb") for s in ("s1", "s2")],
    *[f"chsh_c{i}" for i in range(1, 5)], *[f"chsh_s2_c{i}" for i in range(1, 5)], "max_correlation",
)


def grams_by_word(contours: DataFrame) -> DataFrame:
    """(word, n, s, g): rows, their sum and the flat sum of their outer products of each word, however large its contour.

    Each task adds up what it holds of a word, one row a word and task meets another, and those are added element by element.
    """
    kind = contours.schema["word"].dataType.simpleString()

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for word, group in pdf.groupby("word", sort=False):
                x = np.array(group["vector"].tolist(), float)
                mine = np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]
                held[word] = held[word] + mine if word in held else mine
                if len(held) > 256:
                    yield pd.DataFrame({"word": list(held), "x": [v.tolist() for v in held.values()]})
                    held = {}
        if held:
            yield pd.DataFrame({"word": list(held), "x": [v.tolist() for v in held.values()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"word": [pdf["word"].iloc[0]], "x": [np.sum(np.array(pdf["x"].tolist()), axis=0).tolist()]})

    some = contours.select("word", "vector").where("word is not null and vector is not null").mapInPandas(partial, f"word {kind}, x array<double>")
    return some.groupBy("word").applyInPandas(total, f"word {kind}, x array<double>")


def contour_spaces(contours: DataFrame, k: int) -> DataFrame:
    """(word, space): the k principal axes of each word's contour, flat; from Gram sums, so no contour meets in one task."""
    kind = contours.schema["word"].dataType.simpleString()

    def axes(batches):
        for pdf in batches:
            out = []
            for x in pdf["x"]:
                x = np.asarray(x, float)
                d = round(((4 * len(x) - 3) ** 0.5 - 1) / 2)
                n, s, g = x[0], x[1 : d + 1], x[d + 1 :].reshape(d, d)
                values, vectors = np.linalg.eigh(g - np.outer(s, s) / n)
                out.append(vectors[:, np.argsort(-values)[: min(k, int(n), d)]].T.ravel().tolist())
            yield pd.DataFrame({"word": pdf["word"], "space": out})

    return grams_by_word(contours).mapInPandas(axes, f"word {kind}, space array<double>")


def pair_study(pairs: DataFrame, contours: DataFrame, lexicon: DataFrame, k: int = 2) -> DataFrame:
    """(word_a, word_b), (word, vector) rows and (word, vector) -> correlation, cosine and CHSH of each pair.

    A word's contour becomes its k components from distributed sums; pairs meet them by two equi-joins and are judged row
    by row, a pair that fails having its error in a column. With a column `concept`, the contours are those of the two
    words and the concept's vector is projected in the place of both.
    """
    kind = contours.schema["word"].dataType.simpleString()
    spaces = contour_spaces(contours, k)
    by_concept = "concept" in pairs.columns
    rows = pairs
    if by_concept:
        rows = rows.join(lexicon.select(F.col("word").alias("concept"), F.col("vector").alias("va")), "concept").withColumn("vb", F.col("va"))
    else:
        spaces = spaces.join(lexicon, "word")
    for s in "ab":
        own = [] if by_concept else [F.col("vector").alias(f"v{s}")]
        rows = rows.join(spaces.select(F.col("word").alias(f"word_{s}"), F.col("space").alias(f"s{s}"), *own), f"word_{s}")

    def figures_of(sa, sb, va, vb) -> tuple:
        first, second = (lambda x, y: expectation(sa, sb, x, y)), (lambda x, y: expectation(sb, sa, x, y))
        aa, bb, ab, ba = project(sa, va), project(sb, vb), project(sb, va), project(sa, vb)
        chances = [e(x, y) for x, y in ((aa, bb), (ab, ba), (aa, ba), (ab, bb)) for e in (first, second)]
        fine, worst = orthogonality(sa, sb)
        return (*quantum_correlations(sa, sb), float(unit(va) @ unit(vb)), *bg_chsh(va, vb, sa, sb), *chances, *chsh(first, aa, bb, ab, ba), *chsh(second, aa, bb, ab, ba), worst, fine)

    def judge(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    va, vb = np.array(r.va, float), np.array(r.vb, float)
                    sa, sb = (np.array(x, float).reshape(-1, len(va)) for x in (r.sa, r.sb))
                    out.append((r.word_a, r.word_b, *figures_of(sa, sb, va, vb), None))
                except Exception as x:  # a pair that fails is told and does not stop the others
                    out.append((r.word_a, r.word_b, *[None] * (len(PAIR_FIGURES) + 1), str(x)))
            yield pd.DataFrame(out, columns=["word_a", "word_b", *PAIR_FIGURES, "orthogonal", "error"])

    figures = ", ".join(f"{c} double" for c in PAIR_FIGURES)
    return rows.mapInPandas(judge, f"word_a {kind}, word_b {kind}, {figures}, orthogonal boolean, error string")
