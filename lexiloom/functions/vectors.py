"""Vector functions over array<double>: native folds, no user functions. Divisions are guarded, since ANSI mode raises."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, s: float) -> Column:
    return F.transform(v, lambda x: x * s)


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l1(v: Column) -> Column:
    return total(F.transform(v, F.abs))


def linf(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def _over(a: Column, b: Column, other: float) -> Column:
    return F.when(b == 0, F.lit(other)).otherwise(a / F.when(b != 0, b))


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, and not again for each element of a lambda inside f."""
    return F.get(F.transform(F.array(value), f), 0)


def unit(v: Column) -> Column:
    """A zero vector stays."""
    return let(l2(v), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / F.when(n != 0, n))))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std(v: Column) -> Column:
    return let(mean(v), lambda m: F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))


def zscore(v: Column) -> Column:
    return let(F.struct(mean(v).alias("m"), std(v).alias("s")), lambda k: F.transform(v, lambda x: _over(x - k["m"], k["s"], 0.0)))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """zero: the value where a norm is 0 (NaN for contours)."""
    return _over(dot(a, b), l2(a) * l2(b), zero)


def euclidean(a: Column, b: Column) -> Column:
    return l2(subtract(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return l1(subtract(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return linf(subtract(a, b))


def minkowski(a: Column, b: Column, p: float = 2) -> Column:
    d = F.transform(subtract(a, b), F.abs)
    if p == math.inf:
        return F.array_max(d)
    if p == -math.inf:
        return F.array_min(d)
    if p == 0:
        return F.size(F.filter(d, lambda x: x != 0)).cast("double")
    return F.pow(total(F.transform(d, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def weighted_minkowski(a: Column, b: Column, w: Column | None = None, p: float = 2) -> Column:
    d = F.transform(subtract(a, b), lambda x: F.pow(F.abs(x), F.lit(float(p))))
    return F.pow(total(d if w is None else F.zip_with(d, w, lambda x, y: x * y)), F.lit(1.0 / p))


def mahalanobis(a: Column, b: Column, inverse: list[list[float]]) -> Column:
    """inverse: pseudo-inverse of a covariance matrix, of the vectors' own width."""
    d = subtract(a, b)
    rows = F.array(*[F.array(*map(F.lit, r)) for r in inverse])
    return F.sqrt(F.greatest(F.lit(0.0), dot(d, F.transform(rows, lambda r: dot(r, d)))))


def hellinger(p: Column, q: Column) -> Column:
    root = lambda v: F.transform(v, lambda x: F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(F.abs(x))))
    return l2(subtract(root(p), root(q))) / math.sqrt(2)


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.greatest(x, F.lit(eps)) * F.ln(F.greatest(x, F.lit(eps)) / F.greatest(y, F.lit(eps)))))


def angular(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / math.pi


def jaccard(a: Column, b: Column) -> Column:
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    some = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(some == 0, 0.0).otherwise(both / F.when(some != 0, some))


def pearson(a: Column, b: Column) -> Column:
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(F.struct(centred(a).alias("x"), centred(b).alias("y")), lambda k: _over(dot(k["x"], k["y"]), l2(k["x"]) * l2(k["y"]), 0.0))


def complex_cosine(re1: Column, im1: Column, re2: Column, im2: Column) -> Column:
    n1, n2 = F.sqrt(dot(re1, re1) + dot(im1, im1)), F.sqrt(dot(re2, re2) + dot(im2, im2))
    return _over(dot(re1, re2) + dot(im1, im2), n1 * n2, 0.0)


def analogy(a: Column, b: Column, c: Column) -> Column:
    return add(subtract(a, b), c)


def positional(position: Column, width: int) -> Column:
    """sin over [0, 2 pi p] in equal steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.sin(2 * math.pi * position * i / max(1, width - 1)))


def pool(vectors: Column, how: str, width: int) -> Column:
    """One vector of an array of vectors: mean, first, sum or max; null of none."""
    if how not in ("mean", "first", "sum", "max"):
        raise ValueError("aggregation must be mean, first, sum or max")
    if how == "first":
        return F.get(vectors, 0)
    f = (lambda s, x: F.greatest(s, x)) if how == "max" else (lambda s, x: s + x)
    zero = F.array_repeat(F.lit(float("-inf") if how == "max" else 0.0), width)
    out = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, f))
    out = F.transform(out, lambda x: x / F.size(vectors)) if how == "mean" else out
    return F.when(F.size(vectors) > 0, out)


def mean_vector(column: str, width: int) -> Column:
    """Aggregate: element-wise mean over rows, by partial sums of each component."""
    return F.array(*[F.avg(F.get(F.col(column), i)) for i in range(width)])


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
