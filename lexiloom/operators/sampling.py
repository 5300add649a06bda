"""Reproducible sampling: rows ordered by the MD5 of seed and key, so every engine and partitioning picks the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def random(units: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows (all, if fewer): a distributed top-n, no global sort."""
    return units.orderBy(order(seed, *key), *key).limit(n)


reservoir = random  # of a finite table; streaming.reservoir takes an unbounded one


def _keyed(units: DataFrame, group: str | Column) -> tuple[DataFrame, str]:
    """Units with a group that may be any expression as a column."""
    return (units, group) if isinstance(group, str) else (units.withColumn("__group", group), "__group")


def cap_per_group(units: DataFrame, most: int, group: str | Column, key: list[str], seed: int = 0) -> DataFrame:
    """At most `most` rows a group; no task sends more than that of a group."""
    units, group = _keyed(units, group)
    w = W.partitionBy(group).orderBy(order(seed, *key), *key)
    return units.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n", "__group")


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the columns of a, then the others of b."""
    b = b.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(on)})
    test = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{i}"]) for i, c in enumerate(on)])
    return a.join(b, test, how).drop(*[f"__{i}" for i in range(len(on))])


def stratified(units: DataFrame, n: int, group: str | Column, key: list[str], seed: int = 0) -> DataFrame:
    """floor(n * share) rows of each group (null is one), and the rest at random from all rows not chosen; key tells rows apart.

    No group is ranked whole: each task sends the first n of a group at most, as a quota is never above n. The rest come
    from the first 2n rows of another order, since at most n of those are chosen already.
    """
    units, group = _keyed(units, group)
    sizes = units.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__total"))
    quota = sizes.crossJoin(F.broadcast(total)).select(group, F.when(F.col("__total") <= n, F.col("__size")).otherwise(F.floor(F.lit(n) * F.col("__size") / F.col("__total"))).alias("__quota"))
    ranked = units.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(order(seed, *key), *key))).where(F.col("__n") <= n)
    chosen = _same(ranked, quota, [group]).where(F.col("__n") <= F.col("__quota")).drop("__n", "__quota")
    rest = _same(units.orderBy(order(seed + 1, *key), *key).limit(2 * n), chosen.select(*key), key, "left_anti").withColumn("__first", F.lit(1))
    both = chosen.withColumn("__first", F.lit(0)).unionByName(rest)
    return both.orderBy("__first", order(seed + 1, *key), *key).limit(n).drop("__first", "__group")


def cap_per_group_spaced(units: DataFrame, most: int, group: str | Column, key: list[str], start: str = "start", distance: int = 500, seed: int = 0) -> DataFrame:
    """At most `most` rows a group, spaced by start: greedy over a fresh order at each level distance, distance / 2, ..., 0."""
    units, group = _keyed(units, group)
    levels, d = [], distance
    while d > 0:
        levels.append(d)
        d //= 2
    levels.append(0)
    item = F.struct(F.col(start).cast("int").alias("__start"), *[F.col(k) for k in key])
    grouped = units.groupBy(group).agg(F.collect_list(item).alias("__all"))

    def pick(acc: Column, level: Column) -> Column:
        shuffled = F.array_sort(F.transform("__all", lambda u: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), level.cast("string"), *[u[k].cast("string") for k in key])).alias("h"), u.alias("u"))))
        far = lambda acc, u: ~F.exists(acc, lambda x: (x == u) | (F.abs(x["__start"] - u["__start"]) < level))
        return F.aggregate(shuffled, acc, lambda a, s: F.when((F.size(a) < most) & far(a, s["u"]), F.array_append(a, s["u"])).otherwise(a))

    none = F.filter("__all", lambda u: F.lit(False))
    picked = F.when(F.size("__all") <= most, F.col("__all")).otherwise(F.aggregate(F.array(*map(F.lit, levels)), none, pick))
    on = list(dict.fromkeys([group, *key]))
    chosen = grouped.select(group, F.explode(picked).alias("u")).select(*[F.col(k if k == group else f"u.{k}").alias(k) for k in on])
    return _same(units, chosen, on).drop("__group")


def summary(units: DataFrame, group: str | Column) -> DataFrame:
    return units.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def automatic_distance(mode: str, size: int) -> int:
    return max(2 * size, 100) if mode == "chars" else max(12 * size, 100) if mode == "words" else 500


def apply(units: DataFrame, strategy: str, n: int | None, key: list[str], group: str | None = None, seed: int = 0) -> DataFrame:
    if strategy == "exhaustive":
        return units
    if n is None or (strategy == "stratified" and group is None):
        raise ValueError(f"{strategy} lacks arguments")
    return {"random": random, "reservoir": reservoir}[strategy](units, n, key, seed) if strategy != "stratified" else stratified(units, n, group, key, seed)
