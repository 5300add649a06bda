"""Near-dedup where ids repeat, columns clash and tables are empty."""

import collections

from pyspark.sql import functions as F
from test_llm import shingle_set

from lexiloom.llm import near_dedup

A, B, C = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")


def brute(rows):
    """(id, text) -> component (least id) over distinct rows, by all pairs."""
    nodes = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    sets, up = {n: shingle_set(n[1]) for n in nodes}, {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for x in nodes:
        for y in nodes:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    members = collections.defaultdict(list)
    for n in nodes:
        members[root(n)].append(n[0])
    return {n: min(members[root(n)]) for n in nodes}, len(members)


def test_repeated_ids_with_other_texts(spark):
    near_b = B + " tail"
    rows = [(1, A), (1, B), (2, B), (3, A), (4, C), (4, near_b), (4, C), (5, C + " x"), (5, A + " y"), (9, "one two"), (9, "three"), (8, "three"), (9, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want, n = brute([(i, t) for i, t in rows if t])
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark, d).collect())
    expected = collections.Counter((i, len(shingle_set(t)), want.get((i, t), i), want.get((i, t), i) == i) for i, t in rows)
    assert got == expected
    kept = [tuple(r) for r in near_dedup.dedup(spark, d).collect()]
    # one text of each group, none lost
    assert len(kept) == n + 1 and (1, A) in kept and (1, B) in kept and (9, "") in kept
    for part in (3, 1):
        again = near_dedup.dedup(spark, d.repartition(part)).collect()
        assert sorted(map(tuple, again)) == sorted(kept)


def test_clashing_names_and_empty_tables(spark):
    d = spark.createDataFrame([(1, A, 1, 2, 3, 4, 5), (2, A, 1, 2, 3, 4, 5), (None, A, 1, 2, 3, 4, 5), (3, None, 1, 2, 3, 4, 5)], "doc_id long, text string, __kept int, __i int, __t int, t int, rep int")
    out = near_dedup.dedup(spark, d)
    assert out.columns == d.columns and sorted((r.doc_id or 0, r["__kept"], r.t) for r in out.collect()) == [(0, 1, 4), (1, 1, 4), (3, 1, 4)]
    none = d.limit(0)
    assert near_dedup.near_duplicates(spark, none).count() == 0 and near_dedup.dedup(spark, none).count() == 0
    assert near_dedup.near_duplicates(spark, d.where(F.col("text").isNull())).count() == 1


def test_small_cells_lose_no_link(spark, monkeypatch):
    import random

    from test_llm import brute_components

    rng = random.Random(6)
    base, docs = [f"t{i}" for i in range(150)], {}
    for k in range(60):  # close to each other, and linked in chains only
        w = list(base)
        for i in rng.sample(range(150), rng.choice((1, 2, 3))):
            w[i] = f"x{k}_{i}"
        docs[k] = " ".join(w)
    monkeypatch.setattr(near_dedup, "CELL", 16)
    monkeypatch.setattr(near_dedup, "CELL_BYTES", 3000)
    sets, want = brute_components(docs)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert len(set(want.values())) > 1 and {r.doc_id: r.component_id for r in got} == want
