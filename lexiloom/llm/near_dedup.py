"""MinHash near-dedup with odd sketches: banded candidates, parity-bitmap estimates, exact confirmation, components.

A text's set is its distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle of all its words).
1. One pass of NumPy kernels gives each text its set's size and 128-bit fingerprint, the keys of BANDS bands of ROWS
   MinHash samples, and an odd sketch: BITS bits in which every sample flips one bit.
2. Equal sets form a class, represented by its least doc_id (a partial aggregate, however many copies there are).
3. Representatives that share a band key are candidates. For two sets that agree on a share J of the samples, the XOR of
   the sketches has about n/2 * (1 - exp(-4k(1-J)/n)) set bits (k samples, n bits), so its population count, native on
   eight longs, drops candidates estimated under ESTIMATE: six standard deviations below the limit.
4. The rest are confirmed on full sets (100 * intersection >= 85 * union), streamed through sorted partitions.

A band's members are never paired off. Each is first compared with its band's least member, which links most copies;
bands that are by then in one component are done. In the others the sketches of members meet in cells of CELL x CELL,
which give only a spanning forest of the components whose members are close, so at most a row a member. The members with
a close partner elsewhere then meet by the clusters of that forest, again in cells, with their full sets: what passes the
estimate is counted exactly in place, and again only a spanning forest of confirmed links leaves a cell. So no link
between candidates is lost, no pair list grows with the square of a group, and no task holds more than two blocks of a
group, which have about CELL texts and CELL_BYTES of text at most (one text, if it is longer).
Work that stays quadratic: members of one cluster that are close by estimate and yet linked with none of its components
are all held against each other, n^2 / 2 tests and n / CELL copies of each text for n of them.
A pair at J = 0.85 shares no band with probability (1 - 0.85^ROWS)^BANDS = 9e-7.

Scale: texts are scanned once for signatures and moved once (only those in a shared band) for confirmation; hot pivots
are salted; joins on hot keys are plain joins of two exchanges, which adaptive execution splits.

Defined cases: null or empty texts, or without words, have an empty set, link with nothing and stay; rows with a null id
take no part and stay, with a null component; rows that repeat an id and text are one document; rows that repeat an id with
other texts are documents of their own, linked only by their texts, and `dedup` keeps of a group the one of least (id, hash
of the text); a very long text is hashed whole, in one task; an empty table gives an empty table; other columns, whatever
their names, are not read, and `dedup` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, table
from lexiloom.llm.components import components
from lexiloom.llm.words import Hasher, mix, shingles, slices, spans
from lexiloom.runtime import ship

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, BITS = 36, 7, 512
ESTIMATE = 0.62
CELL, SALT = 256, 64
CELL_BYTES = 32 << 20

_SIGNATURE = "doc_id long, t long, n_shingles long, f1 long, f2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(BITS // 64))
_RNG = np.random.Generator(np.random.PCG64(11))
_XOR = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BAND = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BIT = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def sets_of(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of runs of rows."""
    for a, _, data, offsets in slices(texts):
        starts, ends, first = spans(data, offsets)
        yield a, shingles(Hasher(data, lower=True)(starts, ends), first, SHINGLE)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Samples by (sample, set); no set may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    lo = 0
    while lo < len(sets):  # blocks that stay in the cache
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 32768, "right")) - 1)
        block, begins = flat[at[lo] : at[hi]], at[lo:hi] - at[lo]
        for k in range(BANDS * ROWS):
            out[k, lo:hi] = np.minimum.reduceat((block ^ _XOR[k]) * _TIMES[k], begins)
        lo = hi
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, (set, BITS / 64) of uint64."""
    k, n = samples.shape
    bit = mix(samples.astype(np.uint64) + _BIT[:, None]) % np.uint64(BITS)
    flat = (np.arange(n, dtype=np.int64) * BITS)[None, :] + bit.astype(np.int64)
    odd = (np.bincount(flat.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1, bitorder="little").view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(set, BANDS) of uint64; a key tells its band."""
    own = (samples.astype(np.uint64) + np.uint64(1)) * _BAND[:, None]
    own = own.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return np.ascontiguousarray(mix(own).T)


def most_bits(estimate: float = ESTIMATE) -> int:
    """XOR population count up to which the estimate reaches `estimate`."""
    k = BANDS * ROWS
    return int(BITS / 2 * (1 - math.exp(-4 * k * (1 - estimate) / BITS)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "t", "n_shingles", "f1", "f2", "bands", *[f"s{i}" for i in range(BITS // 64)]]
    for batch in batches:
        ids, ts, texts = batch.columns
        for a, sets in sets_of(texts):
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            f1, f2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands = np.zeros((len(n), BANDS), np.int64)
            sketches = np.zeros((len(n), BITS // 64), np.int64)
            if len(full):
                some = [sets[i] for i in full]
                at = np.cumsum([0, *map(len, some)])[:-1]
                flat = np.concatenate(some)
                f1[full] = mix(np.add.reduceat(mix(flat), at) + n[full].astype(np.uint64)).view(np.int64)
                f2[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)).view(np.int64)
                samples = minhashes(some)
                bands[full] = band_keys(samples).view(np.int64)
                sketches[full] = odd_sketches(samples).view(np.int64)
            held = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)].astype(np.int32)), pa.array(bands[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, len(n)), ts.slice(a, len(n)), pa.array(n), pa.array(f1), pa.array(f2), lists, *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(BITS // 64)]],
                names=names,
            )


def _close(left: str, right: str) -> Column:
    """The odd sketches of two sides estimate at least ESTIMATE."""
    bits = sum((F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))) for i in range(1, BITS // 64)), F.bit_count(F.col(f"{left}0").bitwiseXOR(F.col(f"{right}0"))))
    return bits <= most_bits()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (len(both) - same)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, salt, a), a pivot's own row (a null) first of each (b, salt); gives confirmed (a, b)."""
    pivot, own = None, None
    for batch in batches:
        a, b, salt, texts = batch.columns
        a, b, salt = a.to_pylist(), b.to_pylist(), salt.to_pylist()
        found: list[tuple[int, int]] = []
        for lo, sets in sets_of(texts):
            for i, s in enumerate(sets, lo):
                if a[i] is None:
                    pivot, own = (b[i], salt[i]), s
                elif (b[i], salt[i]) != pivot:
                    raise ValueError(f"no pivot before row {a[i]}")
                elif linked(own, s):
                    found.append((a[i], b[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; texts: doc_id, text. A pivot b meets SALT partners at a time on average."""
    pairs = pairs.withColumn("n", F.lit(1))
    sizes = pairs.groupBy("b").agg(F.ceil(F.sum("n") / SALT).alias("salts"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    members = dealt.join(texts, dealt["a"] == texts["doc_id"]).select("a", "b", "salt", "text")
    pivots = dealt.select("b", "salt").distinct().join(texts, F.col("b") == texts["doc_id"]).select(F.lit(None).cast("long").alias("a"), "b", "salt", "text")
    sorted_ = members.unionByName(pivots).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return sorted_.mapInArrow(_confirm, "a long, b long")


class _Forest:
    """Union-find over the labels of one cell."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _cellwise(judge):
    """Runs judge(rows) on each cell of partitions sorted by (cell, side), and emits its (a, b) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int | None]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[0] != held[0][0]:
                    found += judge(held)
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out(judge(held))

    return run


def _partners(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, sketches, and the two sides of a cell (one side against itself if there is only one)."""
    side = np.array([r[1] for r in rows])
    node, comp = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    sketch = np.array([r[4 : 4 + BITS // 64] for r in rows], np.int64).view(np.uint64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return node, comp, sketch, left, right if len(right) else left


def _close_cells(rows: list[tuple]) -> list[tuple[int, int | None]]:
    """(component, component) of a spanning forest of the close ones, and (node, null) of nodes with a close partner."""
    _, comp, sketch, left, right = _partners(rows)
    forest, edges, active = _Forest(), [], np.zeros(len(rows), bool)
    for x in left:
        other = right[comp[right] != comp[x]]
        other = other[np.bitwise_count(sketch[other] ^ sketch[x]).sum(axis=1) <= most_bits()]
        if len(other):
            active[x] = True
            active[other] = True
            edges += [(int(comp[x]), c) for c in np.unique(comp[other]).tolist() if forest.join(int(comp[x]), c)]
    return [*edges, *((rows[i][2], None) for i in np.flatnonzero(active))]


def _linked_cells(rows: list[tuple]) -> list[tuple[int, int | None]]:
    """Confirmed (node, node) of a spanning forest of the components of a cell; the last field of a row is its text."""
    node, comp, sketch, left, right = _partners(rows)
    sets = [s for _, some in sets_of(pa.array([r[-1] for r in rows], pa.string())) for s in some]
    size = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(size)]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine, forest, links = np.zeros(int(ids.max()) + 1, bool), _Forest(), []
    for x in left:
        roots = np.array([forest.root(c) for c in comp[right].tolist()])
        other = right[roots != forest.root(int(comp[x]))]
        other = other[np.bitwise_count(sketch[other] ^ sketch[x]).sum(axis=1) <= most_bits()]
        if not len(other):
            continue
        own = ids[at[x] : at[x + 1]]
        mine[own] = True
        flat = np.concatenate([ids[at[y] : at[y + 1]] for y in other])
        both = np.add.reduceat(mine[flat].astype(np.int64), np.cumsum(np.r_[0, size[other][:-1]]))
        mine[own] = False
        for y in other[100 * both >= PERCENT * (size[x] + size[other] - both)]:
            if forest.join(int(comp[x]), int(comp[y])):
                links.append((max(int(node[x]), int(node[y])), min(int(node[x]), int(node[y]))))
    return links


def _celled(members: DataFrame, group: str, count: str, columns: list[str], size: str | None = None) -> DataFrame:
    """Members of each group dealt to cells of CELL x CELL, or fewer where they are long: cell, side, and the columns."""
    blocks = F.ceil(F.greatest(F.col(count) / CELL, F.col(size) / CELL_BYTES)) if size else F.ceil(F.col(count) / CELL)
    rows = members.withColumn("mine", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cell = F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select(cell.alias("cell"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *columns)


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id and first_t (id and hash of a group's first text): one row a row of docs.

    A class of equal sets is a node: it goes by its least doc_id, or where several classes share that, all but one of them
    by a hash of their fingerprint.
    """
    ship(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    signed = scratch.save(texts.mapInArrow(_signatures, _SIGNATURE), "signatures")
    sketch = [f"s{i}" for i in range(BITS // 64)]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t")).alias("r"), *[F.first(c).alias(c) for c in ("bands", *sketch)])
    classes = scratch.save(classes.select("f1", "f2", F.col("r.doc_id").alias("rep_id"), F.col("r.t").alias("rep_t"), "bands", *sketch), "classes")
    owners = classes.groupBy("rep_id").agg(F.min(F.struct("f1", "f2")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    owners = scratch.save(owners, "owners")
    if owners.isEmpty():  # as a rule: the same without the join
        classes = classes.withColumn("rep", F.col("rep_id"))
    else:
        node = F.when(F.col("owner").isNull() | (F.struct("f1", "f2") == F.col("owner")), F.col("rep_id")).otherwise(F.xxhash64("f1", "f2"))
        classes = classes.join(owners, "rep_id", "left").withColumn("rep", node).drop("owner")
    nodes = classes.select("rep", "rep_id", "rep_t", "f1", "f2")

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = scratch.save(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot"), "shared")
    banded = scratch.save(keyed.join(shared, "key").select("key", "rep", "pivot").distinct(), "banded")
    some = banded.select("rep").distinct().join(nodes, "rep").select("rep", F.col("rep_id").alias("doc_id"), F.col("rep_t").alias("t"))
    some = texts.join(some, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.first("rep").alias("rep"), F.max("text").alias("text"))
    some = scratch.save(some.select(F.col("rep").alias("doc_id"), "text"), "texts")
    sketches = scratch.save(classes.select("rep", *sketch).join(some.select(F.col("doc_id").alias("rep")), "rep"), "sketches")

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("rep").alias(name), *[F.col(c).alias(f"{name}{c[1:]}") for c in sketch])

    def tested(pairs: DataFrame, name: str) -> DataFrame | None:
        near = scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").where(_close("a", "b")).select("a", "b"), f"{name}-near")
        found = None if near.isEmpty() else scratch.save(confirm(near, some), name)
        return None if found is None or found.isEmpty() else found

    links = tested(banded.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "links-0")
    links = links if links is not None else spark.createDataFrame([], "a long, b long")
    known = scratch.save(components(links, scratch, "stars-0"), "components-0")

    now = banded.join(known, banded["rep"] == known["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    many = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
    many = scratch.save(many.where("x != y").select("key", "members"), "open")
    members = _celled(now.join(many, "key").join(sketches, "rep"), "key", "members", ["rep", "component", *sketch])
    found = members.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_cellwise(_close_cells), "a long, b long")
    found = scratch.save(found.distinct(), "close")
    if not found.isEmpty():
        clusters = scratch.save(components(found.where("b is not null"), scratch, "clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clustered")
        active = found.where("b is null").select(F.col("a").alias("rep"))
        active = active.join(known, active["rep"] == known["node"], "left").select("rep", F.coalesce("component", "rep").alias("component")).join(clusters, "component")
        active = scratch.save(active, "active")
        own = some.select(F.col("doc_id").alias("rep"), "text")
        sizes = active.join(own.select("rep", F.octet_length("text").alias("bytes")), "rep").groupBy("cluster")
        sizes = scratch.save(sizes.agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes")), "sizes")
        members = active.join(sizes, "cluster").join(sketches, "rep").join(own, "rep")
        members = _celled(members, "cluster", "members", ["rep", "component", *sketch, "text"], "bytes")
        more = scratch.save(members.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_cellwise(_linked_cells), "a long, b long"), "links-1")
        if not more.isEmpty():
            known = scratch.save(components(links.union(more), scratch, "stars-1"), "components-1")

    named = scratch.save(nodes.join(known, nodes["rep"] == known["node"], "left").select("f1", "f2", "rep_id", "rep_t", F.coalesce("component", "rep").alias("c")), "named")
    least = named.groupBy("c").agg(F.min(F.struct("rep_id", "rep_t")).alias("least"))
    named = scratch.save(named.join(least, "c").select("f1", "f2", "least"), "least")
    scratch.drop("classes", "owners", "shared", "banded", "texts", "sketches", "links-0-near", "links-0", "components-0", "open", "close", "clustered", "active", "sizes", "links-1", "components-1", "named")
    out = signed.join(named, ["f1", "f2"], "left")
    taking_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(taking_part, F.col("least.rep_id")).otherwise(F.col("doc_id"))
    first = F.when(taking_part, F.col("least.rep_t")).otherwise(F.col("t"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), first.alias("first_t"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs."""
    out = groups(spark, docs, id_col, text).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one document of each group: rows that repeat an id and text are one document and give one row."""
    found = groups(spark, docs, id_col, text).where("doc_id is not null and doc_id = component_id and t <=> first_t")
    kept = found.select(F.col("doc_id").alias("__i"), F.col("t").alias("__t")).distinct()
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{id_col}`").cast("long").alias("__i"), F.xxhash64(F.col(f"`{text}`")).alias("__t"))
    once = rows.where(F.col("__i").isNotNull()).join(kept, ["__i", "__t"]).dropDuplicates(["__i", "__t"])
    return once.unionByName(rows.where(F.col("__i").isNull())).drop("__i", "__t").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
