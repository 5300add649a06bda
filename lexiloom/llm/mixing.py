"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact per-source budgets.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; the targets share all words by weight, none above
``max_epochs`` times its source's size (the excess goes to the others by weight). A source with target t and size s gives
every document floor(t / s) times, and then documents in hash order until the rest of its budget is used up; the document
at the cut gives only its first words, so each source meets floor(t) exactly.

Scale: every document row is thin (id, source, size, key). Keys are uniform, so equal-width key ranges are balanced
buckets without sampling; a source of n documents has about sqrt(n) buckets of about sqrt(n) documents, so neither the
running sum within a bucket nor the one over a source's buckets ever holds more than that in one task, however hot the
source. Only the source figures (one row a source) meet in one task to be ranked and shared out.

Defined cases: null text and text without words have size 0 and take 0; null source is a source of its own; a null id is
keyed by a hash of its text, so that many of them spread as ids do; rows that repeat an id are separate documents, ordered by
size and a hash of the text, and interchangeable only if they repeat the text too; a very long text counts whole; an empty table
gives an empty result; other columns, whatever their names, are not read by the query and are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, table, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
KEY_BITS = 48


def hash_key(seed: int, id_: Column, size: Column, text_hash: Column) -> Column:
    """A uniform key of KEY_BITS bits: the first hexadecimal digits of an MD5, which SQL engines share."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.concat(F.lit("null"), text_hash.cast("string"))), size.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, KEY_BITS // 4), 16, 10).cast("long")


def _name(source: Column) -> Column:
    """Never null, in code-point order with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(name, source_size, n_rows) -> the same and target; one row a source.

    With the cap c_i and weight w_i of each source ordered by c_i / w_i, the level reached after capping the first j
    sources is (T - sum of their caps) / (sum of the other weights); the right j is the first whose own ratio is not
    below its level. All sums are whole numbers, so the target is one division.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy("name")) - 1
    out = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * max_epochs)
    before = W.orderBy(F.col("cap") / F.col("w"), "name").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("num", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("den", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    open_ = F.when(F.col("cap") * F.col("den") >= F.col("num") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "name", "num", "den"))
    out = out.withColumn("level", F.min(open_).over(everything))
    level = (F.col("w") * F.col("level.num")).cast("double") / F.col("level.den")
    cap = F.col("cap").cast("double")
    return out.select("name", "source_size", "n_rows", F.least(cap, F.coalesce(level, cap)).alias("target"))


def plan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
         weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a document: doc_id, t (hash of the text), name (of the source), size, source_size, target, taken, epochs (whole copies), part (words of one more)."""
    scratch = Scratch(spark, "mix")
    thin = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), _name(F.col(f"`{source}`")).alias("name"), word_count(F.col(f"`{text}`")).alias("size"))
    thin = scratch.save(thin.withColumn("key", hash_key(seed, F.col("doc_id"), F.col("size"), F.col("t"))), "sizes")
    sums = thin.groupBy("name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = scratch.save(targets(sums, weights, max_epochs).withColumn("n_buckets", F.ceil(F.sqrt("n_rows"))), "targets")

    rows = thin.join(goal, "name")
    rows = rows.withColumn("bucket", F.floor(F.col("key") * F.col("n_buckets") / F.lit(float(1 << KEY_BITS))))
    held = scratch.save(rows.groupBy("name", "bucket").agg(F.sum("size").alias("words")), "buckets")
    over = W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("name", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("start"))
    within = W.partitionBy("name", "bucket").orderBy("key", "doc_id", "size", "t").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["name", "bucket"])
    size, whole = F.col("size"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(F.col("target") / F.when(whole > 0, whole))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")) - F.col("epochs") * whole
    part = F.greatest(F.lit(0), F.least(size, rest - F.col("start") - F.col("before"))).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("part", part)
    return rows.select("doc_id", "t", "name", "size", "source_size", "target", (F.col("epochs") * size + F.col("part")).alias("taken"), "epochs", "part")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (n + 1).cast("int"))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus in the columns of docs: a row for each whole copy taken, and one cut text a source at most.

    Rows that repeat a whole (id, source, text) triple take what their plan rows take together, in the order of their
    columns, so a rerun gives the same rows.
    """
    taken = plan(spark, docs, id_col, text, source, **options)
    # one join on the window's own key, so that each text moves once; only rows that repeat id, source and text share a list
    key = [F.coalesce(F.col("i").cast("string"), F.lit("")).alias("__i"), F.col("i").isNull().alias("__null"), F.col("name").alias("__name"), F.col("t").alias("__t")]
    right = taken.where("taken > 0").withColumnRenamed("doc_id", "i").select(*key, "taken", "epochs", "part")
    on = ["__i", "__null", "__name", "__t"]
    right = right.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("taken", "epochs", "part")), asc=False).alias("__all"))
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    rows = rows.withColumn("__size", word_count(F.col(own[text]))).withColumn("i", F.col(own[id_col])).withColumn("t", F.xxhash64(own[text])).withColumn("name", _name(F.col(own[source])))
    rows = rows.select(*own.values(), "__size", *key)
    told = F.xxhash64(*[F.to_json(F.struct(k)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(k) for c, k in own.items()])
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(*on).orderBy(told)))
    rows = rows.join(right, on).withColumn("__own", F.get(F.col("__all"), F.col("__n") - 1))
    rows = rows.withColumn("__epochs", F.coalesce("__own.epochs", F.lit(0))).withColumn("__part", F.coalesce("__own.part", F.lit(0)))
    none = F.array().cast("array<bigint>")
    whole = F.transform(F.array_repeat(F.lit(0), F.col("__epochs").cast("int")), lambda _: F.col("__size"))
    rows = rows.withColumn("__cut", F.explode(F.concat(whole, F.when(F.col("__part") > 0, F.array("__part")).otherwise(none))))
    shown = F.when(F.col("__cut") >= F.col("__size"), F.col(own[text])).otherwise(first_words(F.col(own[text]), F.col("__cut")))
    return rows.select(*[(shown if c == text else F.col(k)).alias(c) for c, k in own.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH thin AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size FROM documents),
keyed AS (SELECT *, substr(md5('0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR), 1, {KEY_BITS // 4}) AS key FROM thin),
s AS (SELECT name, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, ([{weights}])[((row_number() OVER (ORDER BY name)) - 1) % {len(WEIGHTS)} + 1] AS w
      FROM thin GROUP BY name),
r AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER b)::BIGINT, 0) AS num, (sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER b)::BIGINT, 0) AS den
      FROM s WINDOW b AS (ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT num, den FROM r WHERE cap * den >= num * w ORDER BY cap::DOUBLE / w, name LIMIT 1),
g AS (SELECT name, source_size, least(cap::DOUBLE, coalesce((w * l.num)::DOUBLE / l.den, cap::DOUBLE)) AS target FROM r LEFT JOIN l ON true),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
             coalesce((sum(size) OVER (PARTITION BY name ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before
      FROM keyed JOIN g USING (name))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM x"""
