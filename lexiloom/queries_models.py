"""Registered queries over tokens, fragments, matrices, LSA, pairs and streams; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import tokens as K
from lexiloom.plans import linalg as L
from lexiloom.plans import lsa as A
from lexiloom.queries_vectors import WIDTH, emb
from lexiloom.runtime import scratch_dir
from lexiloom.streaming.reservoir import kept, reservoir


def _sized(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length("text").alias("n"))


def _fragments(strategy: str, step: int, budget: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        return K.fragments(_sized(s, d), "n", 512, strategy, 512, 256).select("doc_id", "n_fragments", "fragment_index", "fragmentation", "from_token", "to_token")

    starts = "[0]" if strategy == "truncate" else f"list_filter(range(0, greatest(n, 1), {step}), lambda x: x = 0 OR x - {step} + {budget} < n)"
    return run, f"""WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
r AS (SELECT doc_id, n, CASE WHEN n <= 512 THEN [0] ELSE {starts} END AS a FROM d)
SELECT doc_id, len(a)::INTEGER AS n_fragments, unnest(range(len(a)))::INTEGER AS fragment_index, CASE WHEN n <= 512 THEN 'none' ELSE '{strategy}' END AS fragmentation,
unnest(a)::INTEGER AS from_token, unnest(list_transform(a, lambda x: CASE WHEN n <= 512 THEN n ELSE least(x + {budget}, n) END))::INTEGER AS to_token FROM r"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d).withColumn("word", F.col("label").cast("string"))
    words = e.select("word").distinct()
    lexicon = e.groupBy("word").agg(F.min_by("v", "vec_id").alias("vector"))
    pairs = words.select(F.col("word").alias("word_a")).join(words.select(F.col("word").alias("word_b")), F.col("word_b") == (F.col("word_a").cast("int") + 1).cast("string"))
    return L.pair_study(pairs, e.select("word", F.col("v").alias("vector")), lexicon)


def _covariance(s: SparkSession, d: str) -> DataFrame:
    c = L.covariance(emb(s, d), "v")
    return s.createDataFrame([(i, j, round(float(c[i, j]), 8)) for i in range(WIDTH) for j in range(WIDTH)], "i int, j int, cov double")


def _lsa(s: SparkSession, d: str) -> DataFrame:
    _, _, values = A.lsa(A.tfidf(s.read.parquet(f"{d}/benchmark.parquet"), "item_id"), 10)
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "k int, sigma double")


def _contour(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("words"))
    enc = K.HashEncoder()
    rows = K.encode(docs, enc, ["conv_id", "turn"]).withColumn("indices", F.lit(None).cast("array<int>"))
    return K.aggregate_units(rows, enc.width).select("conv_id", "turn", "aggregation", F.posexplode("vector").alias("dim", "x"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import StructType

    import uuid

    root = f"{scratch_dir(s)}/reservoir-{uuid.uuid4().hex}"
    schema: StructType = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).select("event_id", "user_id", "event_type")
    reservoir(stream, 100, ["event_id"], f"{root}/out", f"{root}/log", 2).awaitTermination()
    return kept(s, f"{root}/out")


_SPEC: dict[str, tuple] = {
    "fragment_fixed": _fragments("fixed", 510, 510),
    "fragment_sliding": _fragments("sliding_windows", 254, 510),
    "fragment_truncate": _fragments("truncate", 0, 510),
    "center_on_segment": (
        lambda s, d: _sized(s, d).select("doc_id", K.centre(F.col("n"), F.floor(F.col("n") / 2).cast("int"), F.floor(F.col("n") / 2).cast("int"), 8).alias("w")).select("doc_id", F.col("w.a").alias("a"), F.col("w.b").alias("b")),
        "WITH d AS (SELECT doc_id, length(text) AS n, length(text) // 2 AS p FROM documents), x AS (SELECT *, greatest(p - 3, 0) AS a0, least(greatest(greatest(p - 3, 0) + 8, p + 1), n) AS b FROM d) SELECT doc_id, greatest(least(a0, greatest(b - 8, 0)), 0)::INTEGER AS a, b::INTEGER AS b FROM x",
    ),
    "align_tokens": (
        lambda s, d: K.tokenize(s.read.parquet(f"{d}/benchmark.parquet")).select("item_id", F.size("tokens").alias("n_tokens"), F.array_join(K.align(F.col("tokens"), F.lit(5), F.lit(25)), ",").alias("indices")),
        r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS m, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM benchmark),
o AS (SELECT item_id, len(m) AS n, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS k FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t))
SELECT item_id, max(n)::INTEGER AS n_tokens, coalesce(string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FILTER (a < 25 AND a + k > 5), '') AS indices FROM o GROUP BY item_id""",
    ),
    "pooled_units": (_contour, None),
    "tfidf": (
        lambda s, d: A.tfidf(s.read.parquet(f"{d}/benchmark.parquet"), "item_id").withColumn("w", F.round("w", 8)),
        r"""WITH t AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN i USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 8) AS w FROM x""",
    ),
    "lsa_singular_values": (_lsa, None),
    "covariance": (
        _covariance,
        f"WITH e AS (SELECT vec_id, unnest(range({WIDTH}))::INTEGER AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT a.k AS i, b.k AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM e a JOIN e b USING (vec_id) GROUP BY ALL",
    ),
    "pca_ratio": (lambda s, d: s.createDataFrame([(i, float(x)) for i, x in enumerate(L.pca(emb(s, d), "v", 10)[0])], "k int, ratio double"), None),
    "singular_values": (lambda s, d: s.createDataFrame([(i, float(x)) for i, x in enumerate(L.singular_values(emb(s, d), "v"))], "k int, sigma double"), None),
    "subspace_scores": (lambda s, d: L.subspace_scores(emb(s, d), "v", 3).select("vec_id", "label", F.posexplode("scores").alias("k", "score")), None),
    "describe_subspace": (lambda s, d: L.describe(emb(s, d), "vec_id", "v", L.pca(emb(s, d), "v", 2)[1], 5), None),
    "pair_study": (_pairs, None),
    "stream_reservoir": (_stream, "SELECT event_id, user_id, event_type FROM events ORDER BY md5('2|' || event_id::VARCHAR), event_id LIMIT 100"),
}


def queries() -> dict:
    return {k: x[0] for k, x in _SPEC.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x[1] for k, x in _SPEC.items() if x[1]}
