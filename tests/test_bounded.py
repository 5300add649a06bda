"""What a kernel holds at once does not grow with a batch of documents, and pairs are neither shuffled nor held."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import tokens as K
from lexiloom.operators import units as U


class Kernel:
    """A table whose mapInArrow or mapInPandas gives the function itself."""

    def __init__(self, df):
        self.df = df

    def __getattr__(self, name):
        return getattr(self.df, name)

    def select(self, *columns):
        return Kernel(self.df.select(*columns))

    def where(self, test):
        return Kernel(self.df.where(test))

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    def mapInPandas(self, run, schema):  # noqa: N802
        return lambda batches: (pa.RecordBatch.from_pandas(x) for x in run(b.to_pandas() for b in batches))


def docs(spark, body="x"):
    return Kernel(spark.createDataFrame([(0, body, "s")], "doc_id int, body string, source string"))


def out(run, *columns):
    return list(run(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "body", "source"][: len(columns)])])))


def bounded(batches, rows, most=16 << 20):
    assert sum(b.num_rows for b in batches) == rows and len(batches) > 1
    assert max(b.nbytes for b in batches) < most


BODY = "So the cat. Then the dog sat in the sun. " * 100  # 300 occurrences, no blank line: a paragraph is the whole text
N = 200


def test_encoding_some_tokens_is_encoding_all_and_picking(spark):
    seen = []

    class Counting(K.HashEncoder):
        def __call__(self, tokens):
            seen.append(len(tokens))
            return super().__call__(tokens)

    words = [f"w{i}" for i in range(50)]
    places = [0, 7, 7, 49]
    got = K.vectors_at(Counting(), words, places)
    assert np.array_equal(got, K.HashEncoder()(words)[:, places]) and max(seen) == 3
    rows = spark.createDataFrame([(1, words, [3, 99, 49]), (2, words[:1], [0]), (3, words, []), (4, words, None)], "id int, words array<string>, at array<int>")
    for layer in ("last", "mean"):
        whole = {r.id: r.token_vectors for r in K.encode(rows, K.HashEncoder(), ["id"], layer=layer).collect()}
        some = {r.id: r.token_vectors for r in K.encode(rows, K.HashEncoder(), ["id"], layer=layer, at="at").collect()}
        assert some == {1: [whole[1][3], None, whole[1][49]], 2: [whole[2][0]], 3: [], 4: whole[4]}


def test_context_windows_are_those_of_the_contexts(spark):
    from lexiloom.queries_text import docs as corpus

    d = corpus(spark, "/root/testdata/sf0.001")
    for most in (1, 4, 5, 510):
        got = {(r.doc_id, r.key): (r.position, r.words) for r in U.context_windows(d, "the", most).collect()}
        ctx = U.word_contexts(d, "the").select("doc_id", "key", "position", F.split("marked", " ").alias("w"))
        ctx = ctx.withColumn("c", K.centre(F.size("w"), F.col("position"), F.col("position"), most))
        want = {(r.doc_id, r.key): (r.position - r.c.a, r.w[r.c.a : r.c.b]) for r in ctx.collect()}
        assert got == want and got


@pytest.mark.parametrize("mode", ["paragraph", "sentence", "words", "chars"])
def test_lines_are_handed_on_in_bounded_batches(spark, mode):
    run = U.concordance(docs(spark), "the", "exact", mode, 20)
    bounded(out(run, list(range(N)), [BODY] * N, ["s"] * N), 300 * N)


def test_sentences_are_handed_on_in_bounded_batches(spark):
    bounded(out(U.sentences(docs(spark)), list(range(N)), [BODY] * N, ["s"] * N), 200 * N)


def test_contexts_are_handed_on_in_bounded_batches(spark):
    body = "the dog sat in the sun " * 100  # one sentence, copied to each occurrence
    bounded(out(U.word_contexts(docs(spark), "the"), list(range(N)), [body] * N), 200 * N)


def test_encoded_units_are_handed_on_in_slices(spark):
    units = Kernel(spark.createDataFrame([(0, ["a"])], "doc_id int, words array<string>"))
    run = K.encode(units, K.HashEncoder(), ["doc_id"])
    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([["a", "b"] * 50] * 1000)], names=["doc_id", "words"])])))
    assert sum(b.num_rows for b in got) == 1000 and max(b.nbytes for b in got) < 2 << 20


def test_text_functions_hand_on_slices(spark):
    texts = ["x" * 50 + "é", None, "plain"] * 500
    got = list(T._series(lambda s: s + "!").func(iter([pa.array(texts)])))
    assert max(len(a) for a in got) <= 64 and pa.chunked_array(got).to_pylist() == [x and (x + "!" if not x.isascii() else x) for x in texts]


def test_offsets_after_collapsing_are_lengths_of_collapsed_prefixes(spark):
    import re

    rng = np.random.default_rng(3)
    for _ in range(50):
        body = "".join(rng.choice(list("ab \n\t 　"), 40))
        at = T.collapsed(body)
        assert [at(x) for x in range(41)] == [len(re.sub(T.WHITE + "+", " ", body[:x])) for x in range(41)]


def test_offsets_are_found_in_one_pass_over_a_body(spark):
    """A body of n occurrences was collapsed n times, up to each of them."""
    import time

    body = "the  cat \n" * 40_000
    began = time.perf_counter()
    d = spark.createDataFrame([(0, body, "s")], "doc_id int, body string, source string")
    got = U.remapped(d, "the").agg(F.count("*"), F.max("start")).first()
    assert tuple(got) == (40_000, 39_999 * 8) and time.perf_counter() - began < 30


def test_a_study_encodes_where_its_units_are(spark):
    """Units met the vectors of all their tokens in a join, each side with the whole concordance below it."""
    from lexiloom.plans import concordance, study
    from lexiloom.queries_text import docs as corpus

    c = study.Config(concordance.Config("the", document_strategy=None, n_occurrences=None, occurrence_strategy="exhaustive", per_document=3, window="sentence"))
    out = study.run(corpus(spark, "/root/testdata/sf0.001"), c)
    for k, df in out.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1, k
    (a,) = out["analysis"].collect()
    x = np.array([r.vector for r in out["units"].select("vector").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = (x @ x.T)[np.triu_indices(len(x), 1)]
    assert a.n == len(x) and np.isclose(a["mean"], sims.mean()) and np.isclose(a["std"], sims.std())
    assert out["units"].where("size(token_vectors) <> size(words)").count() == 0
