"""Large components, repeated ids, many characters, clashing names and empty tables of the operators."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import sentencepiece_codec, topk_search
from lexiloom.llm.words import slices


def brute_top(rows, asked, k=5):
    """Best (vec_id, score) of each asked id over distinct (id, vector) rows, in whole numbers."""
    rows = sorted({(i, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v in rows})
    out = {}
    for q in sorted({i for i, _ in rows if asked(i)}):
        pairs = [(sum(x * y for x, y in zip(v, w, strict=True)), c) for i, v in rows if i == q for c, w in rows if c != q]
        out[q] = [(c, s) for s, c in sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]]
    return out


def top(spark, rows, **more):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = collections.defaultdict(list)
    for r in topk_search.top_k(spark, d, F.col("vec_id") % 50 == 0, **more).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_large_components_are_kept(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 2)]) for i in range(120)]
    rows += [(204, [1e13, 0.0]), (201, [0.0, -3e13]), (202, [2.0**40, 1.0]), (203, [123456789.125, -987654321.5])]
    assert top(spark, rows) == brute_top(rows, lambda i: i % 50 == 0)
    wide = [(0, [1e6, -1e6]), (1, [3e5, 7e5]), (2, [1e6 + 0.5, 2e6]), (3, [-1e6, 1.0])]  # beyond doubles, within longs
    assert top(spark, wide) == brute_top(wide, lambda i: i % 50 == 0)


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        top(spark, [(0, [1e13, 1.0]), (1, [1e13, 2.0])])
    # sums that cancel fit
    rows = [(0, [1e13, 1e13, 1.0]), (1, [1e13, -1e13, 2.0])]
    assert top(spark, rows) == brute_top(rows, lambda i: i % 50 == 0) == {0: [(1, 2 * 256 * 256)]}


def test_repeated_vector_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 60, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(150)] + [(50, [0.1] * 6), (50, [0.1] * 6)]
    assert top(spark, rows) == brute_top(rows, lambda i: i % 50 == 0)


def test_vectors_with_clashing_names(spark):
    d = spark.createDataFrame([(0, [1.0], 1, 2, 3, 4), (1, [2.0], 1, 2, 3, 4)], "vec_id long, embedding array<double>, v int, q int, rank int, score int")
    assert [tuple(r) for r in topk_search.top_k(spark, d, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 * 256 * 256)]


def test_run_of_many_characters():
    import sentencepiece

    every = "".join(chr(c) for c in range(0x20, 0x14000) if not 0xD800 <= c < 0xE000)
    assert len(set(every)) > 65535
    texts = [every, "the words " + every[::-1] + " again"]
    model, v = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL), sentencepiece_codec.load()
    ((_, _, data, offsets),) = slices(pa.array(texts), 1 << 24)
    ids, at = sentencepiece_codec.encode_run(v, data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == model.encode(texts)


def test_long_pieces_and_other_models():
    pieces = [(3, "abcdefghijklmnopqrst", -3.0), *((4 + i, c, -100.0 - i) for i, c in enumerate("▁abcdefghijklmnopqrst"))]
    parts = [(30 + n, "abcdefghijklmnopqrst"[:n], -float(100 - n)) for n in range(2, 20)]
    v = sentencepiece_codec.Vocabulary(pieces + parts, [0] * 256, [b""] * 60)
    codes = np.array([ord(c) for c in "abcdefghijklmnopqrst"] + [0], np.uint32)
    filed = sentencepiece_codec.edges(v, codes)
    assert v.most == 20 and v.ids[filed[0, 20]] == 3 and v.ids[filed[0, 19]] == 49
    spec = lambda kind: b"\x12\x02\x18" + bytes([kind])
    assert [sentencepiece_codec.model_type(x) for x in (spec(1), spec(2), b"", b"\x0a\x03\x0a\x01a" + spec(4))] == [1, 2, 1, 4]
