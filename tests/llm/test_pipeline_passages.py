"""The query `pipeline`: passages inside longer lines go, and its rows against brute force."""

import collections
import random

from conftest import SF
from test_awkward import clashing
from test_llm import brute_components
from test_passages import brute, grams, words


def pipeline():
    import __spark_entry__

    return __spark_entry__.queries()["pipeline"]


def decoded(rows):
    """{id: text} of what the pipeline gives; copies of a document that the mix repeats are one."""
    import sentencepiece

    from lexiloom.llm import sentencepiece_codec

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    out = collections.defaultdict(str)
    for r in rows:
        out[r.doc_id] = max(out[r.doc_id], model.decode(r.ids), key=len)
    return out


def test_planted_passages_go(spark, tmp_path):
    """Passages of 51 to 120 words in the middle of longer lines of documents that share nothing else."""
    rng = random.Random(7)
    stops = "the of and to in a is that it for on with as was at by an be this which or from but not are".split()
    prose = lambda n: [rng.choice(stops) if rng.random() < 0.4 else f"w{rng.randrange(10**6)}" for _ in range(n)]
    planted, docs = [prose(n) for n in (51, 60, 75, 120)], {}
    for i in range(24):
        lines = [[*prose(20), "end."] for _ in range(12)]
        if i < 16:
            k = rng.randrange(12)
            lines[k][10:10] = planted[i % 4]
        docs[i] = "\n".join(map(" ".join, lines))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = decoded(pipeline()(spark, str(tmp_path)).collect())
    assert len(got) >= 20
    assert collections.Counter(g for t in docs.values() for g in set(grams(t, 50))).most_common(1)[0][1] == 4
    assert max(collections.Counter(g for t in got.values() for g in set(grams(t, 50))).values()) == 1
    # the first of each passage and the documents without one keep all their words, up to the cut of the mix
    assert all(docs[i].startswith(t) for i, t in got.items() if i < 4 or i >= 16)


def test_brute_force(spark):
    from lexiloom.llm import quality_rules

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in quality_rules.query(spark, SF).collect() if r.kept}
    _, component = brute_components({k: docs[k].text for k in good})
    left = {k: w for k, w in brute({k: docs[k].text for k in sorted(good) if component[k] == k}).items() if w}
    sizes = collections.Counter()
    for k, w in left.items():
        sizes[docs[k].source] += len(w)
    weight = {n: i % 3 + 1 for i, n in enumerate(sorted(sizes))}
    total, capped, over = sum(sizes.values()), set(), {None}
    while over:
        rest, weights = total - sum(3 * sizes[n] for n in capped), sum(w for n, w in weight.items() if n not in capped)
        over = {n for n, w in weight.items() if n not in capped and rest * w / weights > 3 * sizes[n]}
        capped |= over
    target = {n: 3 * sizes[n] if n in capped else rest * w / weights for n, w in weight.items()}
    got = pipeline()(spark, SF).collect()
    taken = collections.Counter()
    for r in got:
        ((_, text),) = decoded([r]).items()
        assert words(text) == left[r.doc_id][: len(words(text))] and r.n_tokens == len(r.ids)
        taken[r.source] += len(words(text))
    assert taken == {n: int(t) for n, t in target.items()}


def test_lines_of_awkward_rows(spark):
    import corpus_pipeline as cp

    assert [x for x, _ in cp.LINE_STAGES] == [x for x, _ in cp.STAGES] and dict(cp.LINE_STAGES)["substring dedup"] is cp.repeated_lines
    d = clashing(spark)
    out = cp._run(spark, SF, cp.LINE_STAGES, d)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and {r.doc_id for r in out.collect()} <= {r.doc_id for r in d.collect()}
    assert cp._run(spark, SF, cp.LINE_STAGES, d.limit(0)).count() == 0
