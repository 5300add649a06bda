"""Language ID by a linear-chain conditional random field over words.

A word's features are its lower-cased form (the lexicon), its first and last 2 to 4 bytes (affixes) and its byte
trigrams, hashed to a weight a language; transitions between the languages of adjacent words are learned with them.
Forward-backward gives every word's posterior, so code-switched text is labelled word by word; a document's language is
the one of the greatest mean posterior, which is its score.

Training: at most about ROWS_A_LABEL whole documents a language are drawn by a hash of their id from the labelled rows
outside the held-out third; half the training sequences stay in one document, half are spliced from stretches of
several, so that switches are seen. The weights come from AdaGrad on the exact gradient of forward-backward.

Scale: training rows and the weight table (2^BITS rows, a column a language) have fixed bounds; prediction is one scan
without a shuffle, in runs of bounded bytes, in which all documents step through their words together.

Defined cases: null text and text without a letter is `und` with score 0; without any training rows every text is `und`;
an empty text is `und`; the prediction reads the text alone; null ids are held-in rows that never train; repeated rows
are predicted alike; ties go to the label that comes first; a very long text is labelled whole, in one run; an empty table gives
an empty table, and a model without labels; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.words import Hasher, slices, spans
from lexiloom.runtime import ship

BITS, ROWS_A_LABEL, SEQUENCES, LENGTH, EPOCHS, SEED = 17, 200, 6000, 32, 3, 7
RATE, DECAY = 0.3, 1e-6
RUN = 4 << 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"'(),-./:;?[]{}*"]] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fixed features (word, 7; -1: none), hashes of the trigram at each byte, the trigrams' range of each word, first words of texts."""
    starts, ends, first = spans(data, offsets)
    for _ in range(3):  # punctuation around a word is not part of it
        ends = ends - ((ends - starts > 1) & _PUNCTUATION[data[ends - 1]])
    starts = starts + ((ends - starts > 1) & _PUNCTUATION[data[starts]])
    h = Hasher(data, lower=True)
    size = np.uint64((1 << BITS) - 1)
    fixed = np.full((len(starts), 7), -1, np.int64)
    fixed[:, 0] = h(starts, ends, 1) & size
    for k, n in enumerate((2, 3, 4)):
        some = np.flatnonzero(ends - starts >= n)
        fixed[some, 1 + k] = h(starts[some], starts[some] + n, 10 + n) & size
        fixed[some, 4 + k] = h(ends[some] - n, ends[some], 20 + n) & size
    at = np.arange(max(0, len(data) - 2))
    three = (h(at, at + 3, 30) & size).astype(np.int64)
    return fixed, three, np.stack([starts, np.maximum(starts, ends - 2)], axis=1), first


class Model:
    """labels; weights (2^BITS + 1, labels), the last row for absent features; log transitions and starts."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, begins: np.ndarray):
        self.labels, self.weights, self.moves, self.begins = labels, weights, moves, begins

    def emissions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fixed, three, ranges, first = word_features(data, offsets)
        out = np.zeros((len(fixed), len(self.labels)))
        for k in range(fixed.shape[1]):
            out += self.weights[fixed[:, k]]
        sums = np.zeros((len(three) + 1, len(self.labels)))
        np.cumsum(self.weights[three], axis=0, out=sums[1:])
        return out + sums[np.minimum(ranges[:, 1], len(three))] - sums[np.minimum(ranges[:, 0], len(three))], first

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's probabilities; `first` as of spans()."""
        _, ahead, back = self.passes(scores, first)
        both = ahead * back
        return both / both.sum(axis=1, keepdims=True) if len(both) else both

    def passes(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local factors, forward and backward messages (each up to a factor a word) of all texts at once."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        n, begin = n[order], first[:-1][order]
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # texts with over t words
        local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        moves, begins = np.exp(self.moves), np.exp(self.begins)
        ahead, back = np.empty_like(local), np.empty_like(local)
        last = None
        for t in range(longest):
            at = begin[: active[t]] + t
            now = local[at] * (begins if last is None else last[: active[t]] @ moves)
            now /= now.sum(axis=1, keepdims=True)
            ahead[at] = last = now
        last = np.zeros((0, local.shape[1]))
        for t in range(longest - 1, -1, -1):
            at = begin[: active[t]] + t
            now = np.ones((active[t], local.shape[1]))
            if len(last):
                now[: len(last)] = (last * local[at[: len(last)] + 1]) @ moves.T
                now /= now.sum(axis=1, keepdims=True)
            back[at] = last = now
        return local, ahead, back


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Fits on texts whose words all have their text's language, and on splices of them."""
    labels = sorted(set(langs))
    n = len(labels)
    rng = np.random.default_rng(seed)
    words, marks = [], []  # for each word its features; its label
    for (a, b, data, offsets) in slices(pa.array(texts, pa.string()), 1 << 20):
        fixed, three, ranges, first = word_features(data, offsets)
        for i in range(a, b):
            for w in range(first[i - a], first[i - a + 1]):
                words.append(np.concatenate([fixed[w][fixed[w] >= 0], three[ranges[w, 0] : ranges[w, 1]]]))
        marks.append(np.repeat([labels.index(x) for x in langs[a:b]], np.diff(first)))
    marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    weights, moves, begins = np.zeros(((1 << BITS) + 1, n)), np.zeros((n, n)), np.zeros(n)
    if n < 2 or len(words) < LENGTH:
        return Model(labels, weights, moves, begins)
    by_label = [np.flatnonzero(marks == y) for y in range(n)]
    sequences = []
    for k in range(SEQUENCES):
        parts, left = [], LENGTH
        while left:
            size = left if k % 2 else min(left, int(rng.integers(3, 17)))
            pool = by_label[int(rng.integers(n))]
            at = int(pool[rng.integers(len(pool))])
            got = np.arange(at, min(at + size, len(marks)))
            got = got[marks[got] == marks[at]]
            parts.append(got)
            left -= len(got)
        sequences.append(np.concatenate(parts))
    sequences = np.array(sequences)
    squares = [np.full(x.shape, 1e-6) for x in (weights, moves, begins)]
    model = Model(labels, weights, moves, begins)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 256)):
            ids = sequences[batch].ravel()
            own = [words[i] for i in ids.tolist()]
            feats = np.concatenate(own)
            size = np.array([len(x) for x in own])
            at = np.cumsum(np.r_[0, size[:-1]])
            scores = np.add.reduceat(weights[feats], at, axis=0)
            first = np.arange(0, len(ids) + 1, LENGTH)
            local, ahead, back = model.passes(scores, first)
            post = ahead * back
            post /= post.sum(axis=1, keepdims=True)
            truth = np.eye(n)[marks[ids]]
            gap = np.repeat(truth - post, size, axis=0)
            grads = [np.stack([np.bincount(feats, gap[:, y], len(weights)) for y in range(n)], axis=1)]
            before, after = ahead.reshape(-1, LENGTH, n)[:, :-1].reshape(-1, n), (local * back).reshape(-1, LENGTH, n)[:, 1:].reshape(-1, n)
            joint = before[:, :, None] * np.exp(moves) * after[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            t = truth.reshape(-1, LENGTH, n)
            grads += [np.einsum("bij,bik->jk", t[:, :-1], t[:, 1:]) - joint.sum(axis=0), (t[:, 0] - post.reshape(-1, LENGTH, n)[:, 0]).sum(axis=0)]
            for x, g, s in zip((weights, moves, begins), grads, squares, strict=True):
                g -= DECAY * len(ids) * x
                s += g * g
                x += RATE * g / np.sqrt(s)
    weights[-1] = 0
    return Model(labels, weights.astype(np.float32), moves, begins)


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, "und"], object)
        for batch in batches:
            ids, letters, texts = batch.columns
            usable = np.asarray(letters.fill_null(False).cast(pa.int8())).astype(bool)
            for a, b, data, offsets in slices(texts, RUN):
                scores, first = [], [np.zeros(1, np.int64)]
                at = 0
                while at < b - a:  # features of smaller runs, for the size of the tables
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 19), "right")) - 1)
                    s, f = model.emissions(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                    scores.append(s)
                    first.append(f[1:] + first[-1][-1])
                    at = to
                first = np.concatenate(first)
                post = model.posteriors(np.concatenate(scores), first)
                sums = np.vstack([np.zeros(post.shape[1]), np.cumsum(post, axis=0)])
                mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))[:, None]
                ok = usable[a:b] & (np.diff(first) > 0)
                best = np.where(ok, mean.argmax(axis=1), len(model.labels))
                score = np.where(ok, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(labels[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows_a_label: int = ROWS_A_LABEL, seed: int = SEED) -> Model:
    """Draws the training rows and fits; the number of languages is taken to be small."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], np.zeros(((1 << BITS) + 1, 0)), np.zeros((0, 0)), np.zeros(0))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 32)
    drawn = reduce(lambda e, kv: e.when(F.col(lang) == kv[0], key < int(min(1.0, rows_a_label / kv[1]) * 2**32)), sorted(counts.items()), F.when(F.lit(False), F.lit(False)))
    sample = rows.where(drawn).select(key.alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).orderBy("k", "t").limit(2 * rows_a_label * len(counts)).collect()
    return train([r["t"] for r in sample], [r["l"] for r in sample], seed)


def identify(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a row of docs."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).rlike(r"\p{L}").alias("letters"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not model.labels:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.mapInArrow(_predictor(model), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(spark, docs, fit(docs))
