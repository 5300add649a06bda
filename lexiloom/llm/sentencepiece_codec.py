"""SentencePiece encoding and decoding by suffix-array matching.

A run of texts is cut into words (a SentencePiece never has its space mark after another character), and the distinct
words are concatenated and indexed: all suffixes are sorted by as many characters as the longest piece has, every piece of the
vocabulary is binary-searched for its range of occurrences, and the ranges become edges, filed by start and length.
Relaxation then follows the model's kind. The given model is byte-pair, where the best path is not the one of greatest
sum but the one merging reaches, so each word's edges are relaxed in order of piece rank, leftmost first, taking an edge
when it spans two symbols that stand side by side; all words of the run advance together. Characters without a piece
become the pieces of their UTF-8 bytes. Ids equal those of the sentencepiece library, and decoding gives the text back.

Scale: row by row, no shuffle; the vocabulary (its size is fixed) is the only thing sent to the workers; a run has about
RUN bytes of text, so memory does not depend on the table. A very long word takes a heap instead of vector rounds.

Defined cases: null text gives null ids and null decoding; empty text gives no ids; a literal space mark decodes as a
space, as in the library; a run may hold any number of different characters; a very long text is a run of its own, some 90
bytes a character; a model that is not byte-pair is refused; ids outside the vocabulary decode to nothing; repeated rows and null ids are encoded as they
come; other columns of any name are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.llm.words import mix, powers, slices
from lexiloom.runtime import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
RUN, LONG_WORD = 2 << 20, 128
_NONE = np.int32(2**31 - 1)
_BASE = 0x9FB21C651E98DF25
_BASE_INV = pow(_BASE, -1, 2**64)


class Vocabulary:
    """Pieces of a model in order of rank: their characters (padded with 0), lengths and ids; characters and bytes to ids."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], surfaces: list[bytes]):
        pieces = sorted(pieces, key=lambda p: (-p[2], p[0]))
        if any(chr(SPACE) in p.lstrip(chr(SPACE)) for _, p, _ in pieces):
            raise ValueError("a piece has a space mark after another character")
        several = [p for p in pieces if len(p[1]) > 1]
        self.lengths = np.array([len(p) for _, p, _ in several], np.int64)
        self.most = int(self.lengths.max(initial=2))
        self.chars = np.zeros((len(several), max(16, -(-self.most // 16) * 16)), np.uint32)
        for i, (_, p, _) in enumerate(several):
            self.chars[i, : len(p)] = [ord(c) for c in p]
        self.ids = np.array([i for i, _, _ in several], np.int32)
        # equal scores share a rank, so that the leftmost of them goes first
        scores = np.array([s for _, _, s in several])
        self.ranks = np.r_[0, np.cumsum(scores[1:] != scores[:-1])].astype(np.int32) if len(several) else np.zeros(0, np.int32)
        single = sorted((ord(p), i) for i, p, _ in pieces if len(p) == 1)
        self.single = np.array([c for c, _ in single], np.uint32)
        self.single_ids = np.array([i for _, i in single], np.int32)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surfaces)])


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram (also where it is not told), 2 byte-pair, 3 word, 4 character."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + n]
                at += n

    trainer = b"".join(x for k, x in fields(proto) if k == 2 and isinstance(x, bytes))
    return next((x for k, x in fields(trainer) if k == 3 and isinstance(x, int)), 1)


@lru_cache(4)
def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; only byte-pair models, whose merges `relax` follows."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if model_type(m.serialized_model_proto()) != 2:
        raise ValueError(f"{path} is no byte-pair model")
    n = m.get_piece_size()
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i)
    surfaces = []
    for i in range(n):
        p = m.id_to_piece(i)
        surfaces.append(bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if special(i) else p.replace(chr(SPACE), " ").encode())
    return Vocabulary([(i, m.id_to_piece(i), m.get_score(i)) for i in range(n) if not special(i)], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], surfaces)


def _suffixes(marks: np.ndarray, bits: int, width: int) -> list[np.ndarray]:
    """Sort keys of the suffixes: `width` characters of `bits` bits in words of 64."""
    n, per = len(marks), 64 // bits
    key = np.zeros(n + width + 16, np.uint64)
    key[:n] = marks
    have = 1
    while have < per:
        nxt = key << np.uint64(bits * have)
        nxt[:-have] |= key[have:]
        key, have = nxt, have * 2
    return [key[k : k + n] for k in range(0, width, per)]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted tuple of keys the first sorted suffix that is not below (right: that is above) it."""
    lo = np.zeros(len(wanted[0]), np.int64)
    hi = np.full(len(wanted[0]), len(keys[0]), np.int64)
    for _ in range(int(len(keys[0])).bit_length() + 1):
        mid = np.minimum((lo + hi) >> 1, len(keys[0]) - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted, strict=True):
            at = k[mid]
            less |= same & (at < w)
            same &= at == w
        go = (less | same if right else less) & (lo < hi)
        stay = ~go & (lo < hi)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(stay, mid, hi)
    return lo


def edges(v: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """The piece (by rank order) of each span [start, start + length) that is one, else _NONE; 0 in codes ends words."""
    n = len(codes)
    filed = np.full((n, v.most + 1), _NONE, np.int32)
    letters = np.unique(codes)
    letters = letters[letters > 0]
    bits = 8 if len(letters) < 255 else 16 if len(letters) < 65535 else 32
    width = v.chars.shape[1]
    known = np.isin(v.chars, letters) | (v.chars == 0)
    here = np.flatnonzero(known.all(axis=1))
    if not n or not len(here):
        return filed
    rank = np.zeros(n, np.uint64)
    rank[codes > 0] = np.searchsorted(letters, codes[codes > 0]) + 1
    keys = _suffixes(rank, bits, width)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    chars = v.chars[here]
    low = np.where(chars > 0, np.searchsorted(letters, chars) + 1, 0).astype(np.uint64)
    high = np.where(chars > 0, low, np.uint64((1 << bits) - 1))
    per = 64 // bits
    pack = lambda x: [np.bitwise_or.reduce(x[:, k : k + per] << (np.arange(per - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)), axis=1) for k in range(0, width, per)]
    first, last = _bound(keys, pack(low), False), _bound(keys, pack(high), True)
    count = last - first
    piece = np.repeat(here, count)
    begin = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)
    start = order[begin + np.arange(len(piece))]
    filed[start, v.lengths[piece]] = piece
    return filed


def _merge_long(v: Vocabulary, filed: np.ndarray, at: int, n: int) -> list[int]:
    """Symbol lengths of one word, by a heap of edges."""
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            both = size[i] + size[after[i]]
            if both <= v.most and (p := filed[at + i, both]) != _NONE:
                heapq.heappush(heap, (int(v.ranks[p]), i, both))

    for i in range(n):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if size[i] and (j := after[i]) < n and size[i] + size[j] == both:
            size[i], size[j], after[i] = both, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
    return [s for s in size if s]


def relax(v: Vocabulary, filed: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words: starts and lengths, in order."""
    n = len(filed)
    size = np.zeros(n, np.int64)
    for w in np.flatnonzero(lengths > LONG_WORD).tolist():
        at = int(starts[w])
        for s in _merge_long(v, filed, at, int(lengths[w])):
            size[at] = s
            at += s
    short = (lengths <= LONG_WORD) & (lengths > 0)
    words, count = starts[short], lengths[short]
    head = np.cumsum(np.r_[0, count[:-1]]) if len(count) else np.zeros(0, np.int64)
    pos = np.repeat(words - head, count) + np.arange(int(count.sum()))
    own = np.ones(len(pos), np.int64)
    ranks = np.append(v.ranks, _NONE)
    while len(pos):
        tail = np.zeros(len(pos), bool)
        tail[head[1:] - 1] = tail[-1] = True
        both = own + np.append(own[1:], 0)
        can = ~tail & (both <= v.most)
        piece = np.full(len(pos), len(v.ranks))
        found = filed[pos[can], both[can]]
        piece[can] = np.where(found == _NONE, len(v.ranks), found)
        order = (ranks[piece].astype(np.int64) << 32) | np.arange(len(pos))
        best = np.minimum.reduceat(order, head)
        live = (best >> 32) < int(_NONE)
        at = best[live] & 0xFFFFFFFF
        own[at] += own[at + 1]
        keep = np.ones(len(pos), bool)
        keep[at + 1] = False
        done = np.repeat(~live, np.diff(np.append(head, len(pos))))
        size[pos[done]] = own[done]
        keep &= ~done
        count = np.diff(np.append(head, len(pos)))[live] - 1
        pos, own = pos[keep], own[keep]
        head = np.cumsum(np.r_[0, count[:-1]]) if len(count) else np.zeros(0, np.int64)
    at = np.flatnonzero(size)
    return at, size[at]


def encode_run(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts, concatenated, and where each text's begin (one more entry than texts)."""
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    some = np.flatnonzero(np.diff(at) > 0)
    codes = np.insert(np.where(text == 32, SPACE, text), at[:-1][some], SPACE).astype(np.uint32)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    begin = at[:-1][some] + np.arange(len(some))
    space = codes == SPACE
    starts = space & ~np.r_[False, space[:-1]]
    starts[begin] = True
    starts = np.flatnonzero(starts)
    lengths = np.diff(np.append(starts, len(codes)))
    sums = np.r_[np.uint64(0), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), dtype=np.uint64)]
    hashes = (sums[starts + lengths] - sums[starts]) * powers(_BASE_INV, len(codes) + 1)[starts] + lengths.astype(np.uint64)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)

    size = lengths[first]
    place = np.cumsum(np.r_[0, size[:-1] + 1])
    joined = np.zeros(int((size + 1).sum()), np.uint32)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size)
    joined[np.repeat(place, size) + inside] = codes[np.repeat(starts[first], size) + inside]
    filed = edges(v, joined)
    at_, n_ = relax(v, filed, place, size)

    one = n_ == 1
    spot = np.minimum(np.searchsorted(v.single, joined[at_]), max(0, len(v.single) - 1))
    has = one & (v.single[spot] == joined[at_]) if len(v.single) else np.zeros(len(at_), bool)
    token = np.where(has, v.single_ids[spot] if len(v.single) else 0, 0).astype(np.int64)
    token[~one] = v.ids[filed[at_[~one], n_[~one]]]
    raw = np.flatnonzero(one & ~has)
    fallback = [chr(c).encode("utf-8", "replace") for c in joined[at_[raw]].tolist()]
    parts = np.ones(len(at_), np.int64)
    parts[raw] = [len(b) for b in fallback]
    ids = np.repeat(token, parts)
    if len(raw):
        from_ = np.cumsum(np.r_[0, parts[:-1]])[raw]
        inner = np.concatenate([np.arange(len(b)) for b in fallback])
        ids[np.repeat(from_, parts[raw]) + inner] = v.byte_ids[np.frombuffer(b"".join(fallback), np.uint8)]
    ends = np.cumsum(parts)
    low = np.searchsorted(at_, place)
    id_at = np.r_[0, ends][low]
    id_n = np.r_[0, ends][np.append(low[1:], len(at_))] - id_at

    n = id_n[which]
    total = np.r_[0, np.cumsum(n)]
    out = ids[np.repeat(id_at[which] - total[:-1], n) + np.arange(int(total[-1]))].astype(np.int32)
    edge = np.r_[0, np.cumsum(np.diff(at) + (np.diff(at) > 0))]
    return out, total[np.searchsorted(starts, edge)]


def decode_run(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of lists of ids, and where each begins; a leading space is the model's own and goes."""
    ids = np.where((ids >= 0) & (ids < len(v.surface_at) - 1), ids, 0)
    n = np.diff(v.surface_at)[ids]
    total = np.r_[0, np.cumsum(n)]
    data = v.surface[np.repeat(v.surface_at[ids] - total[:-1], n) + np.arange(int(total[-1]))] if total[-1] else np.zeros(0, np.uint8)
    ends = total[at]
    lead = ends[:-1][np.diff(ends) > 0]
    lead = lead[data[lead] == 32]
    gone = np.zeros(len(data) + 1, np.int64)
    gone[lead + 1] = 1
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], ends - np.cumsum(gone)[ends]


def _strings(data: np.ndarray, at: np.ndarray, null: np.ndarray) -> pa.Array:
    out = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
    return pa.array([None if x else y for x, y in zip(null.tolist(), out.to_pylist(), strict=True)], pa.string()) if null.any() else out


def _encoder(v: Vocabulary, column: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            null = np.asarray(texts.is_null())
            for a, b, data, offsets in slices(texts, RUN):
                ids, at = encode_run(v, data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                if null[a:b].any():
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null[a:b], False)), pa.array(ids))
                more = [lists]
                if check:
                    more.append(_strings(*decode_run(v, ids, at), null[a:b]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "__ids", *["__decoded"] * check])

    return run


def _decoder(v: Vocabulary, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            null = np.asarray(lists.is_null())
            n = np.where(null, 0, np.asarray(lists.value_lengths().fill_null(0)))
            ids = np.asarray(lists.flatten().fill_null(0)).astype(np.int64)
            text = _strings(*decode_run(v, ids, np.r_[0, np.cumsum(n)]), null)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "__decoded"])

    return run


def _mapped(docs: DataFrame, column: str, run, more: str, names: list[str]) -> DataFrame:
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = inner.mapInArrow(run(f"c{docs.columns.index(column)}"), f"{kinds}, {more}")
    return out.toDF(*docs.columns, *names)


def encode(spark: SparkSession, docs: DataFrame, text: str = "text", into: str = "ids", model: str = MODEL, check: str | None = None) -> DataFrame:
    """docs and the column `into` (array<int>); check: name of a column for the decoding of those ids."""
    ship(spark)
    v = load(model)
    return _mapped(docs, text, lambda c: _encoder(v, c, bool(check)), "__ids array<int>" + ", __decoded string" * bool(check), [into, *([check] if check else [])])


def decode(spark: SparkSession, docs: DataFrame, ids: str = "ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """docs and the text of their ids."""
    ship(spark)
    v = load(model)
    return _mapped(docs, ids, lambda c: _decoder(v, c), "__decoded string", [into])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(chr(SPACE)), F.lit(" ")))
    return encode(spark, docs, check="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip")
    )
