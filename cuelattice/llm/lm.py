"""Language-model scores from a log-frequency Bloom filter.

Texts are packed into chunks. A chunk asks for its words, pairs and triples, each once and
with the number of times it occurs in training text, of buckets by hash. So
a bucket gets all there is to know of its n-grams: it adds up their counts, turns a count c
into the level 1 + floor(log2 c) and enters (n-gram, 1) to (n-gram, level) in its shard of
the Bloom filter. Every n-gram that a chunk asked for is then probed with 1, 2 and so on
until one probe fails; the levels reached go back to the chunk, whose texts are scored by
the mean counts of these levels. Triples fall back on pairs and these on words. The shards
grow with the corpus, about BITS_PER_ENTRY bits for each level of each n-gram, and nothing
is left out of them; what is broadcast to all workers are three totals. Beside that score
stands an exact add-one word model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.chunks import buckets_for, chunked, heads, pack, places, rows_of, sent, unpack
from cuelattice.llm.common import held_out, prepare
from cuelattice.llm.textscan import Scan, mix64, texts_of

FOLDS, FOLD = 7, 2
CHUNK_BYTES = 10 << 20  # of text that asks for its n-grams at once, about
BITS_PER_ENTRY, PROBES = 10, 5  # bits of the filter for each entry at least, and bits that an entry sets
BUCKET_BYTES = 8 << 20  # of text for each bucket of n-grams, between this and half of it
BACK_OFF = (2000.0, 300.0)  # weight of the words against a bigram's history, and of the bigrams against a trigram's
FOLLOWING = 2.0  # the latter where the token before ended a known trigram, as within a passage met before
_U = np.uint64
_KEY_BITS = 48
_START, _END = _U(0x6A09E667F3BCC908), _U(0xBB67AE8584CAA73B)
_A, _B, _C, _D = _U(0x8CB92BA72F3D8DD7), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _short(x: np.ndarray) -> np.ndarray:
    return mix64(x) >> _U(64 - _KEY_BITS)


def word_id(w: np.ndarray) -> np.ndarray:
    """64 bits that stand for a word; its key in the filter is the upper ones."""
    return mix64(w ^ _D)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _short(u * _A + w * _B)


def triple_key(t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _short(mix64(t * _C + u) * _A + w * _B)


OPENING = pair_key(np.array([_START]), np.array([_START]))[0]  # counted once for each text: the history of its first word


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, each text's with an end: hash, the one before, the one before that; and bounds."""
    scan = Scan(texts, lower=True)
    n = len(texts)
    ptr = scan.ptr + np.arange(n + 1)
    ends = np.zeros(ptr[-1], bool)
    ends[ptr[1:] - 1] = True
    w = np.full(ptr[-1], _END, np.uint64)
    w[~ends] = scan.hashes()
    one = np.empty_like(w)
    one[1:] = w[:-1]
    one[ptr[:-1]] = _START
    two = np.empty_like(w)
    two[1:] = one[:-1]
    two[ptr[:-1]] = _START
    return w, one, two, ptr


def pack_asked(words: np.ndarray, n: np.ndarray, grams: np.ndarray, m: np.ndarray) -> bytes:
    """Words and sorted n-grams with their counts; the n-grams as differences of 32 bits, with what goes beyond apart."""
    step = np.diff(grams, prepend=_U(0))
    high = np.flatnonzero(step >> _U(32))
    return pack(words, n.astype(np.uint32), step.astype(np.uint32), high.astype(np.uint32), (step[high] >> _U(32)).astype(np.uint32), m.astype(np.uint32))


def unpack_asked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, n, low, high, more, m = unpack(blob, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)
    step = low.astype(np.uint64)
    step[high] += more.astype(np.uint64) << _U(32)
    return words, n, np.cumsum(step, dtype=np.uint64), m


def sum_words(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words in order and the sums of their counts."""
    order = np.argsort(words)
    words, n = words[order], n[order].astype(np.int64)
    head = heads(words)
    return words[head], np.add.reduceat(n, head) if len(head) else n


def sum_grams(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for keys of 48 bits, sorted together with the lower 16 bits of their counts."""
    n = n.astype(np.uint64)
    both = np.sort(keys << _U(16) | (n & _U(0xFFFF)))
    key = both >> _U(16)
    head = heads(key)
    total = np.add.reduceat((both & _U(0xFFFF)).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    large = n >> _U(16) > 0
    np.add.at(total, np.searchsorted(key[head], keys[large]), (n[large] >> _U(16) << _U(16)).astype(np.int64))
    return key[head], total


def level_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n), and 0 for 0."""
    return np.frexp(n.astype(np.float64))[1]


def count_of(level: np.ndarray) -> np.ndarray:
    """The mean of the counts of a level, 0 for level 0."""
    return np.where(level > 0, (3.0 * np.exp2(level - 1.0) - 1) / 2, 0.0)


class LogFilter:
    """A Bloom filter of (key, 1) to (key, level) of some counted keys, sized by these entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = BITS_PER_ENTRY) -> None:
        level = level_of(counts)
        size = max(8, -(-int(level.sum()) * bits // 64))
        self.bits = np.zeros(1 << (size - 1).bit_length(), np.uint64)
        for j in range(1, int(level.max(initial=0)) + 1):
            np.bitwise_or.at(self.bits, *self._entries(keys[level >= j], j))

    def _entries(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of the filter, and the bits in it, for (key, level)."""
        g = mix64(keys + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        bits = np.zeros(len(g), np.uint64)
        for i in range(PROBES):
            bits |= _U(1) << ((g >> _U(6 * i)) & _U(63))
        return ((g >> _U(32)) & _U(len(self.bits) - 1)).astype(np.int64), bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes for 1, 2, ... until one fails."""
        out, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for j in range(1, 64):
            place, want = self._entries(keys[left], j)
            left = left[self.bits[place] & want == want]
            if not len(left):
                break
            out[left] = j
        return out


@dataclass
class Totals:
    """Of the training text: tokens, distinct tokens, and the sum of the mean counts of their levels."""

    tokens: int
    distinct: int
    coarse: float


def _read_chunk(blob: bytes) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a chunk; the hash of each token, those of its pair and its triple; whether it is for training; bounds."""
    parts = rows_of(blob)
    got, ptr = [], [np.zeros(1, np.int64)]
    for part in parts:
        w, one, two, ends = tokens(texts_of(part))
        train = np.repeat(~part.column(1).to_numpy(zero_copy_only=False), np.diff(ends))
        got.append((word_id(w), pair_key(one, w), triple_key(two, one, w), train))
        ptr.append(ends[1:] + ptr[-1][-1])
    return parts, *map(np.concatenate, zip(*got, strict=True)), np.concatenate(ptr)


def _asked(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, train: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a chunk and its distinct n-grams, in order, with their counts in training text."""
    plain, place = np.unique(words, return_inverse=True)
    n = np.bincount(place, weights=train, minlength=len(plain)).astype(np.int64)
    opening = np.full(len(ptr) - 1, OPENING)
    marks = np.r_[train, train, train[ptr[:-1]]].astype(np.uint64)
    grams = np.sort(np.r_[pairs, triples, opening] << _U(1) | marks)
    head = heads(grams >> _U(1))
    return plain, n, grams[head] >> _U(1), np.add.reduceat((grams & _U(1)).astype(np.int64), head)


def _ask(buckets: int) -> Callable:
    """From chunks (chunk, blob) what each asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, n, grams, m = _asked(*_read_chunk(blob)[1:])
                v, g = places(plain, buckets), places(grams << _U(64 - _KEY_BITS), buckets)
                full = np.flatnonzero((np.diff(v) > 0) | (np.diff(g) > 0)).tolist()
                out = [pack_asked(plain[v[b] : v[b + 1]], n[v[b] : v[b + 1]], grams[g[b] : g[b + 1]], m[g[b] : g[b + 1]]) for b in full]
                yield sent(full, chunk, out)

    return run


_ANSWERS = "bucket int, chunk long, blob binary, tokens long, distinct long, coarse double"


def _answer(bits: int) -> Callable:
    """What was asked of a bucket: exact counts of words, and levels of words and n-grams from its shard of the filter.

    Beside a row for each chunk there is one without a chunk, with the bucket's part of the totals.
    """

    def run(table: pa.Table) -> pa.Table:
        asked = [unpack_asked(x) for x in table.column("blob").to_pylist()]
        words, n, grams, m = map(np.concatenate, zip(*asked, strict=True))
        plain, total = sum_words(words, n)
        known, times = sum_grams(grams, m)
        keys = plain >> _U(64 - _KEY_BITS)
        shard = LogFilter(np.r_[keys, known], np.r_[total, times], bits)
        coarse, reached = shard.level(keys), shard.level(grams)
        out, w, g = [], 0, 0
        for a, _, b, _ in asked:
            at = np.searchsorted(plain, a)
            out.append(pack(total[at], coarse[at], reached[g : g + len(b)]))
            w, g = w + len(a), g + len(b)
        bucket, none = table.column("bucket")[0].as_py(), [None] * len(out)
        return pa.table(
            {
                "bucket": pa.array([bucket] * (len(out) + 1), pa.int32()),
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "blob": pa.array([*out, None], pa.binary()),
                "tokens": pa.array([*none, int(total.sum())], pa.int64()),
                "distinct": pa.array([*none, int((total > 0).sum())], pa.int64()),
                "coarse": pa.array([*none, float(count_of(level_of(total)).sum())], pa.float64()),
            }
        )

    return run


def log10_probabilities(c: np.ndarray, pair: np.ndarray, triple: np.ndarray, opening: float, first: np.ndarray, totals: Totals) -> np.ndarray:
    """log10 of the smoothed probability of each token after the two before it.

    c, pair and triple: mean counts of the token and of its two n-grams; opening: how many
    texts were learnt; first: where a text begins.
    """
    p = (c + 1) / (totals.coarse + totals.distinct + 1)
    history, before = np.empty_like(c), np.empty_like(c)
    history[1:] = c[:-1]
    history[first] = opening
    pair = np.where(c > 0, pair, 0.0)
    p = (np.minimum(pair, history) + BACK_OFF[0] * p) / (history + BACK_OFF[0])
    before[1:] = pair[:-1]
    before[first] = opening
    triple = np.where((pair > 0) & (before > 0), triple, 0.0)
    follows = np.r_[False, triple[:-1] > 0]
    follows[first] = False
    weight = np.where(follows, FOLLOWING, BACK_OFF[1])
    return np.log10((np.minimum(triple, before) + weight * p) / (before + weight))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shared) -> Callable:  # shared: the broadcast totals
    """Scores of a chunk from its texts (bucket -1) and the answers of all buckets."""

    def run(table: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        found = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
        parts, words, pairs, triples, train, ptr = _read_chunk(found[0][1])
        n, coarse, reached = map(np.concatenate, zip(*(unpack(x, np.int64, np.uint8, np.uint8) for _, x in found[1:]), strict=True))
        plain, place = np.unique(words, return_inverse=True)
        grams, at = np.unique(np.r_[pairs, triples, OPENING], return_inverse=True)
        if (len(plain), len(grams)) != (len(n), len(reached)):
            raise RuntimeError("the answers are not those to this chunk")
        n, c, met = n[place], count_of(coarse)[place], count_of(reached)[at]
        p = log10_probabilities(c, met[: len(c)], met[len(c) : -1], met[-1], ptr[:-1], totals)
        length = np.diff(ptr)
        base = np.add.reduceat(np.log10(n + 1.0), ptr[:-1]) - length * np.log10(totals.tokens + totals.distinct + 1)
        ids, held = (pa.chunked_array([x.column(i) for x in parts]) for i in (0, 1))
        cols = [length, np.add.reduceat(n > 0, ptr[:-1], dtype=np.int64), base, np.add.reduceat(p, ptr[:-1])]
        return pa.Table.from_arrays([ids, held, *map(pa.array, cols)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def score_documents(
    docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, bits: int = BITS_PER_ENTRY, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Scores of every document by models of those outside the held-out fold.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. A null text is
    empty: one end token. A null doc_id is never held out. Repeated rows all count in
    training and get a row each. Extra columns are ignored. An empty table gives no rows;
    with nothing to learn from every token is unknown.

    The texts are checkpointed as chunks, so that a chunk asked for again after a lost
    executor is the same; n-grams are shuffled once and their levels once. The number of
    buckets follows the bytes of text, so that a task holds a chunk or a bucket of bounded
    size at any size of the input. An n-gram that all chunks have is one entry of each.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", held_out("doc_id", folds, fold).alias("held"), "text")
    chunks, size = chunked(rows, chunk_bytes)
    asked = chunks.mapInArrow(_ask(buckets_for(size, bucket_bytes)), "bucket int, chunk long, blob binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(bits), _ANSWERS).checkpoint()
    seen = answers.agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct", "coarse")]).first()
    totals = Totals(seen["tokens"] or 0, seen["distinct"] or 0, seen["coarse"] or 0.0)
    both = chunks.select(F.lit(-1).alias("bucket"), "chunk", "blob").unionByName(answers.where("chunk IS NOT NULL").select("bucket", "chunk", "blob"))
    scored = both.groupBy("chunk").applyInArrow(_score(spark.sparkContext.broadcast(totals)), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
