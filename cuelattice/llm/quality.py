"""Quality rules: lines labelled content or boilerplate by a linear-chain random field.

Every line with a word has numeric features. A conditional random field over a document's
lines scores each label of each line and each change of label; Viterbi decoding finds the
best sequence, and a document is kept if enough of its words stand in content lines. The
weights maximise the likelihood of line labels that are worked out from labelled documents:
all lines of a good one are content, while of a poor one only those lines are boilerplate
that nearly no line of a good document is like, and one at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import labelled_sample, prepare
from cuelattice.llm.textscan import SEPARATOR, Scan, mix64, rolling, slices, texts_of, window_starts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEATED_SHARE, CONTENT_SHARE = 50, 0.5, 0.5
SAMPLE, SAMPLE_LINES = 1024, 48  # labelled documents of each kind, and lines of each, that training takes at most
ROUNDS, RATE, DECAY = 150, 0.1, 1e-3
UNLIKE = 0.98  # share of the lines of good documents that a boilerplate line of a poor one is beyond
FEATURES = ("bias", "symbols", "capitals", "digits", "bangs", "bars", "same words", "repeated line", "short", "long words", "stops")
_U = np.uint64


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_IS_SYMBOL, _IS_UPPER, _IS_DIGIT = _class(SYMBOLS), _class(bytes(range(65, 91))), _class(b"0123456789")
_IS_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_IS_BANG, _IS_BAR, _IS_STOP = _class(b"!"), _class(b"|"), _class(b".?!;:")
_IS_POINT = _class(bytes(range(0, 0x80)) + bytes(range(0xC0, 0x100)))  # first byte of a code point
_IS_POINT[SEPARATOR] = 0


def _sums(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Running count of a class of bytes, with a leading zero."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=out[1:])
    return out


@dataclass
class Lines:
    """Counts of some texts, and the lines with a word of all of them.

    ptr: index of each text's first such line (and one past the last).
    """

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    ptr: np.ndarray
    words: np.ndarray
    features: np.ndarray


def examine(texts: list[bytes | None]) -> Lines:
    """Base counts and line features of some texts."""
    scan = Scan(texts)
    data, start = scan.data, scan.start
    inside = (start[:-1], start[1:] - 1)
    words = np.diff(scan.ptr)
    hashes = scan.hashes()

    first = window_starts(scan.ptr, 3)
    owner = np.searchsorted(scan.ptr, first, "right") - 1
    _, place, times = np.unique(mix64(rolling(hashes, 3)[first] + owner.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    step = np.zeros(len(hashes) + 1, np.int32)
    again = first[times[place] > 1] if len(first) else first
    np.add.at(step, again, 1)
    np.add.at(step, again + 3, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)] if len(hashes) else np.zeros(1, np.int64)

    breaks = np.flatnonzero(data == 10)
    a = np.sort(np.r_[start[:-1], breaks + 1])
    b = np.sort(np.r_[breaks, start[1:] - 1])
    w_a, w_b = np.searchsorted(scan.ws, a), np.searchsorted(scan.ws, b)
    full = w_b > w_a
    a, b, w_a, w_b = a[full], b[full], w_a[full], w_b[full]
    line_doc = np.searchsorted(start, a, "right") - 1
    ptr = np.searchsorted(line_doc, np.arange(len(texts) + 1))
    raw = memoryview(data.tobytes())
    dup, seen, last = np.zeros(len(a), np.int64), set(), -1
    for i, (p, q, d) in enumerate(zip(a.tolist(), b.tolist(), line_doc.tolist(), strict=True)):
        if d != last:
            seen, last = set(), d
        line = bytes(raw[p:q])
        dup[i] = line in seen
        seen.add(line)

    def count(table: np.ndarray) -> np.ndarray:
        sums = _sums(table, data)
        return sums[b] - sums[a]

    def whole(table: np.ndarray) -> np.ndarray:
        sums = _sums(table, data)
        return sums[inside[1]] - sums[inside[0]]

    n = w_b - w_a
    points, letters = count(_IS_POINT), count(_IS_LETTER)
    line_of = np.repeat(np.arange(len(a)), n)
    _, back = np.unique(mix64(hashes + line_of.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), return_index=True)
    distinct = np.bincount(line_of[back], minlength=len(a))
    features = np.stack(
        [
            np.ones(len(a)),
            np.minimum(1, count(_IS_SYMBOL) / n),
            count(_IS_UPPER) / np.maximum(1, letters),
            count(_IS_DIGIT) / np.maximum(1, points),
            np.minimum(1, count(_IS_BANG) / n),
            np.minimum(1, count(_IS_BAR) / n),
            1 - distinct / n,
            dup,
            n < 4,
            np.minimum(1, points / n / 20),
            np.minimum(1, count(_IS_STOP) / n),
        ],
        axis=1,
    ).astype(np.float64)
    dup_before = np.r_[0, np.cumsum(dup)]
    return Lines(words, whole(_IS_POINT), whole(_IS_SYMBOL), dup_before[ptr[1:]] - dup_before[ptr[:-1]], covered[scan.ptr[1:]] - covered[scan.ptr[:-1]], ptr, n, features)


class LineField:
    """A conditional random field with two labels, 1 for content and 0 for boilerplate."""

    def __init__(self) -> None:
        self.emit = np.zeros((len(FEATURES), 2))
        self.emit[0, 1] = 1e-6  # untrained, every line is content
        self.change = np.zeros((2, 2))

    def fit(self, x: np.ndarray, live: np.ndarray, gold: np.ndarray) -> None:
        """x: (documents, lines, features), live: which lines there are, gold: a label for each line.

        Gradient ascent (Adam) on the log-likelihood, by the forward and backward sums.
        """
        n, steps, _ = x.shape
        weights = [self.emit, self.change]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        weight = 1 / np.maximum(1, live.sum(axis=1))  # each document counts once
        share = weight / n
        target = np.eye(2)[gold] * live[:, :, None]
        follow = live[:, 1:] * live[:, :-1]
        changes = np.einsum("nsk,nsj->nkj", target[:, :-1], target[:, 1:])
        for t in range(1, ROUNDS + 1):
            score = x @ self.emit
            ahead, back = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            ahead[:, 0] = score[:, 0]
            for i in range(1, steps):
                came = np.logaddexp(ahead[:, i - 1, :1] + self.change[0], ahead[:, i - 1, 1:] + self.change[1]) + score[:, i]
                ahead[:, i] = np.where(live[:, i, None] > 0, came, ahead[:, i - 1])
            for i in range(steps - 2, -1, -1):
                nxt = score[:, i + 1] + back[:, i + 1]
                went = np.logaddexp(self.change[:, 0] + nxt[:, :1], self.change[:, 1] + nxt[:, 1:])
                back[:, i] = np.where(live[:, i + 1, None] > 0, went, 0.0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.exp(ahead + back - total[:, None, None]) * live[:, :, None]
            pair = ahead[:, :-1, :, None] + self.change + (score + back)[:, 1:, None, :] - total[:, None, None, None]
            pair = np.exp(np.minimum(pair, 0)) * follow[:, :, None, None]
            wanted = target - p
            g_emit = np.einsum("nsf,nsk,n->fk", x, wanted, share) - DECAY * self.emit
            g_change = np.einsum("nkj,n->kj", changes - pair.sum(axis=1), share) - DECAY * self.change
            for w, g, a, b in zip(weights, (g_emit, g_change), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w += RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)

    def decode(self, features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The best label of each line: Viterbi over all documents at once, line by line."""
        score = features @ self.emit
        size = np.diff(ptr)
        order = np.argsort(-size, kind="stable")
        first, size = ptr[:-1][order], size[order]
        came = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(order), 2))
        steps = int(size[0]) if len(size) else 0
        on = len(order)
        counts = np.searchsorted(-size, -np.arange(steps + 1), "left")  # documents with more lines than i
        for i in range(steps):
            on = int(counts[i])
            row = first[:on] + i
            if i == 0:
                best[:on] = score[row]
                continue
            stay = best[:on, :, None] + self.change
            came[row] = stay.argmax(axis=1)
            best[:on] = stay.max(axis=1) + score[row]
        out = np.zeros(len(score), np.int8)
        now = np.zeros(len(order), np.int8)
        for i in range(steps - 1, -1, -1):
            on = int(counts[i])
            row = first[:on] + i
            ends = size[:on] == i + 1
            now[:on] = np.where(ends, best[:on].argmax(axis=1), now[:on])
            out[row] = now[:on]
            now[:on] = came[row, now[:on]]
        return out


def line_labels(x: np.ndarray, live: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A label for each line of some documents, of which it is known whether they are good.

    A logistic model of single lines tells how much each is like those of poor documents,
    every document counting once. In a poor document the lines beyond the UNLIKE share of
    the lines of good ones are boilerplate, and its most extreme line always.
    """
    line = live > 0
    f, y = x[line], np.repeat(~good, line.sum(axis=1)).astype(float)
    n = np.repeat(1 / np.maximum(1, line.sum(axis=1)), line.sum(axis=1))
    n *= np.where(y > 0, 0.5 / max(1, (~good).sum()), 0.5 / max(1, good.sum())) * len(good)
    w, keep = np.zeros(x.shape[2]), 1e-1 * np.eye(x.shape[2])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (n * p * (1 - p))[:, None]).T @ f + keep, f.T @ (n * (y - p)) - keep @ w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    score = np.where(line, x @ w, -np.inf)
    beyond = np.quantile(score[good][line[good]], UNLIKE)
    poor = (score > beyond) | (score == score.max(axis=1, keepdims=True))
    return (~(poor & ~good[:, None])).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a run of lines of each document; doc columns: label, slot, h, text."""
    for batch in batches:
        for part in slices(batch):
            seen = examine(texts_of(part))
            at = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = []
            for i, (p, q) in enumerate(zip(seen.ptr[:-1].tolist(), seen.ptr[1:].tolist(), strict=True)):
                p += int(at[i]) % max(1, q - p - SAMPLE_LINES + 1)
                rows.append(seen.features[p : min(q, p + SAMPLE_LINES)].astype("<f4").tobytes() if seen.n_words[i] >= MIN_WORDS else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rows, pa.binary())], names=["label", "slot", "h", "x"])


def train(docs: DataFrame, labels: DataFrame) -> LineField:
    """A field fitted to a bounded sample of labelled documents of MIN_WORDS words or more.

    Without both labels the field is untrained.
    """
    few = F.broadcast(labelled_sample(labels, "quality", {1: SAMPLE, 0: SAMPLE}))
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("label", "slot", F.xxhash64("doc_id", "text").alias("h"), "text")
    few = rows.mapInArrow(_sampled, "label int, slot long, h long, x binary").where("x IS NOT NULL")
    few = few.groupBy("label", "slot").agg(F.min(F.struct("h", "x")).alias("b")).select("label", "slot", "b.x")
    got = sorted((r["label"], r["slot"], bytes(r["x"])) for r in few.collect())
    field = LineField()
    if len({label for label, _, _ in got}) < 2:
        return field
    x, live = np.zeros((len(got), SAMPLE_LINES, len(FEATURES))), np.zeros((len(got), SAMPLE_LINES))
    for i, (_, _, blob) in enumerate(got):
        lines = np.frombuffer(blob, "<f4").reshape(-1, len(FEATURES))
        x[i, : len(lines)], live[i, : len(lines)] = lines, 1
    field.fit(x, live, line_labels(x, live, np.array([label > 0 for label, _, _ in got])))
    return field


_KIND = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def _judge(shared) -> Callable:  # shared: a broadcast field
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LineField = shared.value
        for batch in batches:
            for part in slices(batch):
                seen = examine(texts_of(part))
                label = model.decode(seen.features, seen.ptr)
                content = np.r_[0, np.cumsum(seen.words * label)]
                share = (content[seen.ptr[1:]] - content[seen.ptr[:-1]]) / np.maximum(1, seen.n_words)
                failed = (seen.n_words < MIN_WORDS) | (100 * seen.n_repeat_words > 100 * REPEATED_SHARE * seen.n_words)
                cols = [seen.n_words, seen.word_chars, seen.n_symbols, seen.n_dup_lines, seen.n_repeat_words, failed, ~failed & (share >= CONTENT_SHARE), share]
                names = [c.split()[0] for c in _KIND.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=names)

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, content_share and kept of every document.

    kept is false if the base rules fail, else whether at least CONTENT_SHARE of the words
    stand in lines labelled content. A null text has no words and fails. Lines are parted
    by a line feed alone; lines without a word are left out. Repeated rows keep a row each
    and extra columns are ignored; an empty table gives no rows. Without labels of both
    kinds every line is content, and the base rules alone decide.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.select("doc_id", "text").mapInArrow(_judge(shared), _KIND)
