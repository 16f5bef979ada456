"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a piece of text forwards and backwards; at every byte a
softmax over their two states labels that position, and the mean of the labels over all
positions of a document is its probability of each language. Training is backpropagation
through time in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import held_out, prepare
from cuelattice.llm.textscan import slices, texts_of

FOLDS, FOLD = 3, 1
SAMPLE, MOST = 512, 1 << 14  # training windows for each language at most, and of all together
LANGUAGES = 512  # the most frequent ones, which are learnt
WINDOW = 256  # characters of a training window at most; all its bytes are learnt from
HIDDEN, STEPS = 8, 128  # units in each direction; bytes that the state is carried over
EPOCHS, BATCH, RATE = 6, 64, 0.02
BLOCK = 1024  # pieces that are labelled at once
UNKNOWN = "und"


def _tanh_gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Gru:
    """One direction: for each byte a row of inputs to the gates, and recurrent weights."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.inputs = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.gates = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.new = rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)

    def states(self, pieces: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, pieces, hidden) over pieces (steps, pieces) of bytes; zero where not live."""
        k = self.new.shape[0]
        out = np.zeros((*pieces.shape, k), np.float32)
        h = np.zeros((pieces.shape[1], k), np.float32)
        for t in range(len(pieces)):
            a = self.inputs[pieces[t]]
            g = h @ self.gates
            g += a[:, : 2 * k]
            _tanh_gate(g)
            z, r = g[:, :k], g[:, k:]
            s = r * h
            n = s @ self.new
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, s, n))
            h = h + z * (n - h)
            h *= live[t][:, None]
            out[t] = h
        return out

    def gradients(self, pieces: np.ndarray, live: np.ndarray, kept: list, into: np.ndarray) -> list[np.ndarray]:
        """Gradients of inputs, gates and new, given those of the states; backwards through time."""
        k = self.new.shape[0]
        d_in, d_gates, d_new = (np.zeros_like(x) for x in (self.inputs, self.gates, self.new))
        d = np.zeros((pieces.shape[1], k), np.float32)
        for t in range(len(pieces) - 1, -1, -1):
            h, z, r, s, n = kept[t]
            d = (d + into[t]) * live[t][:, None]
            a_n = d * z * (1 - n * n)
            d_s = a_n @ self.new.T
            a_g = np.concatenate([d * (n - h) * z * (1 - z), d_s * h * r * (1 - r)], axis=1)
            d_new += s.T @ a_n
            d_gates += h.T @ a_g
            np.add.at(d_in, pieces[t], np.concatenate([a_g, a_n], axis=1))
            d = d * (1 - z) + d_s * r + a_g @ self.gates.T
        return [d_in, d_gates, d_new]


class Tagger:
    """The network: two directions and a softmax at each position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.ahead, self.back = labels, Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*(getattr(g, n) for g in (self.ahead, self.back) for n in ("inputs", "gates", "new")), self.out, self.bias]

    def _logits(self, pieces: np.ndarray, live: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        one, two = keep or (None, None)
        both = np.concatenate([self.ahead.states(pieces, live, one), self.back.states(pieces[::-1], live[::-1], two)[::-1]], axis=2)
        return both, both.reshape(-1, both.shape[2]) @ self.out + self.bias

    def label(self, pieces: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sum over the live positions of each piece of the probability of each label."""
        _, logits = self._logits(pieces, live)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (live.reshape(-1) / logits.sum(axis=1))[:, None]
        return logits.reshape(*pieces.shape, -1).sum(axis=0, dtype=np.float64)

    def fit(self, texts: list[bytes], gold: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> None:
        """Adam on the mean cross entropy of all positions."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        pieces, live, owner = _pieces(texts)
        gold = gold[owner]
        for epoch in range(epochs):
            order = rng.permutation(len(owner))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                x, on, y = pieces[:, pick], live[:, pick], gold[pick]
                keep: tuple[list, list] = ([], [])
                both, p = self._logits(x, on, keep)
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p = p.reshape(*x.shape, -1)
                p[:, np.arange(len(pick)), y] -= 1
                p *= on[:, :, None] / max(1.0, on.sum())
                d = p.reshape(-1, len(self.labels))
                into = (d @ self.out.T).reshape(both.shape)
                k = both.shape[2] // 2
                grads = [
                    *self.ahead.gradients(x, on, keep[0], into[:, :, :k]),
                    *self.back.gradients(x[::-1], on[::-1], keep[1], into[::-1, :, k:]),
                    both.reshape(-1, 2 * k).T @ d,
                    d.sum(axis=0),
                ]
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                pace = rate * (1 - epoch / epochs)
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    g = g * min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _pieces(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in pieces of some bytes, a column each, which bytes of them are there, and the text of each."""
    cut = [(i, t[a : a + steps]) for i, t in enumerate(texts) for a in range(0, len(t), steps)]
    out, live = np.zeros((steps, len(cut)), np.uint8), np.zeros((steps, len(cut)), np.float32)
    for k, (_, t) in enumerate(cut):
        out[: len(t), k], live[: len(t), k] = np.frombuffer(t, np.uint8), 1
    return out, live, np.array([i for i, _ in cut], np.int64)


def has_letter(text: bytes | None) -> bool:
    return any(map(str.isalpha, (text or b"").decode("utf-8", "replace")))


def pooled(model: Tagger, texts: list[bytes | None]) -> np.ndarray:
    """Mean over all bytes of each text of the labels' probabilities (zero for an empty one).

    Texts are cut into pieces of STEPS bytes, every byte in one piece; BLOCK pieces of
    about one length are labelled at once, so that a long text takes no more memory.
    """
    size = np.array([len(t or b"") for t in texts])
    count = -(-size // STEPS)
    flat = np.frombuffer(b"".join(t or b"" for t in texts) + bytes(STEPS), np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    ends = np.cumsum(count)
    nth = np.arange(len(owner)) - np.repeat(ends - count, count)
    begin = np.repeat(np.cumsum(size) - size, count) + nth * STEPS
    length = np.minimum(STEPS, np.repeat(size, count) - nth * STEPS)
    total = np.zeros((len(texts), len(model.labels)))
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), BLOCK):
        pick = order[i : i + BLOCK]
        step = np.arange(int(length[pick[0]]))[:, None]
        np.add.at(total, owner[pick], model.label(flat[begin[pick] + step], (step < length[pick]).astype(np.float32)))
    return total / np.maximum(size, 1)[:, None]


def training_windows(docs: DataFrame, sample: int = SAMPLE, most: int = MOST, languages: int = LANGUAGES) -> DataFrame:
    """(lang, slot, piece): up to sample windows for each language, one from a document each, and most in all.

    The languages are the most frequent ones, the first by name where as many documents
    have them. Documents are dealt into slots by a hash of their id; of each slot and
    language the one with the smallest hash gives a window at a place that its hash fixes.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    chosen = [r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()]
    slots = max(1, min(sample, most // max(1, len(chosen))))
    h = F.xxhash64("doc_id", "text")
    at = F.pmod(h, F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    piece = F.substring("text", at, F.lit(WINDOW))
    found = known.where(F.col("lang").isin(chosen)).select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"), F.struct(h.alias("h"), piece.alias("piece")).alias("w"))
    return found.groupBy("lang", "slot").agg(F.min("w").alias("w")).select("lang", "slot", "w.piece")


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A model from a bounded sample of labelled rows; None if there are none."""
    rows = sorted((r["lang"], r["slot"], r["piece"].encode()) for r in training_windows(docs, sample).collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    model = Tagger(labels)
    model.fit([r[2] for r in rows], np.array([labels.index(r[0]) for r in rows]))
    return model


def _predict(shared) -> Callable:  # shared: a broadcast model
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tagger | None = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                told = np.array([model is not None and has_letter(t) for t in texts], bool)
                p = pooled(model, [t if k else b"" for t, k in zip(texts, told, strict=True)]) if model else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                lang = [model.labels[b] if k else UNKNOWN for b, k in zip(best, told, strict=True)]
                score = np.where(told, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from text and lang of documents outside the held-out fold, SAMPLE windows for
    each of the LANGUAGES most frequent languages at most. lang_pred is one of the languages learnt, with its pooled
    probability as score; a text that is null or has no letter, and every text if there
    is nothing to learn from, is `und` with score 0. Of equal probabilities the first
    language wins. A null doc_id is never held out; repeated rows keep a row each; extra
    columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = train(docs.where(~held_out("doc_id", folds, fold)), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")
