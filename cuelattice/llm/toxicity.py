"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on what sets toxic text apart, one on ordinary text; both stand
beside the same larger background of ordinary text. A text is cut into windows of some
words, each is compressed with either, and the difference of the two lengths is the
window's evidence. Its weight is calibrated on labelled documents: the log ratio of how
often windows of toxic and of ordinary documents have that difference. A logistic function
of the summed weights is the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import held_out, labelled_sample, prepare
from cuelattice.llm.textscan import slices, texts_of

FOLDS, FOLD = 4, 2
THRESHOLD = 0.3
SAMPLE = {1: 2048, 0: 4096}  # labelled documents of each kind that learning takes at most
EXCERPT = 4096  # characters of each of them at most
WINDOW = 48  # bytes after which a window ends at the next space
OWN_BYTES, BACKGROUND_BYTES = 1024, 110 << 10  # of a dictionary, and of the background
GRAM, CONTRAST, RARE = 7, 12.0, 0.02  # bytes of a piece; how much commoner it must be in toxic documents, and in which share of them
SEGMENTS = {"k": 16, "d": 8}  # bytes of the segments that a small dictionary is made of
SPAN = 12  # differences beyond this count as this
_SETTINGS = {"strategy": zstandard.STRATEGY_GREEDY, "window_log": 18, "hash_log": 15, "chain_log": 15, "search_log": 3, "min_match": 5}


def windows(text: bytes) -> list[bytes]:
    """The text in pieces that end at the first space after WINDOW bytes, or at four times that."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = text.find(b" ", at + WINDOW, at + 4 * WINDOW)
        if end < 0:
            end = min(n, at + 4 * WINDOW)
        out.append(text[at:end])
        at = end
    return out


def _grams(text: bytes) -> np.ndarray:
    """A number for each GRAM consecutive bytes."""
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.int64)
    n = len(data) - GRAM + 1
    return sum(data[i : i + n] << (8 * i) for i in range(GRAM)) if n > 0 else np.zeros(0, np.int64)


def unlike(texts: list[bytes], span: int = 24, most: float = 0.2) -> list[bytes]:
    """The texts without those of which more than a share stands in earlier ones, by pieces of span bytes.

    A group of near copies would make everything in it look typical of its label.
    """
    power = np.multiply.accumulate(np.full(span, 0x9E3779B97F4A7C15, np.uint64))
    seen: set[int] = set()
    out = []
    for text in texts:
        data = np.frombuffer(text, np.uint8).astype(np.uint64)
        n = max(0, len(data) - span + 1)
        pieces = sum((data[i : i + n] * power[i] for i in range(span)), np.zeros(n, np.uint64)) >> np.uint64(8)
        some = set(pieces[pieces % np.uint64(4) == 0].tolist())
        if len(some & seen) <= most * len(some):
            seen |= some
            out.append(text)
    return out


def contrasting(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """From each toxic text the pieces that ordinary texts hardly have, where it has any."""
    def tally(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts]), return_counts=True)

    if not toxic or not ordinary:
        return []
    gram, n = tally(toxic)
    other, m = tally(ordinary)
    at = np.minimum(np.searchsorted(other, gram), len(other) - 1)
    seen = np.where(other[at] == gram, m[at], 0)
    often = (n >= max(3, RARE * len(toxic))) & (n / len(toxic) >= CONTRAST * (seen + 0.5) / len(ordinary))
    marked, out = gram[often], []
    for t in toxic:
        hit = np.zeros(len(t) + 2 + GRAM, np.int32)
        where = np.flatnonzero(np.isin(_grams(t), marked))
        np.add.at(hit, where, 1)
        np.add.at(hit, where + GRAM, -1)
        edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(hit) > 0, 0]))
        padded = b" " + t + b" "
        found = b" ".join(padded[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
        if len(found) >= 8:
            out.append(found)
    return out


def _dictionary(size: int, samples: list[bytes], **segments: int) -> bytes:
    """Content of a dictionary trained on the samples; where zstandard finds them too few or too short, their own end."""
    try:
        return zstandard.train_dictionary(size, samples, **segments).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Pair:
    """Two compressors for small windows, one with either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.two = [self._compressor(x) for x in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes) -> Callable[[bytes], bytes]:
        settings = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_SETTINGS)
        if not content:
            return zstandard.ZstdCompressor(compression_params=settings).compress
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress

    def evidence(self, text: bytes) -> np.ndarray:
        """For each window how many bytes shorter the toxic dictionary makes it, from -SPAN to SPAN, plus SPAN."""
        ordinary, toxic = self.two
        found = [len(ordinary(w)) - len(toxic(w)) for w in windows(text.lower())]
        return np.clip(np.array(found, np.int64), -SPAN, SPAN) + SPAN


@dataclass
class Model:
    """Dictionaries, the weight of each difference, and the logistic coefficients."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    coefficients: np.ndarray

    def features(self, found: np.ndarray) -> np.ndarray:
        """Of a document: 1, its summed weights, their mean, and its largest weight."""
        w = self.weights[found]
        if not len(w):
            return np.array([1.0, 0.0, 0.0, 0.0])
        return np.array([1.0, np.clip(w.sum(), -20, 20), 10 * w.mean(), w.max()])

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(found) @ self.coefficients, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of largest likelihood, by Newton's method."""
    out = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ out)
        out = out + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return out


def _dictionaries(rows: list[tuple[int, bytes]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of (label, text) rows, each with the background."""
    toxic, ordinary = ([t for label, t in rows if label == k] for k in (1, 0))
    own = _dictionary(OWN_BYTES, contrasting(unlike(toxic), ordinary), **SEGMENTS)
    background = _dictionary(BACKGROUND_BYTES, ordinary)
    return background + own, _dictionary(OWN_BYTES, ordinary[::3], **SEGMENTS) + background


def fit(rows: list[tuple[int, bytes]], share: float) -> Model:
    """A model from (label, excerpt) rows.

    Dictionaries of one half of the rows are used to calibrate on the other half, whose
    texts they have not seen; those of the model come from all rows. share: of toxic
    documents among all labelled ones, to which the score is calibrated.
    """
    rows = list(dict.fromkeys((label, text.lower()) for label, text in rows))
    check = rows[1::2]
    model = Model(*_dictionaries(rows), np.zeros(2 * SPAN + 1), np.zeros(4))
    y = np.array([label for label, _ in check])
    p = min(max(share, 1e-6), 1 - 1e-6)
    if not 0 < y.sum() < len(y):
        model.coefficients[0] = np.log(p / (1 - p))
        return model
    pair = Pair(*_dictionaries(rows[0::2]))
    found = [pair.evidence(t) for _, t in check]
    kinds = [np.bincount(np.concatenate([f for f, k in zip(found, y, strict=True) if k == v]), minlength=2 * SPAN + 1) + 0.5 for v in (1, 0)]
    model.weights = np.log(kinds[0] / kinds[0].sum()) - np.log(kinds[1] / kinds[1].sum())
    model.coefficients = _logistic(np.stack([model.features(f) for f in found]), y)
    q = y.mean()
    model.coefficients[0] += np.log(p / (1 - p)) - np.log(q / (1 - q))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows.

    A document with several labels counts as toxic if one says so. Each document of the
    sample gives an excerpt of EXCERPT characters, from a place that its hash fixes.
    """
    few = F.broadcast(labelled_sample(labels, "toxic", SAMPLE))
    h = F.xxhash64("doc_id", "text")
    at = F.pmod(h, F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(few, "doc_id")
    w = F.min(F.struct(h.alias("h"), F.substring("text", at, F.lit(EXCERPT)).alias("excerpt")))
    rows = rows.groupBy("label", "slot", "n").agg(w.alias("w")).select("label", "slot", "n", "w.excerpt").collect()
    n = {k: sum(r["n"] for r in rows if r["label"] == k) for k in (0, 1)}
    rows = sorted(rows, key=lambda r: (r["slot"], r["label"]))
    return fit([(r["label"], r["excerpt"].encode()) for r in rows], n[1] / max(1, n[0] + n[1]))


def _score(shared) -> Callable:  # shared: a broadcast model
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        pair = Pair(model.toxic, model.ordinary)
        for batch in batches:
            for part in slices(batch):
                score = [model.score(pair.evidence(t or b"")) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learnt from rows outside the held-out fold only. A null text is an empty
    one: no windows, and the score of no evidence. Without labels of both kinds the score
    is the share of toxic labels (near 0 without labels). A null doc_id is never held out
    and has no label. Repeated rows keep a row each; extra columns are ignored; an empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels.where(~held_out("doc_id", folds, fold)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(shared, threshold: float) -> Callable:  # shared: a broadcast model
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        pair = Pair(model.toxic, model.ordinary)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([model.score(pair.evidence(t or b"")) < threshold for t in texts_of(part)], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that toxicity_scores does not predict toxic, with all their columns.

    Rows pass through the scorer and are kept or not there, so nothing is shuffled.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out("doc_id", folds, fold))))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
