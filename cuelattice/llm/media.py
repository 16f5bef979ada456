"""Audio features of media columns.

A payload is stored without loss as 8-bit samples of a WAV file. The samples read back are
resampled by a polyphase filter, cut into overlapping frames with a log-mel filterbank,
and split into active spans by an energy threshold with hysteresis. The filterbank output
is stored as fixed-shape Arrow tensors, each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuelattice.llm.common import prepare
from cuelattice.llm.textscan import slices, texts_of

RATE, UP, DOWN, REACH = 16_000, 2, 5, 10  # samples a second, resampling by UP / DOWN, zero crossings of the filter
FRAME, HOP, BANDS, CLIP = 256, 128, 24, 32  # in resampled samples; bands and frames of a tensor
BLOCK_FRAMES = 4096
UNIT = 64  # payloads are padded to a multiple of this
HIGH, LOW = 0.5, -0.25  # a span opens above the mean by so many deviations, and closes below the lower one
FLOOR = 1e-8


def payload(text: bytes | None) -> bytes:
    """The bytes and then zeros up to a positive multiple of UNIT."""
    raw = text or b""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with one unsigned byte for each sample."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(pad)


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file; chunks of other kinds are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono files of 8 bits are read")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def _filter() -> np.ndarray:
    """The windowed-sinc low-pass filter as one column for each of UP phases."""
    half = REACH * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(UP, DOWN)) * np.kaiser(2 * half + 1, 5.0)
    taps *= UP / taps.sum()
    width = -(-(2 * half + 1) // UP) + -(-(UP - 1) * DOWN // UP)
    bank = np.zeros((width, UP))
    for p in range(UP):  # output UP * k + p is centred at (UP * k + p) * DOWN in steps of 1 / UP samples
        for j in range(width):
            i = (j - half // UP) * UP - p * DOWN
            if -half <= i <= half:
                bank[j, p] = taps[half - i]
    return bank.astype(np.float32)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Resampled values first to first + count of 8-bit samples; silence outside them."""
    bank = _filter()
    half = REACH * max(UP, DOWN) // UP
    a, groups = first // UP, -(-(first + count) // UP) - first // UP
    begin, end = a * DOWN - half, (a + groups - 1) * DOWN - half + len(bank)
    piece = np.zeros(end - begin, np.float32)
    lo, hi = max(begin, 0), min(end, len(samples))
    if hi > lo:
        piece[lo - begin : hi - begin] = (samples[lo:hi].astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.as_strided(piece, (groups, len(bank)), (piece.strides[0] * DOWN, piece.strides[0]))
    return (np.ascontiguousarray(view) @ bank).ravel()[first - a * UP : first - a * UP + count]


@cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """Window of a frame, and the triangular filterbank over its spectrum."""
    rate = RATE * UP / DOWN
    edges = 700 * (np.exp(np.linspace(0, np.log1p(rate / 2 / 700), BANDS + 2)) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise = (freq - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - freq) / np.diff(edges)[1:]
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log energies of all overlapped frames by band, and each frame's log energy.

    Frame i is centred on samples i * HOP to (i + 1) * HOP of the resampled signal, with
    silence beyond its ends, so that there is a frame for each HOP begun. The samples are
    taken in blocks of BLOCK_FRAMES frames, so that beyond its result the memory is the
    same for samples of any length.
    """
    window, bank = _mel()
    n = -(-len(samples) * UP // DOWN)
    frames, lead = max(1, -(-n // HOP)), (FRAME - HOP) // 2
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(frames, a + BLOCK_FRAMES)
        x = resample(samples, a * HOP - lead, (b - a - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
        power = np.square(np.abs(np.fft.rfft(cut, axis=1))).astype(np.float32)
        mel[a:b] = np.log(power @ bank + FLOOR)
        energy[a:b] = np.log(power.sum(axis=1) + FLOOR)
    return mel, energy


def active_spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [first, end) of spans that open at the high threshold and last to the low one."""
    mean, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + HIGH * spread, 1, np.where(energy < mean + LOW * spread, -1, 0))
    if spread == 0:
        return []
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    edge = np.diff(np.r_[0, (mark[last] == 1).astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def to_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of clips: start and end in seconds and a CLIP x BANDS tensor each."""
    clips = -(-len(mel) // CLIP)
    full = np.full((clips * CLIP, BANDS), np.log(np.float32(FLOOR)), np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (CLIP, BANDS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CLIP * BANDS)
    start = [_seconds(i * CLIP) for i in range(clips)]
    end = [_seconds(min(len(mel), (i + 1) * CLIP)) for i in range(clips)]
    table = pa.record_batch([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time spans (clips, 2) and tensors (clips, CLIP, BANDS) of such a stream."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    tensor = table.column("log_mel").chunk(0).to_numpy_ndarray()
    return np.stack([table.column("start_s").to_numpy(), table.column("end_s").to_numpy()], axis=1), tensor


def describe(text: bytes | None) -> dict:
    """Everything that audio_features returns of one text but its doc_id."""
    media = to_wav(payload(text))
    _, back = from_wav(media)
    mel, energy = log_mel(np.frombuffer(back, np.uint8))
    spans = active_spans(energy)
    tensors = to_tensors(mel)
    times, clips = from_tensors(tensors)
    digest = hashlib.sha256(np.round(clips, 3).tobytes() + repr(spans).encode()).hexdigest()[:24]
    return {
        "n_bytes": len(text or b""),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-UNIT:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"clips={len(clips)};seconds={times[-1][1]:.3f};spans={len(spans)};mel={float(mel.mean()):.3f};{digest}",
        "spans": [{"start_s": _seconds(a), "end_s": _seconds(b)} for a, b in spans],
        "tensors": tensors,
        "media": media,
    }


_FIELDS = {
    "doc_id": pa.int64(),
    "n_bytes": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "feature": pa.string(),
    "spans": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])),
    "tensors": pa.binary(),
    "media": pa.binary(),
}
_KIND = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _featurise(with_media: bool):
    names = list(_FIELDS)[: None if with_media else 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [describe(t) | {"doc_id": i} for i, t in zip(part.column(0).to_pylist(), texts_of(part), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FIELDS[c]) for c in names], names=names)

    return run


def audio_features(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Media and audio features of every text, from the bytes as stored and read back.

    with_media: also spans (active spans in seconds), tensors (an Arrow stream, see
    from_tensors) and media (the WAV file). A null text is an empty one, which is 64
    zeros. Equal texts have equal values whatever rows they come with. Repeated rows keep
    a row each, extra columns are ignored, and an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    more = ", spans array<struct<start_s:double,end_s:double>>, tensors binary, media binary" if with_media else ""
    return docs.select("doc_id", "text").mapInArrow(_featurise(with_media), _KIND + more)
