"""Audio segments as arrays of 16-bit samples: tempo, a three-band equaliser and ambient noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.sources.storage import ship_package

# The bands of the equaliser in Hz, what counts as no gain, and the shortest part that is filtered.
BANDS = {"bass": (20.0, 250.0), "mid": (250.0, 4000.0), "treble": (4000.0, 20000.0)}
SILENT_DB, SHORTEST_S = 0.01, 0.01
LOW, HIGH = -(1 << 15), (1 << 15) - 1


def _whole(samples: np.ndarray) -> np.ndarray:
    return np.clip(samples, LOW, HIGH).astype(np.int16)


def change_tempo(samples: np.ndarray, factor: float) -> np.ndarray:
    """The samples spread over 1 / factor as many by their spectrum; a factor of 1 changes nothing."""
    n = len(samples)
    if not n or abs(factor - 1) < 1e-6:
        return samples
    m = max(1, round(n / factor))
    old, new, keep = np.fft.rfft(samples.astype(float)), np.zeros(m // 2 + 1, complex), min(n, m)
    new[: keep // 2 + 1] = old[: keep // 2 + 1]
    if keep % 2 == 0 and m != n:
        new[keep // 2] *= 2.0 if m < n else 0.5  # the middle of the shorter spectrum stands for two
    return _whole(np.fft.irfft(new, m) * (m / n))


def band_sections(low: float, high: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """A Butterworth band-pass filter of second order as two sections (b, a); none if the band is empty.

    The two poles of the low-pass filter become four about the band's middle, and the
    bilinear map with both edges pre-warped takes them to the unit circle's inside.
    """
    low, high = low / (rate / 2), min(high / (rate / 2), 0.99)
    if not 0 < low < high:
        return []
    one, two = (4 * np.tan(np.pi * e / 2) for e in (low, high))
    width, middle = two - one, np.sqrt(one * two)
    half = np.exp(1j * np.pi * np.array([3 / 4, 5 / 4])) * width / 2
    spread = np.sqrt(half**2 - middle**2)
    poles = np.concatenate([half + spread, half - spread])
    gain = float(np.real(16 * width**2 / np.prod(4 - poles)))
    inside = (4 + poles) / (4 - poles)
    upper = sorted(inside[inside.imag > 0], key=abs)
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]
    return [(sections[0][0] * gain, sections[0][1]), *sections[1:]]


def run_sections(rows: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All rows of a matrix filtered along its columns, one section after another."""
    out = rows.astype(float).T.copy()
    for b, a in sections:
        one, two = np.zeros(out.shape[1]), np.zeros(out.shape[1])
        for i in range(len(out)):
            x = out[i].copy()
            y = b[0] * x + one
            one, two = b[1] * x - a[1] * y + two, b[2] * x - a[2] * y
            out[i] = y
    return out.T


def equalise(parts: list[np.ndarray], gains: list[dict[str, float]], rate: float) -> list[np.ndarray]:
    """Each part with its gain in dB of each band added: 10 ** (dB / 20) - 1 times the band on top of the whole.

    A gain near 0 leaves its band out, and a part too short is not filtered at all. Parts are
    filtered together, step by step.
    """
    active = [len(p) >= SHORTEST_S * rate for p in parts]
    if not any(active):
        return parts
    matrix = np.zeros((len(parts), max(map(len, parts))))
    for i, p in enumerate(parts):
        matrix[i, : len(p)] = p
    total, touched = matrix.copy(), np.zeros(len(parts), bool)
    for band, edges in BANDS.items():
        db = np.array([g[band] if on else 0.0 for g, on in zip(gains, active, strict=True)])
        some = np.abs(db) >= SILENT_DB
        sections = band_sections(*edges, rate)
        if sections and some.any():
            total[some] += (10 ** (db[some] / 20) - 1)[:, None] * run_sections(matrix[some], sections)
        touched |= some
    return [_whole(total[i, : len(p)]) if touched[i] else p for i, p in enumerate(parts)]


def pink_noise(n: int, rng: np.random.Generator) -> np.ndarray:
    """Noise whose amplitude falls with the root of the frequency, without a constant part, of an RMS of 1."""
    if not n:
        return np.zeros(0)
    spectrum, f = np.fft.rfft(rng.normal(size=n)), np.fft.rfftfreq(n)
    spectrum[0], f[0] = 0, 1
    noise = np.fft.irfft(spectrum / np.sqrt(f), n)
    rms = np.sqrt((noise**2).mean())
    return noise / rms if rms > 0 else noise


def with_noise(samples: np.ndarray, db: float, rng: np.random.Generator) -> np.ndarray:
    """The samples with pink noise that lies db from their own RMS; of silence as if that were 1."""
    if not len(samples):
        return samples
    rms = max(1, int(np.sqrt((samples.astype(float) ** 2).mean())))
    noise = _whole(pink_noise(len(samples), rng) * (rms * 10 ** (db / 20)))
    return _whole(samples.astype(np.int64) + noise)


def process(segments: DataFrame, rate: float, seed: int) -> DataFrame:
    """clip, seg_idx and samples of segments(clip, seg_idx, samples, tempo, bass, mid, treble, noise_db), processed in this order.

    A null list of samples is an empty one, which stays so. Noise is drawn from the seed, the
    clip and the number of the segment, so that reruns agree.
    """
    ship_package(segments.sparkSession)
    flat = segments.select("clip", "seg_idx", F.col("samples").cast("array<int>").alias("samples"), *[F.col(c).cast("double").alias(c) for c in ("tempo", *BANDS, "noise_db")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [change_tempo(np.array([] if s is None else s, np.int16), t) for s, t in zip(rows["samples"], rows["tempo"], strict=True)]
            parts = equalise(parts, rows[list(BANDS)].to_dict("records"), rate)
            made = [with_noise(p, db, np.random.default_rng([seed, int(c), int(i)])) for p, db, c, i in zip(parts, rows["noise_db"], rows["clip"], rows["seg_idx"], strict=True)]
            yield pd.DataFrame({"clip": rows["clip"], "seg_idx": rows["seg_idx"], "samples": [m.astype(np.int32) for m in made]})

    return flat.mapInPandas(run, "clip long, seg_idx long, samples array<int>")


def concatenated(segments: DataFrame) -> DataFrame:
    """segments(clip, seg_idx, samples) with start, the place of each one's first sample in its clip."""
    before = Window.partitionBy("clip").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)).cast("long"))
