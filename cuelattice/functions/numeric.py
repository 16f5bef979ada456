"""Signal and picture arithmetic as Column expressions, over table-shaped data."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_curve(gamma: Column) -> Column:
    """256 output levels of a gamma curve, truncated."""
    steps = F.sequence(F.lit(0), F.lit(255))
    return F.transform(steps, lambda i: F.least(F.lit(255), (F.pow(i / F.lit(255.0), 1.0 / gamma) * 255.0).cast("int")))


def contrast(value: Column, mean: Column, factor: Column) -> Column:
    """A level moved away from the frame's mean by a factor, from 0 to 255, truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - mean) * factor + mean)).cast("int")


def shift_hue(hue: Column, degrees: Column) -> Column:
    """A hue of 0 to 179 (two degrees a step) turned by some degrees."""
    return F.pmod(hue + degrees / 2.0, F.lit(180.0))


def scale_saturation(saturation: Column, factor: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), saturation * factor))


def vignette(col: Column, row: Column, width: int, height: int) -> Column:
    """Darkening at a pixel, from 0 at the centre to 1 in the corners."""
    x = col / F.lit(max(1, width - 1)) * 2.0 - 1.0
    y = row / F.lit(max(1, height - 1)) * 2.0 - 1.0
    return F.pow(F.least(F.lit(1.0), F.sqrt(x * x + y * y) / math.sqrt(2.0)), F.lit(2.0))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on a seed and the parts alone, from 52 bits of their MD5.

    So a draw belongs to its row, whatever partition that is in, and SQL draws the same.
    """
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def grain(seed: int, *pixel: Column | str) -> Column:
    """A whole number from -128 to 128 for a pixel."""
    return F.floor(uniform(seed, *pixel) * 257).cast("int") - 128


def whole_between(low: Column, high: Column, seed: int, *parts: Column | str) -> Column:
    """A whole number from low to high, both included."""
    return low + F.least(high - low, F.floor(uniform(seed, *parts) * (high - low + 1)))


def overlay(value: Column, noise: Column, shade: Column, opacity: Column, intensity: float) -> Column:
    """A level with grain added and vignette taken away, from 0 to 255, truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value + opacity * noise - shade * intensity * opacity * 255.0)).cast("int")


def scale_intensity(value: Column, low: Column, high: Column, factor: Column) -> Column:
    """The distance from low times factor, kept from low to high."""
    return F.greatest(low, F.least(low + (value - low) * factor, high))


def extra_gain(db: Column) -> Column:
    """What a gain in dB adds to a signal of 1."""
    return F.pow(F.lit(10.0), db / 20.0) - 1.0


def noise_amplitude(rms: Column, db: Column) -> Column:
    """Amplitude of a noise that lies db below a signal's RMS."""
    return rms * F.pow(F.lit(10.0), db / 20.0)


def one_euro_alpha(cutoff: Column, step: Column) -> Column:
    """Smoothing factor of a low-pass filter for a cutoff frequency and a time step."""
    tau = 1.0 / (2.0 * math.pi * cutoff)
    return 1.0 / (1.0 + tau / step)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; 1 if either is constant, as for equal histograms."""
    n = F.size(a)

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    mean_a, mean_b = total(a.cast("array<double>")) / n, total(b.cast("array<double>")) / n
    da, db = F.transform(a, lambda x: x - mean_a), F.transform(b, lambda x: x - mean_b)
    top = total(F.zip_with(da, db, lambda x, y: x * y))
    low = F.sqrt(total(F.transform(da, lambda x: x * x)) * total(F.transform(db, lambda x: x * x)))
    return F.coalesce(F.try_divide(top, low), F.lit(1.0))


def edge_factor(index: Column, size: int) -> Column:
    """0 at the border of a grid of control points, 1 from a quarter inward."""
    return F.least(F.lit(1.0), F.least(index, size - 1 - index) / F.lit(max(1, size // 4)))


def wave(amplitude: Column, frequency: Column, phase: Column, t: Column) -> Column:
    return amplitude * F.sin(2.0 * math.pi * frequency * t + phase)


def bilinear(v00: Column, v01: Column, v10: Column, v11: Column, fx: Column, fy: Column) -> Column:
    """The value between four corners (row, column) at shares fx and fy."""
    top = v00 + (v01 - v00) * fx
    return top + (v10 + (v11 - v10) * fx - top) * fy
