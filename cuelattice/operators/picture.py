"""Colour of pixels in tables: gamma, contrast, and hue and saturation, one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.functions import numeric as N

CHANNELS = ("r", "g", "b")


def gamma_level(level: Column, gamma: Column) -> Column:
    """A level of 0 to 255 on a gamma curve, truncated; a gamma of 1 leaves it."""
    return F.when(gamma == 1, level).otherwise(F.least(F.lit(255), (F.pow(level / F.lit(255.0), 1.0 / gamma) * 255.0).cast("int")))


def to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue of 0 to 179, two degrees a step, saturation and value of 0 to 255, rounded; grey has hue 0."""
    value, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (value - low).cast("double")
    turn = F.when(value == r, 60 * (g - b) / span).when(value == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.when(span == 0, 0).otherwise(F.pmod(F.rint(F.pmod(turn, F.lit(360.0)) / 2).cast("int"), F.lit(180)))
    return hue, F.when(value == 0, 0).otherwise(F.rint(255 * span / value).cast("int")), value


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """The colour of a hue, saturation and value, rounded."""
    share = s / F.lit(255.0)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30.0, F.lit(6.0))
        return F.rint(v * (1 - share * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return channel(5), channel(3), channel(1)


def colour_chain(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """pixels(keys, …, r, g, b, gamma, contrast, saturation, hue) with the colour after all steps.

    Gamma, then contrast about the mean level of the frame that keys name, then saturation
    and hue. A step whose parameter has no effect leaves the colour as it is, unrounded
    trips through hue and saturation included.
    """
    out = pixels.withColumns({c: gamma_level(F.col(c), F.col("gamma")) for c in CHANNELS})
    mean = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0).over(Window.partitionBy(*keys))
    out = out.withColumn("_mean", mean)
    out = out.withColumns({c: F.when(F.col("contrast") == 1, F.col(c)).otherwise(N.contrast(F.col(c), F.col("_mean"), F.col("contrast"))) for c in CHANNELS})
    out = out.withColumns(dict(zip(("_h", "_s", "_v"), to_hsv(*map(F.col, CHANNELS)), strict=True)))
    out = out.withColumns({"_h": F.floor(N.shift_hue(F.col("_h"), F.col("hue"))).cast("int"), "_s": F.floor(N.scale_saturation(F.col("_s"), F.col("saturation"))).cast("int")})
    same = (F.col("saturation") == 1) & (F.col("hue") == 0)
    turned = zip(CHANNELS, from_hsv(F.col("_h"), F.col("_s"), F.col("_v")), strict=True)
    return out.withColumns({c: F.when(same, F.col(c)).otherwise(v) for c, v in turned}).drop("_mean", "_h", "_s", "_v")
